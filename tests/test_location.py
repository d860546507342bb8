"""Locations from sentences, references and marks of documents, layer plans and import statuses: literal cases."""

import time

import pytest
from pyspark.sql import functions as F

from terrafold.operators import context as X
from terrafold.operators import location as L
from terrafold.operators.extraction import windows

#: text, parcels (None: a header's numbers stand where parcels could, so they aren't judged), precinct, city, street
SENTENCES = [
    ("Inwestor wskazał działkę nr ewid. 218 obręb 0045 – Zalesie Górne położoną w Lipnie przy ul. Brzozowej 12.", ["218"], "0045 – Zalesie Górne", "Lipnie", "Brzozowej 12"),
    ("Działki nr ewid. 7/2, 11/3 oraz 56/8 obręb 31 – Borki-Wieś położone w Tczewie przy ul. Akacjowej.", ["7/2", "11/3", "56/8"], "31 – Borki-Wieś", "Tczewie", "Akacjowej"),
    ("wniosek wymienia działka ewidencyjna nr 44 obręb 0007 Kępno położona w Kępnie", ["44"], "0007 – Kępno", "Kępnie", None),
    ("STAROSTWO, Wydział Architektury, tel. 987-654-321, 11-200 Bartoszyce, www.powiat.pl\nDziałka nr ewid. 91/4 obręb 0021 Sępopol położona w Sępopolu przy ul. Rolnej 5.", None, "0021 – Sępopol", "Sępopolu", "Rolnej 5"),
    ("rozbudowa domu na działce nr ewid. 83 (obręb 0410 - Wola Mała, arkusz 17) położonej przy ul. Jana Kowala 9 w Elblągu", ["83"], "0410 – Wola Mała", "Elblągu", "Jana Kowala 9"),
    ("sprawa gruntu przy ul. Cichej - dz. nr ew. 15 i 16 z obr. 2-07-03 w Łomży", ["15", "16"], "2-07-03", "Łomży", "Cichej"),
    ("działki: 301/1, 301/3, 301/5 obręb ewidencyjny Niwki położone w Niwkach", ["301/1", "301/3", "301/5"], "Niwki", "Niwkach", None),
    ("Położenie nieruchomości Gdynia, ul. Portowa, dz. ew. nr 8/21 z obrębu 3-02-14 na terenie Dzielnicy Oksywie.", ["8/21"], "3-02-14", "Gdynia", "Portowa"),
    ("mapa obr. A 1 5", ["1/5"], "A 1 5", None, None),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(i, 1, s[0]) for i, s in enumerate(SENTENCES)] + [(100, 1, None), (101, 2, "Działka nr 5")], "doc_id long, page int, text string")
    return {r["doc_id"]: r for r in L.locations(pages).collect()}


@pytest.mark.parametrize("i", range(len(SENTENCES)))
def test_sentences(found, i):
    _, parcels, precinct, city, street = SENTENCES[i]
    r = found[i]
    assert (r["precinct"], r["city"], r["street"]) == (precinct, city, street)
    assert parcels is None or r["parcels"] == parcels
    assert 0 <= r["confidence"] <= 0.98


def test_documents_without_a_place(found):
    assert [found[i]["accepted"] for i in (100, 101)] == [False, False] and found[101]["score"] == 0
    assert found[0]["accepted"]


def test_fields_from_elsewhere(spark):
    """The subject window lacks street and city: from another window, the first page's whole text, or all pages; or nothing does."""
    subject, far = "Działka nr ewid. 77/3 obręb 0099 – Lasek,", "\n".join(f"wiersz {'x' * k}" for k in range(1, 8))
    pages = [
        (1, 1, f"{subject}\n{far}\nwniosek dotyczy ul. Sadowej 4"), (1, 2, "położona w Opolu"),
        (2, 1, f"{subject} położona w Opolu przy ul. Sadowej 4."), (2, 2, "Działka nr ewid. 1/1 obręb 0001 – Inny"),
        (3, 1, "nic tu nie ma"), (3, 2, "działka nr ewid. 5/6 obręb 0011 – Borek, położona w Pile"), (4, 1, None),
    ]
    got = {r["doc_id"]: r for r in L.merged_locations(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    kinds = ("parcels", "precinct", "precinct_number", "city", "street")
    assert [got[1][k] for k in kinds] == [["77/3"], "0099 – Lasek", "0099", "Opolu", "Sadowej 4"]
    assert got[1]["sources"].asDict() == {"parcels": "subject", "precinct": "subject", "street": "window", "city": "document"}
    assert [got[2][k] for k in kinds] == [["77/3"], "0099 – Lasek", "0099", "Opolu", "Sadowej 4"] and set(got[2]["sources"]) == {"subject"}
    assert [got[3][k] for k in kinds][:4] == [["5/6"], "0011 – Borek", "0011", "Pile"] and got[3]["sources"]["parcels"] == "document" and not got[3]["accepted"]
    assert [got[4][k] for k in kinds] == [[], None, None, None, None] and set(got[4]["sources"]) == {None}


def test_windows_reach_over_lines(spark):
    pages = spark.createDataFrame([(1, 1, "a\n\n b \r\nc\nd"), (1, 2, ""), (1, 3, None)], "doc_id long, page int, text string")
    got = {(r["n"], r["radius"]): r["text"].replace("\n", "") for r in windows(pages).collect()}
    assert got == {(0, 1): "ab", (1, 1): "abc", (2, 1): "bcd", (3, 1): "cd", (0, 2): "abc", (1, 2): "abcd", (2, 2): "abcd", (3, 2): "bcd"}


def test_references_and_marks(spark):
    text = "ul. Leśna 5, Radom\nadres: ul. Polna 7,\nmiejscowość: Radom, gmina Wola\nZnak sprawy: AB.12.3\nz dnia 31 maja 2024 r. oraz 31 czerwca 2024"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, "nic"), (2, 2, "26-600 Radom\n"), (2, 3, "00-120 Warszawa\n"), (3, 1, "\nAB-1/22-X\n")], "doc_id long, page int, text string")
    assert [r["street"] for r in L.street_references(pages).orderBy("rank").collect()] == ["Polna 7", "Leśna 5"]
    assert [(r["doc_id"], r["locality"]) for r in L.locality_references(pages).orderBy("doc_id", "page", "rank").collect()] == [(1, "Radom"), (1, "Wola"), (2, "Radom")]
    shown, day = L.long_date(F.col("text"))
    rows = {(r[0], r[1]): r[2:] for r in pages.select("doc_id", "page", L.issue_sign(F.col("text")), shown, day.cast("string")).collect()}
    assert rows[1, 1] == ("AB.12.3", "31 maja 2024 r", "2024-05-31") and rows[3, 1][0] == "AB-1/22-X" and rows[2, 1] == (None, None, None)


def test_layer_plan(spark):
    how = {r["layer_key"]: (r["strategy"], r["target_status"], r["scope"]) for r in X.catalogue(spark).collect()}
    assert len(how) == 60 and how["plot_boundary"] == ("core_geometry", "loaded", "plot_boundary") and how["land_use_boundary"] == ("try_direct_import", "loaded", "plot_boundary")
    assert how["driveway"][0] == "manual_placeholder" and how["buildable_area"][0] == "derive_later" and how["adjacent_building"][0] == "source_unavailable"
    assert {r["layer_key"]: r["strategy"] for r in X.catalogue(spark, ("tree",)).collect()}["adjacent_building"] == "create_empty"


def test_import_statuses(spark):
    found = spark.createDataFrame([(1, "tree", 2, 0), (2, "tree", 2, 2), (3, "tree", 2, 1), (4, "tree", 0, 0)], "context_id long, layer_key string, n long, n_bad long")
    got = {r["context_id"]: r for r in X.import_summary(found).collect()}
    assert got[1]["loaded"] == "plot_boundary,site_boundary,tree" and got[1]["status"] == "error" and "road_edge" in got[1]["unavailable"]
    assert got[2]["errors"] == "tree" and got[3]["loaded"].endswith("tree") and got[4]["empty"] == "tree" and got[1]["n_objects"] == 4


def test_long_runs_without_a_date(spark):
    """One run of 400,000 characters that no date follows: places within the run aren't tried anew."""
    pages = spark.createDataFrame([(1, 1, "ala ma kota " * 33_000 + "!"), (2, 1, "x Nowy Targ, dnia 3")], "doc_id long, page int, text string")
    began = time.time()
    got = {r["doc_id"]: r["locality"] for r in L.locality_references(pages).collect()}
    assert got == {2: "x Nowy Targ"} and time.time() - began < 60


def test_matches_have_their_places(spark):
    """Places of many matches come from one pass over the pieces."""
    text = "".join(f"ab{i}, " for i in range(5_000))
    began = time.time()
    got = spark.createDataFrame([(text,), ("none",), ("ab7",)], "t string").select(L.matches(F.col("t"), r"ab\d+").alias("m")).collect()
    assert time.time() - began < 60 and got[1]["m"] == [] and [tuple(x) for x in got[2]["m"]] == [(0, "ab7")]
    assert [x["found"] for x in got[0]["m"]] == [f"ab{i}" for i in range(5_000)] and all(text.startswith(x["found"], x["at"]) for x in got[0]["m"])


def test_letters_that_count_as_plain_ones(spark):
    """What patterns without case take for plain letters passes the search for literals too."""
    pages = spark.createDataFrame([(1, 1, "DZİAŁKA nr 12/3 położona w Lipnie")], "doc_id long, page int, text string")
    assert L.with_parcels(pages).first()["parcels"] == ["12/3"]


def test_many_streets_on_a_long_line(spark):
    """A line's signs are searched once, not once a street: 500 streets on a line of 7,000 characters."""
    text = "dotyczy działki\n" + "".join(f"ul. Nowa {i}, " for i in range(500)) + "dzia położona"
    began = time.time()
    got = L.with_street(spark.createDataFrame([(text,), ("ul. Stara 1,\ndziałka przy ul. Nowej 2, x",)], "text string")).collect()
    assert [r["street"] for r in got] == ["Nowa 499", "Nowej 2"] and time.time() - began < 60


def test_a_document_is_one_row(spark):
    """Where two rows are a document's page 1, its best window is told once; texts aren't joined to what is found in them."""
    place = "działka nr ewid. 5/6 obręb 0011 – Borek, położona w Pile"
    pages = spark.createDataFrame([(1, 1, "nic tu nie ma"), (1, 1, place), (2, 2, "położona w Opolu"), (2, 1, "wiersz")], "doc_id long, page int, text string")
    for f in (L.locations, L.merged_locations):
        got = f(pages)
        rows = sorted((r["doc_id"], tuple(r["parcels"]), r["city"]) for r in got.collect())
        assert rows == [(1, ("5/6",), "Pile"), (2, (), "Opolu" if f is L.merged_locations else None)]
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_many_streets_of_a_whole_text(spark):
    """Names are read from the best place on until one is told; the best line's last street wins, across line ends too."""
    text = "\n".join(f"al. Nowa {i}, potem ul.\nStara {i}, koniec" for i in range(1_500))
    began = time.time()
    rows = spark.createDataFrame([(text + "\ndotyczy ul. Lipowej 4, działka",), (text,), ("tel. 1, ul. Polna 3, x",), (None,)], "text string")
    got = [r["street"] for r in L.with_street(rows).collect()]
    assert got == ["Lipowej 4", "Stara 1499", None, None] and time.time() - began < 60
