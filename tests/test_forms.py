"""Flat forms and key sentences: literal cases; patterns alone are also compared with SQL."""

from terrafold.operators import forms as P

PAGES = "doc_id long, page int, text string"


def test_flat_form(spark):
    one = "liczba kondygnacji podziemnych: 0\nZnak sprawy: XY.7.2024\nz dnia 3 maja 2024 r.\nWydany dla: Anna Nowak,\nSymbol terenu: mn/u\nmaksymalna wysokość zabudowy: 9,5 m\nintensywność zabudowy 0,4\ndach płaski"
    two = "Działka nr ewid. 12/3 obręb 0007 – Gaj położona w Opolu przy ul. Polnej 3."
    rows = P.flat_form(spark.createDataFrame([(1, 2, two), (1, 1, one + "\n" + two), (2, 1, None), (3, 1, "U – tereny usług")], PAGES)).collect()
    got = {d: {r["form_key"]: r for r in rows if r["doc_id"] == d} for d in (1, 2, 3)}
    assert all(len(g) == 34 for g in got.values())
    value = {k: r["value"] for k, r in got[1].items()}
    assert (value["znak_sprawy"], value["data_wydania"], value["wydany_dla"], value["symbol_terenu_mpzp"]) == ("XY.7.2024", "3 maja 2024 r", "Anna Nowak", "MN/U")
    assert (value["max_wysokosc"], value["max_intensywnosc"], value["min_intensywnosc"], value["dach_typ"]) == ("9.5", "0.4", None, "dach płaski")
    assert (value["numer_dzialki"], value["numery_dzialek"], value["obreb_gmina"], value["ulica"], value["miejscowosc"]) == ("12/3", "12/3", "0007 – Gaj", "Polnej 3", "Opolu")
    assert got[1]["max_liczba_kondygnacji_podziemnych"]["value"] == "0.0" and got[1]["max_liczba_kondygnacji_podziemnych"]["confidence"] == 0.0
    assert got[1]["max_wysokosc"]["confidence"] == 0.7 and got[1]["evidence"]["value"] == "parcels,precinct,street,city"
    assert got[2]["numer_dzialki"]["value"] is None and sum(r["confidence"] > 0 for k, r in got[2].items() if k != "notatki" and k != "location_confidence") == 0
    assert (got[3]["symbol_terenu"]["value"], got[3]["przeznaczenie_podstawowe"]["value"]) == ("U", "tereny usług")


def test_key_sentences(spark):
    pages = [
        (1, 1, "wstęp"), (1, 2, "nic\n\ndziałka nr ew. 7 / 2 obręb nr 4-05-12\nprzy ul. Miłej 5 w Rawie\n00-950 Warszawie, gmina X\nkoniec"),
        (2, 1, "Działka nr 8 z obrębu Lipa\nw Turku i w Koninie"),
        (3, 1, "obręb 0012, działki\nnr ewid. 5/6, ul. Wąska 4, miasto Piła, w Pile"), (4, 1, None), (5, 1, "brak"),
    ]
    got = {r["doc_id"]: r for r in P.key_sentences(spark.createDataFrame(pages, PAGES)).collect()}
    fields = lambda i: tuple(got[i][k] for k in P.SURE)
    sure = lambda i: tuple(got[i][f"{k}_confidence"] for k in P.SURE)
    assert fields(1) == ("7/2", "4-05-12", "ul. Miłej 5", "Warszawa") and sure(1) == (0.9, 0.9, 0.8, 0.7) and got[1]["page"] == 2
    assert fields(2) == ("8", None, None, "Koninie") and sure(2) == (0.9, 0.0, 0.0, 0.7)
    assert got[2]["said"] == "Działka nr 8 z obrębu Lipa w Turku i w Koninie"
    assert got[3]["said"].startswith("obręb 0012") and fields(3)[3] == "Pile"
    assert fields(4) == (None,) * 4 and fields(5) == (None,) * 4 and sure(5) == (0.0,) * 4


def test_fields_from_anywhere(spark):
    page = "Plan\ndziałka ewidencyjna\nnr 31\nlezy przy ul. Długa 7, Gniezno\nobrębu 0044 Rola\nw Gnieznie"
    r = P.key_sentences(spark.createDataFrame([(1, 1, page)], PAGES)).first()
    assert (r["numer_dzialki"], r["obreb"], r["ulica"], r["miejscowosc"], r["said"]) == ("31", "0044", "ul. Długa 7", "Gnieznie", None)
    assert {r[f"{k}_confidence"] for k in P.SURE} == {0.6}


def test_each_pattern_needs_its_words(spark):
    """Patterns are tried on texts with their words in any case only, and a form is made without a join."""
    told = {"wydany_dla": "DLA: ANNA", "status_planu": "BRAK", "podstawa_prawna": "UCHWAŁA NR 7 Z 2020", "funkcje_zakazane": "NIE DOPUSZCZA SIĘ GARAŻY", "dach_typ": "DACH PŁASKI", "strefy_ograniczenia": "STREFA OCHRONY", "parking_wymagania": "PARKİNG 2"}
    form = P.flat_form(spark.createDataFrame([(i, 1, text) for i, text in enumerate(told.values())], PAGES))
    got = {(r["doc_id"], r["form_key"]): r["value"] for r in form.collect()}
    for i, key in enumerate(told):
        assert got[i, key], key
    plan = form._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.lower().count("contains(") > 20
