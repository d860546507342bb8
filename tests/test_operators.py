"""Literal cases of the planning operators; the queries themselves are compared with SQL by tests/test_queries.py."""

import datetime as dt

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import parcel as P
from terrafold.functions import text as T
from terrafold.operators import cad, extraction, overlay
from terrafold.sources import payloads
from terrafold.streaming import jobs


def one(df):
    return df.first()[0]


def test_parcel_input(spark):
    row = spark.createDataFrame([(" 0123-04 ", "3-15-11", "Łódź")], "nr string, o string, m string")
    assert one(row.select(P.canonical(F.col("nr")))) == "0123/04"
    assert one(row.select(P.precinct_variants(F.col("o")))) == ["3-15-11", "31511", "11", "0011"]
    assert one(row.select(P.locality_variants(F.col("m")))) == ["Łódź", "łódź", "lodz"]


def test_error_classes(spark):
    df = spark.createDataFrame([("Tunnel connection failed: 403 Forbidden",), ("Network is unreachable",), ("odd",), (None,)], "m string")
    assert [r[0] for r in df.select(T.network_class(F.col("m"))).collect()] == ["PROXY_CONNECT_403", "NETWORK_UNREACHABLE", "NETWORK_ERROR", None]


def test_fields_from_a_planning_text(spark):
    text = "Maksymalna wysokość zabudowy: 9 m\nMinimalny udział powierzchni biologicznie czynnej wynosi 25%.\nDach dwuspadowy, kąt nachylenia 35°\nwysokość kalenicy: około dziewięć"
    got = {r["field_key"]: r for r in extraction.fields(spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")).collect()}
    assert got["maxBuildingHeightM"]["value_num"] == 9.0 and got["minBiologicallyActivePct"]["value_num"] == 25.0
    assert got["roofType"]["value_text"].lower() == "dach dwuspadowy" and got["roofAngleDeg"]["value_num"] == 35.0
    assert all(r["status"] == "EXTRACTED" for r in got.values()) and "maxRidgeHeightM" not in got


def test_first_page_wins(spark):
    pages = spark.createDataFrame([(1, 2, "wysokość zabudowy 7 m"), (1, 3, "wysokość zabudowy 8 m")], "doc_id long, page int, text string")
    assert extraction.fields(pages).first()["value_num"] == 7.0


def test_payload_errors(spark):
    df = spark.createDataFrame([(1, "<ows:ExceptionReport>x</ows:ExceptionReport>"), (2, "<html><body>"), (3, ""), (4, None), (5, "{"), (6, "{}"), (7, '{"features":[]}')], "payload_id long, body string")
    got = {r["payload_id"]: r["error"] for r in payloads.parsed_collections(df).collect()}
    assert got == {1: "service_exception", 2: "html_response", 3: "empty_response", 4: "empty_response", 5: "invalid_json", 6: "missing_features", 7: None}


def test_gml_and_replies(spark):
    gml = "<a xmlns:gml='g'><gml:Polygon><gml:posList>0 0 1 0 1 1 0 0</gml:posList></gml:Polygon></a>"
    assert one(spark.createDataFrame([(gml,)], "b string").select(payloads.gml_rings(F.col("b")))) == [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]]
    reply = spark.createDataFrame([('{"id":"141201_1.0001.6509","geom_wkt":"POINT(1 2)"}',)], "p string").select(*payloads.parcel_reply(F.col("p"), F.lit("x"))).first()
    assert reply[0] == "141201_1.0001.6509" and reply[2] == "POINT(1 2)"


def test_twenty_metre_plot(spark):
    plot = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "plot_id long, x0 double, y0 double, x1 double, y1 double")
    assert plot.select(G.area(G.rectangle("x0", "y0", "x1", "y1")), G.perimeter(G.rectangle("x0", "y0", "x1", "y1"))).first()[:] == (400.0, 80.0)
    none = spark.createDataFrame([], "feature_id long, plot_id long, layer_key string, fx0 double, fy0 double, fx1 double, fy1 double")
    assert overlay.buildable(plot, none).first()["buildable_area"] == 144.0
    zone = spark.createDataFrame([(1, 1, "no_build_zone", 4.0, 4.0, 7.0, 7.0)], none.schema)
    assert overlay.buildable(plot, zone).first()["buildable_area"] == 135.0 and overlay.zone_areas(plot, zone).first()["area"] == 9.0


def test_units(spark):
    df = spark.createDataFrame([(4, 10.0), (0, 20_000.0), (None, 5.0)], "code int, d double")
    assert [tuple(r) for r in df.select(*cad.unit_of(F.col("code"), F.col("d"))).collect()] == [("mm", 0.001, "header"), ("mm", 0.001, "heuristic"), ("m", 1.0, "heuristic")]


def part_files(spark, folder):
    """events in three files, the latest calls in the first."""
    events = spark.createDataFrame([(i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=97 * i + i % 3), i % 5 // 2, "error" if i % 11 < 8 or 300 < i < 420 else "view", 1.0) for i in range(900)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    for k, test in enumerate(("event_id >= 600", "event_id < 300", "event_id BETWEEN 300 AND 599")):
        events.where(test).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return events


def test_streams_take_all_part_files_in_order(spark, tmp_path):
    from terrafold.operators import health
    from terrafold.plans import QUERIES

    events = part_files(spark, tmp_path)
    names = F.element_at(F.array(*map(F.lit, ("ULDK", "WFS", "KIEG"))), (F.col("user_id") % 3 + 1).cast("int"))
    calls = events.select(F.col("event_id").alias("call_id"), "ts", names.alias("source"), (F.col("event_type") != "error").alias("ok"))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(QUERIES["t_1_success_stream"](spark, str(tmp_path)), health.success_windows(calls))
    assert same(QUERIES["t_4_circuit_stream"](spark, str(tmp_path)), health.circuit(calls))
    want, kept = {}, {}
    for r in calls.orderBy("ts", "call_id").collect():
        last = kept[r["source"]] = [t for t in kept.get(r["source"], []) if (r["ts"] - t).total_seconds() < 600]
        want[r["call_id"]] = len(last) < 3
        if want[r["call_id"]]:
            last.append(r["ts"])
    got = QUERIES["t_5_rate_limit_stream"](spark, str(tmp_path)).collect()
    assert len(got) == 900 and {r["call_id"]: r["accepted"] for r in got} == want


def test_state_is_handed_on_between_batches(spark, tmp_path):
    from terrafold.operators import health

    calls = spark.createDataFrame([(f"s{i % 2}", i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=400 * i), i in (3, 4, 21)) for i in range(60)], "source string, call_id long, ts timestamp, ok boolean")
    states, limits = jobs.circuit_states(f"{tmp_path}/a"), jobs.rate_limits(f"{tmp_path}/b", 3, 4_000)
    one = jobs.rate_limits(f"{tmp_path}/c", 3, 4_000)
    for number, test in enumerate(("call_id < 17", "call_id BETWEEN 17 AND 18", "call_id > 18")):
        states(calls.where(test), number)
        limits(calls.where(test), number)
    one(calls, 0)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    read = lambda k: spark.read.parquet(f"{tmp_path}/{k}/out")
    assert rows(read("a"), "call_id", "failures", "is_open") == rows(health.circuit(calls), "call_id", "failures", "is_open")
    assert rows(read("b"), "call_id", "accepted") == rows(read("c"), "call_id", "accepted")


def test_zones_of_a_large_plot(spark):
    plots = spark.createDataFrame([(1, 0.0, 0.0, 600.0, 500.0)], "plot_id long, x0 double, y0 double, x1 double, y1 double")
    features = spark.createDataFrame([(1, "flood_zone", 10.0, 10.0, 30.0, 20.0)], "plot_id long, layer_key string, fx0 double, fy0 double, fx1 double, fy1 double")
    assert [tuple(r) for r in overlay.zone_areas(plots, features).collect()] == [(1, "flood_zone", 200.0)]


def test_nearest_labels_of_any_spread(spark):
    """Texts crowded in a corner, far outlines, ties, a file without texts: as by comparing all."""
    import math
    import random

    r = random.Random(6)
    rows = [(1, "TEXT", False, f"t{i % 7}", r.choice([r.uniform(0, 5), r.uniform(0, 1000)]), r.uniform(0, 5), 0.0, 0.0) for i in range(120)]
    rows += [(1, "LWPOLYLINE", True, "a", r.uniform(-2000, 3000), r.uniform(-10, 400), 4.0, 6.0) for _ in range(60)]
    rows += [(2, "TEXT", False, label, x, 0.0, 0.0, 0.0) for label, x in (("b", 0.0), ("a", 10.0), (None, 40.0))] + [(2, "LINE", True, "a", 3.0, -2.0, 4.0, 4.0), (3, "LINE", True, "a", 3.0, -2.0, 4.0, 4.0), (2, "LINE", False, "a", 30.0, 0.0, 1.0, 1.0)]
    entities = spark.createDataFrame(rows, "file_id long, etype string, closed boolean, layer string, x double, y double, w double, h double")
    want = {}
    for f, kind, closed, _, x, y, w, h in rows:
        texts = [(round(math.hypot(x + w / 2 - t[4], y + h / 2 - t[5]), 6), t[3] or "", t[3]) for t in rows if t[0] == f and t[1] == "TEXT"]
        if closed and kind != "TEXT" and texts:
            want[f, x, y] = min(texts)[:1] + min(texts)[2:]
    got = {(r["file_id"], r["x"], r["y"]): (round(r["distance"], 6), r["label"]) for r in cad.nearest_label(entities).collect()}
    assert got == want


def test_plan_rules_try_their_three_limits_only(spark):
    text = "Działka ewid. 12/3\nMaksymalna wysokość zabudowy: 9,5 m\nPowierzchnia biologicznie czynna 25 %\nPowierzchnia zabudowy 30 %\nDach dwuspadowy"
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    out = extraction.plan_rules(pages)
    assert out.select("doc_id", "parcel", "height", "bio", "coverage").collect() == [(1, "12/3", 9.5, 25.0, 30.0)]
    assert "dach" not in out._jdf.queryExecution().optimizedPlan().toString() and {r["field_key"] for r in extraction.fields(pages).collect()} > {r["field_key"] for r in extraction.fields(pages, ["roofType"]).collect()} == {"roofType"}


def test_areas_across_bands(spark, monkeypatch):
    """Plots across bands and batches, a long one, a repeated one and one with a point that has no place; the others' areas don't change by it."""
    from terrafold.operators import runs as R

    monkeypatch.setattr(R, "AT_ONCE", 3_000)
    nan = float("nan")
    boxes = [(1, 0.0, 1000.0, 20.0, 1050.0), (2, 3.0, -10.0, 23.0, 3990.0), (3, 0.0, 0.0, nan, 30.0), (4, 5.0, 5.0, 35.0, 45.0), (5, 0.0, 0.0, 10.0, 10.0), (5, 5.0, 0.0, 15.0, 10.0)] + [(i, 0.0, 100.0, 12.0, 112.0) for i in range(6, 60)]
    plots = spark.createDataFrame(boxes, "plot_id long, x0 double, y0 double, x1 double, y1 double").withColumn("ring", G.rectangle("x0", "y0", "x1", "y1"))
    zones = spark.createDataFrame([(1, "no_build_zone", 0.0, 1020.0, 20.0, 1030.0), (4, "road_edge", 0.0, 0.0, 99.0, 99.0), (99, "tree", 0.0, 0.0, 0.0, 0.0)], "plot_id long, layer_key string, fx0 double, fy0 double, fx1 double, fy1 double")
    got = {r[0]: tuple(r)[1:] for r in R.buildable_zones(plots, "ring", zones).collect()}
    assert got[1] == (1000, 12 * 32, 12 * 32, 2 * 10 * 14) and got[2] == (80_000, 12 * 3992, 12 * 3992, 10 * 3990)
    assert got[3] == (0, 0, 0, 0) and got[4] == (1200, 22 * 32, 22 * 32, 20 * 30) and got[6] == got[59] == (144, 16, 16, 4)
    other = G.rectangle(F.col("x0") + 5, F.col("y0") + 7, F.col("x1") + 5, F.col("y1") + 7)
    rows = [tuple(r) for r in R.set_areas(plots.withColumn("other", other), "ring", "other").collect()]
    sets = {r[0]: r[1:] for r in rows}
    assert sets[1] == (2000 - 15 * 43, 15 * 43, 1000 - 15 * 43) and sets[2] == (160_000 - 15 * 3993, 15 * 3993, 80_000 - 15 * 3993) and sets[3] == (None,) * 3
    assert sets[5] == (300 - 10 * 3, 10 * 3, 150 - 10 * 3) and sum(r[0] == 5 for r in rows) == 2
    # Around a rectangle lie its four sides' strips and four quarters of a disc.
    wide = {r[0]: r[1] for r in R.buffered_areas(plots, "ring", F.lit(10.0)).collect()}
    quarters = wide[6] - 144 - 4 * 120
    assert 3 not in wide and 300 < quarters < 330 and wide[1] == 1000 + 2 * 200 + 2 * 500 + quarters and wide[2] == 80_000 + 2 * 200 + 2 * 40_000 + quarters
