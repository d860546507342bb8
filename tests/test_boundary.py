"""Literal cases of boundaries, rings, picks and typed values."""

import time

from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.functions import text as T
from terrafold.functions import values as V
from terrafold.operators import boundary as B
from terrafold.operators import overlay
from terrafold.operators.extraction import CATALOGUE
from terrafold.sources import gml

RING = "array<struct<x: double, y: double>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10))


def test_crossings(spark):
    bow = ring((0, 0), (10, 10), (10, 0), (0, 10))
    far = ring((20, 20), (30, 20), (30, 30))
    inner = ring((2, 2), (4, 2), (4, 4))
    df = spark.createDataFrame([(SQUARE, bow, far, inner, [])], f"s {RING}, b {RING}, f {RING}, i {RING}, e {RING}")
    c = F.col
    row = df.select(G.crosses_itself(c("s")), G.crosses_itself(c("b")), G.rings_meet(c("s"), c("f")), G.rings_meet(c("s"), c("i")), G.rings_meet(c("s"), c("e")), G.ring_errors(c("b"))).first()
    assert list(row) == [False, True, False, True, False, ["no area", "crosses itself"]]


def test_rings_from_loose_segments(spark):
    """A square of reversed and repeated segments, an open chain, a branching shape, a file of its own; two layers."""
    square = [("a", 0, 0, 10, 0), ("a", 10, 10, 10, 0.001), ("b", 10, 10, 0, 10), ("b", 0, 10, 0, 0), ("b", 0, 0, 0, 10)]
    chain = [("a", 50, 50, 60, 50), ("a", 60, 50, 60, 60)]
    branch = [("a", 100, 0, 110, 0), ("a", 110, 0, 105, 5), ("a", 105, 5, 100, 0), ("a", 105, 5, 105, 20)]
    dot = [("a", 70, 70, 70.001, 70)]
    rows = [(1, *map(lambda v: v if isinstance(v, str) else float(v), r)) for r in square + chain + branch + dot]
    rows += [(2, "z", 0.0, 0.0, 3.0, 0.0), (2, "z", 3.0, 0.0, 0.0, 4.0), (2, "z", 0.0, 4.0, 0.0, 0.0)]
    out = B.rings(spark.createDataFrame(rows, "file_id long, layer string, ax double, ay double, bx double, by double"))
    got = sorted(map(tuple, out.select("file_id", F.size("ring"), F.round(G.area(F.col("ring")), 2), "layer").collect()))
    assert got == [(1, 4, 100.0, "b"), (2, 3, 6.0, "z")]


def test_a_long_chain_of_nodes_is_one_ring(spark):
    n = 60
    corners = [(i, 0) for i in range(n)] + [(n - i, 9) for i in range(n)]
    rows = [(7, "a", *map(float, corners[i]), *map(float, corners[(i + 1) % len(corners)])) for i in range(len(corners))]
    out = B.rings(spark.createDataFrame(rows, "file_id long, layer string, ax double, ay double, bx double, by double"))
    assert [r[0] for r in out.select(F.size("ring")).collect()] == [2 * n]


def test_loops_of_any_length(spark, monkeypatch):
    """Loops put in order by doubling are those that a walk gives; one of 12,000 points is put in order too."""
    small = [(100 * k + x, 500 + y) for k in range(3) for x, y in ((0, 0), (9, 1), (7, 8), (3, 9), (-2, 4))]
    edges = [(small[5 * k + i], small[5 * k + (i + 1) % 5]) for k in range(3) for i in range(5)]
    rows = spark.createDataFrame([(7, "a", *map(float, a + b)) for a, b in edges], "file_id long, layer string, ax double, ay double, bx double, by double")
    told = lambda: {(r["ri"], r["rj"]): [(p["x"], p["y"]) for p in r["ring"]] for r in B.rings(rows).collect()}
    walked = told()
    monkeypatch.setattr(B, "WALKED", 4)
    assert told() == walked and sorted(map(len, walked.values())) == [5, 5, 5]
    long_ = [(i, 0) for i in range(6_000)] + [(5_999 - i, 9) for i in range(6_000)]
    both = [(1, 0, 0, a, b, 0.5) for x, y in zip(long_, long_[1:] + long_[:1]) for a, b in ((x, y), (y, x))]
    out = B.ordered(spark.createDataFrame(both, "file_id long, ri long, rj long, u struct<i: long, j: long>, v struct<i: long, j: long>, eps double")).collect()
    assert len(out) == 1 and [(p["x"], p["y"]) for p in out[0]["ring"]] == [(x / 2, y / 2) for x, y in [long_[0], *long_[:0:-1]]]


def test_small_files_are_taken_apart_in_a_task(spark, monkeypatch):
    """Loops, open chains and branches give the same rings and layers in a task as by all together; without large files nothing is checkpointed."""
    loops = [[(40 * k + x, y) for x, y in ((0, 0), (9, 1), (7, 8), (3, 9), (-2, 4))[: 3 + k % 3]] for k in range(9)]
    ends = [(f, "ab"[(i + k) % 2] if k else None, *map(float, loop[i] + loop[(i + 1) % len(loop)])) for f in (1, 2) for k, loop in enumerate(loops[: 9 - f]) for i in range(len(loop)) if (f, k, i) != (1, 4, 0)]
    ends += [(1, "b", 80.0, 0.0, 81.0, 50.0), (1, "b", 9.0, 1.0, 0.0, 0.0), (3, "a", 0.0, 0.0, 0.001, 0.0)]
    rows = spark.createDataFrame(ends, "file_id long, layer string, ax double, ay double, bx double, by double")
    told = lambda: {(r["file_id"], r["ri"], r["rj"]): (r["layer"], [(p["x"], p["y"]) for p in r["ring"]]) for r in B.rings(rows).collect()}
    cuts = []
    monkeypatch.setattr(B, "cut", lambda df: cuts.append(1) or df.checkpoint())
    in_task = told()
    assert not cuts and len(in_task) == 13
    monkeypatch.setattr(B, "WALKED", 6)
    assert told() == in_task and cuts


def test_outside_results_have_every_field(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    some = spark.createDataFrame([(1, "coloring", "white", None, None), (1, "unknown", "x", None, None)], "doc_id long, field_key string, value string, unit string, confidence double")
    got = B.merged_external(some, docs, CATALOGUE).collect()
    assert len(got) == 56 and all(len({r["field_key"] for r in got if r["doc_id"] == d}) == 28 for d in (1, 2))
    assert [(r["value"], r["confidence"], r["status"]) for r in got if r["doc_id"] == 1 and r["field_key"] == "coloring"] == [("white", 0.75, "EXTRACTED")]


def test_no_segments_no_rings(spark):
    empty = spark.createDataFrame([], "file_id long, layer string, ax double, ay double, bx double, by double")
    assert B.rings(empty).count() == 0


def test_inset(spark):
    rows = [("square", SQUARE, [1.0, 2.0, None, 4.0]), ("clockwise", SQUARE[::-1], [1.0] * 4), ("two points", SQUARE[:2], []), ("null", None, None), ("sharp", ring((0, 0), (10, 0), (0.5, 1)), [3.0, 3.0, 3.0])]
    out = B.inset(spark.createDataFrame(rows, f"name string, ring {RING}, w array<double>"), "ring", "w").select("name", "ring", "inset", G.area(F.col("inset")).alias("area"), G.contains_ring(F.col("ring"), F.col("inset")).alias("inside"))
    got = {r["name"]: r for r in out.collect()}
    assert [(round(p["x"], 6), round(p["y"], 6)) for p in got["square"]["inset"]] == [(4, 1), (8, 1), (8, 7), (4, 7)]
    assert round(got["clockwise"]["area"], 6) == 64
    assert got["two points"]["inset"] is None and got["null"]["inset"] is None
    assert got["sharp"]["inside"] in (True, None)


def test_point_sets(spark):
    df = spark.createDataFrame([(SQUARE, ring((5, 5), (20, 5), (20, 8), (5, 8)), ring((-1, 4), (11, 4), (11, 6), (-1, 6)))], f"s {RING}, o {RING}, w {RING}")
    c = F.col
    halves = G.split_by_line(c("s"), F.get("s", F.lit(0)), F.get("s", F.lit(1)))
    row = df.select(F.size(G.clipped(c("o"), c("s"))), F.size(G.difference(c("s"), c("w"))), F.size(G.difference(c("s"), c("o"))), G.area(G.united(F.array("s", "o"))), F.size(F.get(halves, F.lit(0)))).first()
    assert list(row) == [2, 0, 4, 200.0, 4]


def test_typed_values(spark):
    texts = ['{"a": [1]}', "[]", "false", "-12", "1e3", '"x"', "null", None, "", "10 m", "{a", "98765432109876543210"]
    value, kind = V.typed(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(kind, value).collect()]
    assert [k for k, _ in got] == ["JSON", "JSON", "BOOLEAN", "INTEGER", "NUMBER", "TEXT", "TEXT", "TEXT", "TEXT", "TEXT", "TEXT", "INTEGER"]
    assert [v for _, v in got][5:11] == ["x", None, None, "", "10 m", "{a"]


def test_names(spark):
    df = spark.createDataFrame([("ul. Łąkowa 3, OBRĘB 2", "Warszawie"), ("", None)], "s string, p string")
    assert [tuple(r) for r in df.select(T.street_name(F.col("s")), T.place_name(F.col("p"))).collect()] == [("ul. Łąkowa 3", "Warszawa"), (None, None)]


def test_matches_and_nesting(spark):
    plots = spark.createDataFrame([(5, 1, "a", "b"), (3, 1, "b", "b"), (4, 2, "a", None)], "plot_id long, project_id long, parcel_id string, external_ref string")
    asked = spark.createDataFrame([(1, 1, "b", True), (2, 1, "a", False), (3, 2, "b", True), (4, None, "a", True)], "request_id long, project_id long, wanted string, has_geometry boolean")
    assert sorted(map(tuple, B.either_key(asked, plots).collect())) == [(1, 3, "update"), (2, 5, "keep"), (3, None, "insert"), (4, None, "insert")]
    children = spark.createDataFrame([(1, 2, "y"), (1, 1, "z")], "k long, n long, v string")
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    got = {r["k"]: [c["v"] for c in r["c"]] for r in B.nested(parents, children, "k", ["n"], "c").collect()}
    assert got == {1: ["z", "y"], 2: []}
    linked = spark.createDataFrame([(1, 10, 1, True), (1, 11, 2, False), (2, 12, 1, False), (1, 13, 4, False)], "request_id long, plot_id long, rank int, ambiguous boolean")
    assert sorted(r["plot_id"] for r in B.on_warning(linked).collect()) == [10, 11]


def test_gml_features(spark):
    """Two forms of members, a multi-polygon, an open coordinate list, repeated names, a feature without a polygon, bodies of other kinds."""
    poly = "<gml:Polygon><gml:posList>{}</gml:posList></gml:Polygon>"
    square = poly.format("0 0 1 0 1 1 0 1")
    bodies = [
        f'<c><gml:featureMember><a fid="f1"><n>1</n><n> 2 </n><e></e><g><gml:MultiSurface>{square}{square}</gml:MultiSurface></g></a></gml:featureMember><wfs:member><b><n>9</n></b></wfs:member></c>',
        "<c><gml:featureMembers><a><g><Polygon><coordinates>0,0 2,0 2,2 0,2</coordinates></Polygon></g></a></gml:featureMembers></c>",
        f"<c><member><a><g>{poly.format('0 0 1 x 1 1 0 1')}</g></a></member><member><a><g>{poly.format('0 0 1 0 1 1')}</g></a></member></c>",
        "{}", "", None, "<c><member><a>",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "payload_id long, body string")
    got = {r["payload_id"]: r for r in gml.gml_features(df).collect()}
    assert sorted(got) == [0, 1]
    assert got[0]["id"] == "f1" and got[0]["properties"] == {"n": "2"} and [len(r) for r in got[0]["rings"]] == [5, 5]
    assert got[1]["id"] is None and [len(r) for r in got[1]["rings"]] == [4]


def test_linkage_scores(spark):
    """Number 60, a precinct's form 25, locality 15 in any case, 10 more without marks; nulls match nothing."""
    parcels = spark.createDataFrame([(1, "3/4", "0011", "Łódź"), (2, "9", "0011", "Lodz"), (3, None, None, None)], "plot_id long, parcel_number string, precinct string, locality string")
    asked = spark.createDataFrame([(1, "3/4", "3-15-11", "łódź"), (2, "x", "11", "LODZ"), (3, None, None, None)], "request_id long, number string, precinct string, locality string")
    got = sorted((r["request_id"], r["plot_id"], r["score"]) for r in overlay.linked(asked, parcels).collect())
    assert got == [(1, 1, 110), (1, 2, 50), (2, 1, 35), (2, 2, 50)]


def test_long_coordinate_lists(spark):
    """Lists are split once: 10,000 points, which took a split of the whole list for each number before."""
    listed = " ".join(f"{i} {i * i % 97}" for i in range(10_000))
    body = f"<c><member><a><g><Polygon><posList>{listed}</posList></Polygon></g></a></member></c>"
    began = time.time()
    row = gml.gml_features(spark.createDataFrame([(1, body)], "payload_id long, body string")).selectExpr("size(rings[0]) n", "rings[0][9999].x x").first()
    assert (row["n"], row["x"]) == (10_001, 9999.0) and time.time() - began < 60


def test_long_typed_vertices(spark):
    text = "\n".join(f"{i + 5},{i % 2}" for i in range(10_000))
    began = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(G.vertices(F.col("t")).alias("r")).selectExpr("size(r) n", "r[9999].x x", "r[0].x x0").first()
    assert (row["n"], row["x"], row["x0"]) == (10_000, 9999.0, 0.0) and time.time() - began < 60


def test_links_are_ranked_without_a_shuffle_of_all_pairs(spark):
    """Ranks and ambiguity as one window over all pairs gives them, with and without k, repeated ids and missing values too."""
    places = [("0011", "Łódź"), ("11", "Lodz"), ("0012", "Radom"), (None, "Radom"), ("0012", None)]
    plots = [(i, str(i % 3) if i % 7 else None, *places[i % 5]) for i in range(60)]
    asked = [(i, str(i % 4) if i % 5 else None, ("11", "3-15-11", "12", None)[i % 4], ("łódź", "LODZ", "radom", None)[i // 4 % 4]) for i in range(32)]
    of = lambda rows, name, number: spark.createDataFrame(rows, f"{name} long, {number} string, precinct string, locality string")
    show = lambda df: sorted(tuple(x) for x in df.select("request_id", "plot_id", "score", "rank", F.coalesce(F.col("ambiguous").cast("string"), F.lit("null")).alias("a")).collect())
    got = show(overlay.linked(of(asked, "request_id", "number"), of(plots, "plot_id", "parcel_number")))
    plain = show(overlay.linked(of(asked + asked[:1], "request_id", "number"), of(plots, "plot_id", "parcel_number")))  # a repeated row: all pairs in one window
    assert got == plain and len(got) > 300
    assert show(overlay.linked(of(asked, "request_id", "number"), of(plots, "plot_id", "parcel_number"), 3)) == [x for x in plain if x[3] <= 3]
    shuffled = overlay.linked(of(asked, "request_id", "number"), of(plots, "plot_id", "parcel_number"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [request_id" not in shuffled.split("Union")[0]


def test_lists_of_parcels_in_chunks(spark, monkeypatch):
    """Ranks go on across chunks, and pairs are no function's rows: the stretches of a list are all that a request is joined with."""
    asked = [(i, str(i % 5), "0011", "Radom") for i in range(12)]
    plots = [(i, str(i % 5), "0011" if i % 9 else "0012", "Radom" if i % 2 else "radom") for i in range(100)]
    of = lambda rows, name, number: spark.createDataFrame(rows, f"{name} long, {number} string, precinct string, locality string")
    show = lambda df: sorted(tuple(x) for x in df.select("request_id", "plot_id", "score", "rank", F.coalesce(F.col("ambiguous").cast("string"), F.lit("null")).alias("a")).collect())
    plain = show(overlay.linked(of(asked + asked[:1], "request_id", "number"), of(plots, "plot_id", "parcel_number")))
    monkeypatch.setattr(overlay, "LISTED", 7)
    got = overlay.linked(of(asked, "request_id", "number"), of(plots, "plot_id", "parcel_number"))
    assert show(got) == plain and len(plain) > 1000
    assert "inline(slice" in got._jdf.queryExecution().optimizedPlan().toString()
