"""Queries over geometry, overlays, linkage, footprints and CAD tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cad as C
from ..operators import overlay as O
from .fixtures import oracle, spread, view

def ring():
    return G.rectangle("x0", "y0", "x1", "y1")


def parcels(s, d):
    return view(s, d, "f_parcels")


def features(s, d):
    return view(s, d, "f_features").withColumn("fx1", F.col("fx0") + F.col("w")).withColumn("fy1", F.col("fy0") + F.col("h"))


def entities(s, d):
    return view(s, d, "f_entities")


def ring_measures(s, d):
    c = G.centroid(ring())
    return parcels(s, d).select("plot_id", G.area(ring()).alias("area"), G.perimeter(ring()).alias("perimeter"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), G.vertex_mean(ring())["x"].alias("mx"), (G.bounds(ring())["x1"] - G.bounds(ring())["x0"]).alias("span"), G.contains_point(ring(), F.col("x0") + 1, F.col("y0") + 1).alias("inside"), G.contains_point(ring(), F.col("x1") + 1, F.col("y0") + 1).alias("outside"), F.round(G.compactness(G.area(ring()), G.perimeter(ring())), 9).alias("compact"), G.distance_rule(F.lit(4.0), F.col("x1") - F.col("x0")).alias("distance"))


def ring_checks(s, d):
    bad = F.when(F.col("plot_id") % 4 == 0, F.slice(ring(), 1, 2)).when(F.col("plot_id") % 4 == 1, F.concat(ring(), F.slice(ring(), 1, 1))).when(F.col("plot_id") % 4 == 2, F.reverse(ring())).otherwise(ring())
    return parcels(s, d).select("plot_id", F.array_join(G.ring_errors(bad), ";").alias("errors"), G.ring_text(G.counter_clockwise(bad)).alias("ring"))


def typed_vertices(s, d):
    text = F.concat_ws("\n", F.concat_ws(",", F.col("x0").cast("int").cast("string"), F.col("y0").cast("int").cast("string")), F.lit("bad line"), F.concat_ws(" , ", F.col("x1").cast("int").cast("string"), F.col("y0").cast("int").cast("string")), F.when(F.col("plot_id") % 3 != 0, F.concat_ws(",", F.col("x1").cast("int").cast("string"), F.col("y1").cast("int").cast("string"))))
    rings = spread(parcels(s, d)).select("plot_id", G.vertices(text).alias("ring"))
    return rings.select("plot_id", G.area(F.col("ring")).alias("area"), F.array_max(F.transform("ring", lambda p: p["x"])).alias("width"))


def requests(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("request_id"), F.concat((F.col("doc_id") % 499 + 1).cast("string"), F.lit("/"), (F.col("doc_id") % 7 + 1).cast("string")).alias("number"), F.lpad((F.col("doc_id") % 97 + 1).cast("string"), 4, "0").alias("precinct"), F.element_at(F.array(*map(F.lit, ("Radomiu", "Szczecinku", "Ciechanowie", "Warszawie"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("locality"))


def boxes(s, d):
    return C.bounds(entities(s, d))


def units(s, d):
    return C.with_units(boxes(s, d), (F.col("file_id") % 24).cast("int"))


def kinds(s, d):
    return s.createDataFrame([(k,) for k in (*O.RESTRICTED, "tree")], "kind string")


def candidates(s, d):
    preferred = entities(s, d).select("file_id").distinct().where("file_id % 4 = 0").withColumn("layer", F.lit("Budynek"))
    return C.boundary_candidates(entities(s, d), boxes(s, d), preferred)


def detailed(s, d):
    """Entities with line types, colours, and blocks with tags, made of their sizes and places."""
    k, name = F.col("x").cast("long"), lambda p, n: F.concat(F.lit(p), n.cast("string"))
    inserts = F.when(F.col("etype") == "CIRCLE", "INSERT").otherwise(F.col("etype"))
    return entities(s, d).select("file_id", "layer", inserts.alias("etype"), F.when(k % 3 > 0, name("LT", k % 3)).alias("linetype"), name("#", F.col("y").cast("long") % 4).alias("colour"), name("B", k % 5).alias("block"), F.when(k % 2 == 0, F.array(name("T", k % 4), name("T", k % 7))).alias("tags"))


def boxed(s, d):
    """plots' boxes, moved outwards by their own distances."""
    wide = G.buffered(G.bounds(ring()), (F.col("plot_id") % 40).cast("double"))
    return parcels(s, d).select("plot_id", *(wide[c].alias(c) for c in ("x0", "y0", "x1", "y1")))


QUERIES = {
    "g9_box_buffer": boxed,
    "a8_layer_details": lambda s, d: C.layer_details(detailed(s, d)),
    "t4_polygon_features": lambda s, d: C.polygon_features(entities(s, d)),
    "g1_g5_ring_measures": ring_measures,
    "g7_g8_ring_checks": ring_checks,
    "s10_typed_vertices": typed_vertices,
    "j2_spatial_relations": lambda s, d: O.relations(features(s, d), parcels(s, d)),
    "j7_building_split": lambda s, d: O.relations(features(s, d).where("layer_key LIKE '%building'"), parcels(s, d)).where("intersects_plot OR within_site").select("feature_id", "plot_id", F.when(F.col("intersects_plot"), "existing").otherwise("adjacent").alias("kind")),
    "g21_zone_areas": lambda s, d: O.zone_areas(parcels(s, d), features(s, d)),
    "g22_buildable_area": lambda s, d: O.buildable(parcels(s, d), features(s, d)),
    "a12_site_summary": lambda s, d: O.site_summary(features(s, d)),
    "a13_constraint_counts": lambda s, d: O.constraint_counts(features(s, d), kinds(s, d)),
    "j1_parcel_linkage": lambda s, d: O.linked(requests(s, d), parcels(s, d)),
    "t1_top_twenty": lambda s, d: O.linked(requests(s, d), parcels(s, d), 20).select("request_id", "plot_id", "rank"),
    "g18_footprint_limits": lambda s, d: O.footprint_limits(parcels(s, d), (F.col("plot_id") % 130).cast("double"), F.when(F.col("plot_id") % 5 != 0, (F.col("plot_id") % 90).cast("double"))).withColumn("limit", F.round("limit", 6)),
    "g20_footprint_variants": lambda s, d: O.variants(parcels(s, d)).withColumn("footprint", F.round("footprint", 6)),
    "a8_layer_summary": lambda s, d: C.layer_summary(entities(s, d)),
    "a16_layer_signature": lambda s, d: C.signatures(entities(s, d)),
    "a9_drawing_bounds": boxes,
    "g12_drawing_units": units,
    "g13_normalised": lambda s, d: C.normalised(entities(s, d), boxes(s, d), units(s, d)).groupBy("file_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1")).withColumn("x1", F.when(F.col("x1") < 1e6, F.round("x1", 3)).otherwise(F.round(F.log10("x1"), 9))),
    "a10_layer_hints": lambda s, d: C.layer_hints(entities(s, d), boxes(s, d)),
    "a18_parcel_layers": lambda s, d: C.parcel_layers(entities(s, d), C.layer_hints(entities(s, d), boxes(s, d))),
    "t6_boundary_candidates": candidates,
    "t5_main_boundary": lambda s, d: C.main_boundary(candidates(s, d)),
    "j3_nearest_label": lambda s, d: C.nearest_label(entities(s, d)),
}
REL = """, f AS (SELECT feature_id, layer_key, fx0, fy0, fx0 + w AS fx1, fy0 + h AS fy1 FROM f_features), rel AS (SELECT feature_id, layer_key, p.plot_id, fx0 >= x0 AND fx1 <= x1 AND fy0 >= y0 AND fy1 <= y1 AS within_plot, fx0 <= x1 AND fx1 >= x0 AND fy0 <= y1 AND fy1 >= y0 AS intersects_plot, fx0 >= x0 - 30 AND fx1 <= x1 + 30 AND fy0 >= y0 - 30 AND fy1 <= y1 + 30 AS within_site
  FROM f JOIN f_parcels p ON fx0 <= x1 + 30 AND fx1 >= x0 - 30 AND fy0 <= y1 + 30 AND fy1 >= y0 - 30)"""
ZONES = """, z0 AS (SELECT plot_id, fx0, fy0, fx0 + w AS fx1, fy0 + h AS fy1, CASE layer_key WHEN 'water_pipe' THEN 1.5 WHEN 'gas_pipe' THEN 3.0 WHEN 'tree' THEN 3.5 WHEN 'no_build_zone' THEN 0.0 WHEN 'flood_zone' THEN 0.0 END AS dd, CASE layer_key WHEN 'tree' THEN 'root_protection_zone' WHEN 'water_pipe' THEN 'utility_protection_zone' WHEN 'gas_pipe' THEN 'utility_protection_zone' ELSE layer_key END AS kind FROM f_features),
z1 AS (SELECT *, unnest(range(CAST(ceil(fx0 - dd - 0.5) AS BIGINT), CAST(floor(fx1 + dd - 0.5) AS BIGINT) + 1)) AS ix FROM z0 WHERE dd IS NOT NULL), z2 AS (SELECT *, unnest(range(CAST(ceil(fy0 - dd - 0.5) AS BIGINT), CAST(floor(fy1 + dd - 0.5) AS BIGINT) + 1)) AS iy FROM z1),
z AS (SELECT DISTINCT plot_id, kind, ix, iy FROM z2 WHERE pow(greatest(fx0 - ix - 0.5, 0, ix + 0.5 - fx1), 2) + pow(greatest(fy0 - iy - 0.5, 0, iy + 0.5 - fy1), 2) <= dd * dd)"""


def cells(name, shrink):
    return f", {name}1 AS (SELECT plot_id, y0, y1, unnest(range(CAST(ceil(x0 + {shrink} - 0.5) AS BIGINT), CAST(floor(x1 - {shrink} - 0.5) AS BIGINT) + 1)) AS ix FROM f_parcels), {name} AS (SELECT plot_id, ix, unnest(range(CAST(ceil(y0 + {shrink} - 0.5) AS BIGINT), CAST(floor(y1 - {shrink} - 0.5) AS BIGINT) + 1)) AS iy FROM {name}1)"


LINK = """, r AS (SELECT doc_id AS request_id, CAST(doc_id % 499 + 1 AS VARCHAR) || '/' || CAST(doc_id % 7 + 1 AS VARCHAR) AS number, lpad(CAST(doc_id % 97 + 1 AS VARCHAR), 4, '0') AS precinct, split_part('Radomiu,Szczecinku,Ciechanowie,Warszawie', ',', CAST(doc_id % 4 + 1 AS INT)) AS locality FROM documents),
c AS (SELECT request_id, plot_id, CAST(60 * CAST(number = parcel_number AS INT) + 25 * CAST(r.precinct = p.precinct AS INT) + 25 * CAST(r.locality = p.locality AS INT) AS INT) AS score FROM r JOIN f_parcels p ON number = parcel_number OR (r.precinct = p.precinct AND r.locality = p.locality)),
k AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, plot_id))"""
BOX = ", b AS (SELECT file_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM f_entities GROUP BY 1)"
UNIT = BOX + f""", n(code, name, scale) AS (VALUES {", ".join(f"({a}, '{b}', CAST({c!r} AS DOUBLE))" for a, b, c in C.UNITS)}), u AS (SELECT b.*, coalesce(n.name, CASE WHEN hyp > 10000 THEN 'mm' WHEN hyp > 1000 THEN 'cm' ELSE 'm' END) AS unit, coalesce(n.scale, CASE WHEN hyp > 10000 THEN 0.001 WHEN hyp > 1000 THEN 0.01 ELSE 1.0 END) AS scale, CASE WHEN n.code IS NULL THEN 'heuristic' ELSE 'header' END AS source
  FROM (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS hyp FROM b) b LEFT JOIN n ON n.code = b.file_id % 24)"""
HINT = BOX + ", l AS (SELECT file_id, layer, bool_or(closed) AS c, avg(w * h) FILTER (closed) AS m, count(*) FILTER (closed) AS n_closed FROM f_entities GROUP BY 1, 2), s AS (SELECT file_id, layer, n_closed, CASE WHEN regexp_matches(lower(layer), 'dzialk|działk|parcel|plot|granica|boundary') THEN 2 ELSE 0 END + CAST(c AS INT) + CASE WHEN m >= greatest(25.0, 0.002 * ((x1 - x0) * (y1 - y0))) THEN 1 ELSE 0 END AS score FROM l JOIN b USING (file_id)), h AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, layer) AS rank FROM s)"
TELL = "regexp_matches(lower(layer), 'dzialka|działka|dzialki|granica|granice|boundary|parcel|plot|egb|egib|kontur')"
CAND = BOX + f""", e AS (SELECT DISTINCT file_id, layer, x, y, w, h, w * h AS area FROM f_entities WHERE closed AND w > 0 AND h > 0), g AS (SELECT e.*, (x1 - x0) * (y1 - y0) AS m, area >= greatest(1.0, 0.05 * ((x1 - x0) * (y1 - y0))) AS large FROM e JOIN b USING (file_id)),
a AS (SELECT *, bool_or(large) OVER (PARTITION BY file_id) AS al FROM g), t AS (SELECT *, max(area) OVER (PARTITION BY file_id) AS top, area / m AS r, 4 * pi() * area / pow(2 * (w + h), 2) AS q FROM a WHERE large OR NOT al),
sc AS (SELECT *, round(CASE WHEN {TELL} THEN 2.0 ELSE 0.0 END + 1.0 + area / top + CASE WHEN r <= 0 THEN 0.0 WHEN r > 0.9 OR r < 0.0001 THEN -0.4 WHEN r >= 0.01 AND r <= 0.6 THEN 0.4 WHEN r < 0.01 THEN 0.15 ELSE 0.1 END + CASE WHEN q < 0.05 THEN -0.2 WHEN q > 0.7 THEN 0.25 WHEN q > 0.2 THEN 0.15 ELSE 0.0 END + CASE WHEN file_id % 4 = 0 AND layer = 'Budynek' THEN 1.0 ELSE 0.0 END, 9) AS score FROM t),
rk AS (SELECT *, row_number() OVER o AS rank, count(*) OVER (PARTITION BY file_id) AS n, lead(score) OVER o AS nxt FROM sc WINDOW o AS (PARTITION BY file_id ORDER BY score DESC, area DESC, layer, x, y, w, h)),
cd AS (SELECT file_id, layer, x, y, w, h, round(score, 6) AS score, rank, round(CASE WHEN rank = 1 THEN CASE WHEN n = 1 THEN CASE WHEN {TELL} THEN 1.0 ELSE 0.85 END ELSE least(1.0, least(0.95, 0.5 + (score - nxt) / 2) + CASE WHEN {TELL} THEN 0.1 ELSE 0.0 END) END END, 6) AS confidence FROM rk)"""
R3 = "CAST(round({0}, 3) AS VARCHAR)"
NEAREST = ", s AS (SELECT DISTINCT file_id, x, y, w, h FROM f_entities WHERE closed AND etype <> 'TEXT'), t AS (SELECT DISTINCT file_id, x AS tx, y AS ty, layer AS label FROM f_entities WHERE etype = 'TEXT'), j AS (SELECT s.*, label, tx, ty, round(sqrt(pow(x + w / 2 - tx, 2) + pow(y + h / 2 - ty, 2)), 6) AS distance FROM s JOIN t USING (file_id)), nn AS (SELECT file_id, x, y, w, h, label, distance FROM j QUALIFY row_number() OVER (PARTITION BY file_id, x, y, w, h ORDER BY distance, label, tx, ty) = 1)"
DETAILS = """, e AS (SELECT file_id, layer, CASE etype WHEN 'CIRCLE' THEN 'INSERT' ELSE etype END AS etype, CAST(x AS BIGINT) AS k, CAST(y AS BIGINT) AS m FROM f_entities),
n AS (SELECT file_id, layer, 'l' AS kind, 'LT' || (k % 3) AS name FROM e WHERE k % 3 > 0 UNION SELECT file_id, layer, 'c', '#' || (m % 4) FROM e UNION SELECT file_id, layer, 'b', 'B' || (k % 5) FROM e WHERE etype = 'INSERT'
  UNION SELECT file_id, layer, 'a', 'T' || unnest([k % 4, k % 7]) FROM e WHERE etype = 'INSERT' AND k % 2 = 0)"""
NAMES = lambda kind, name: f"coalesce(string_agg(name, ',' ORDER BY name) FILTER (kind = '{kind}'), '') AS {name}"
ORACLE = {
    "g9_box_buffer": oracle("f_parcels", "SELECT plot_id, x0 - plot_id % 40 AS x0, y0 - plot_id % 40 AS y0, x1 + plot_id % 40 AS x1, y1 + plot_id % 40 AS y1 FROM f_parcels"),
    "a8_layer_details": oracle("f_entities", DETAILS + f" SELECT file_id, layer, {NAMES('l', 'line_types')}, {NAMES('c', 'colours')}, {NAMES('b', 'blocks')}, {NAMES('a', 'attributes')} FROM n GROUP BY 1, 2"),
    "g1_g5_ring_measures": oracle("f_parcels", "SELECT plot_id, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, (x0 + x1) / 2 AS mx, x1 - x0 AS span, true AS inside, false AS outside, round(pi() * (x1 - x0) * (y1 - y0) / pow(x1 - x0 + y1 - y0, 2), 9) AS compact, 4.0 AS distance FROM f_parcels"),
    "g7_g8_ring_checks": oracle("f_parcels", f", t AS (SELECT plot_id, {R3.format('x0')} AS a, {R3.format('y0')} AS b, {R3.format('x1')} AS c, {R3.format('y1')} AS d FROM f_parcels) SELECT plot_id, CASE plot_id % 4 WHEN 0 THEN 'fewer than 3 points;no area' WHEN 1 THEN 'edge of no length;repeated point;crosses itself' ELSE '' END AS errors, CASE WHEN plot_id % 4 = 0 THEN a || ' ' || b || ',' || c || ' ' || b ELSE a || ' ' || b || ',' || c || ' ' || b || ',' || c || ' ' || d || ',' || a || ' ' || d END AS ring FROM t"),
    "s10_typed_vertices": oracle("f_parcels", "SELECT plot_id, CASE WHEN plot_id % 3 <> 0 THEN (x1 - x0) * (y1 - y0) / 2 END AS area, CASE WHEN plot_id % 3 <> 0 THEN x1 - x0 END AS width FROM f_parcels"),
    "j2_spatial_relations": oracle("f_parcels f_features", REL + " SELECT feature_id, plot_id, within_plot, intersects_plot, within_site FROM rel"),
    "j7_building_split": oracle("f_parcels f_features", REL + " SELECT feature_id, plot_id, CASE WHEN intersects_plot THEN 'existing' ELSE 'adjacent' END AS kind FROM rel WHERE layer_key LIKE '%building' AND (intersects_plot OR within_site)"),
    "g21_zone_areas": oracle("f_parcels f_features", ZONES + cells("pc", 0) + " SELECT plot_id, kind, CAST(count(*) AS DOUBLE) AS area FROM pc JOIN z USING (plot_id, ix, iy) GROUP BY 1, 2"),
    "g22_buildable_area": oracle("f_parcels f_features", ZONES + cells("ic", 4) + ", fr AS (SELECT plot_id, CAST(count(*) AS DOUBLE) AS free FROM ic ANTI JOIN z USING (plot_id, ix, iy) GROUP BY 1) SELECT plot_id, (x1 - x0) * (y1 - y0) AS plot_area, coalesce(free, 0.0) AS buildable_area, CASE WHEN free > 0 THEN 0.9 ELSE 0.6 END AS candidate_score FROM f_parcels LEFT JOIN fr USING (plot_id)"),
    "a12_site_summary": oracle("f_features", "SELECT plot_id, count(*) FILTER (layer_key LIKE '%building') AS buildings, count(*) FILTER (layer_key LIKE '%pipe') AS networks, count(*) FILTER (layer_key = 'road_edge') AS roads, count(DISTINCT layer_key) AS layers, bool_or(layer_key = 'flood_zone') AS has_flood, bool_or(layer_key = 'tree') AS has_trees FROM f_features GROUP BY 1"),
    "a13_constraint_counts": oracle("f_features", ", k(kind) AS (VALUES " + ", ".join(f"('{x}')" for x in (*O.RESTRICTED, "tree")) + ") SELECT p.plot_id, kind, count(f.feature_id) AS n FROM (SELECT DISTINCT plot_id FROM f_features) p CROSS JOIN k LEFT JOIN f_features f ON f.plot_id = p.plot_id AND f.layer_key = kind GROUP BY 1, 2"),
    "j1_parcel_linkage": oracle("f_parcels", LINK + " SELECT request_id, plot_id, score, rank, rank = 1 AND score - nxt <= 5 AS ambiguous FROM k"),
    "t1_top_twenty": oracle("f_parcels", LINK + " SELECT request_id, plot_id, rank FROM k WHERE rank <= 20"),
    "g18_footprint_limits": oracle("f_parcels", ", a AS (SELECT plot_id, (x1 - x0) * (y1 - y0) AS area FROM f_parcels) SELECT plot_id, area, round(least(area * least(100, plot_id % 130) / 100, area * (1 - CASE WHEN plot_id % 5 <> 0 THEN plot_id % 90 ELSE 30 END / 100)), 6) AS \"limit\" FROM a"),
    "g20_footprint_variants": oracle("f_parcels", ", s(share) AS (SELECT unnest([0.0, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.2, 0.22, 0.24, 0.26, 0.28, 0.3, 0.32, 0.34, 0.36, 0.38, 0.4, 0.42, 0.44, 0.46, 0.48])), v AS (SELECT plot_id, CAST(share AS DOUBLE) AS share, (x1 - x0) * (y1 - y0) * 30 / 100 AS lim, x1 - x0 - 8 AS w, y1 - y0 - 8 AS h FROM f_parcels CROSS JOIN s), f AS (SELECT plot_id, share, (w - 2 * share * least(w, h)) * (h - 2 * share * least(w, h)) AS footprint, lim FROM v WHERE w > 0 AND h > 0) SELECT plot_id, arg_max(share, footprint) AS share, round(max(footprint), 6) AS footprint FROM f WHERE footprint > 0 AND footprint <= lim GROUP BY 1"),
    "a8_layer_summary": oracle("f_entities", ", t AS (SELECT file_id, layer, etype, count(*) AS n FROM f_entities GROUP BY 1, 2, 3) SELECT file_id, layer, CAST(sum(n) AS BIGINT) AS n, string_agg(etype || '=' || n, ',' ORDER BY etype) AS types, CASE layer WHEN 'DZIALKI' THEN 'plot' WHEN 'droga_A' THEN 'road' WHEN 'Budynek' THEN 'building' WHEN 'woda' THEN 'water' WHEN 'GAZ' THEN 'gas' WHEN 'egb_granica' THEN 'plot' ELSE 'other' END AS class FROM t GROUP BY 1, 2"),
    "a16_layer_signature": oracle("f_entities", "SELECT file_id, array_to_string(list_sort(list(DISTINCT lower(layer))), '|') AS signature FROM f_entities GROUP BY 1"),
    "a9_drawing_bounds": oracle("f_entities", BOX + " SELECT * FROM b"),
    "g12_drawing_units": oracle("f_entities", UNIT + " SELECT file_id, unit, scale, source FROM u"),
    "g13_normalised": oracle("f_entities", UNIT + " SELECT file_id, n, x0, CASE WHEN x1 < 1e6 THEN round(x1, 3) ELSE round(log10(x1), 9) END AS x1 FROM (SELECT e.file_id, count(*) AS n, min((x - x0) * scale) AS x0, max((x - x0) * scale + w * scale) AS x1 FROM f_entities e JOIN u USING (file_id) GROUP BY 1)"),
    "a10_layer_hints": oracle("f_entities", HINT + " SELECT file_id, layer, score, rank FROM h WHERE rank <= 8"),
    "a18_parcel_layers": oracle("f_entities", HINT + ", m AS (SELECT *, max(score) OVER (PARTITION BY file_id) AS best, max(n_closed) OVER (PARTITION BY file_id) AS most FROM h WHERE rank <= 8) SELECT file_id, layer FROM m WHERE (best > 0 AND score = best) OR (best <= 0 AND n_closed = most)"),
    "t6_boundary_candidates": oracle("f_entities", CAND + " SELECT * FROM cd"),
    "t5_main_boundary": oracle("f_entities", CAND + ", o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w * h DESC, rank) AS k, max(confidence) OVER (PARTITION BY file_id) AS sure FROM cd) SELECT file_id, layer, x, y, w, h, CASE WHEN sure >= 0.8 THEN 'COMPLETED' ELSE 'NEEDS_REVIEW' END AS status FROM o WHERE k = 1"),
    "j3_nearest_label": oracle("f_entities", NEAREST + " SELECT * FROM nn"),
    "t4_polygon_features": oracle("f_entities", NEAREST + ", c AS (SELECT DISTINCT file_id, layer, x, y, w, h FROM f_entities WHERE closed AND etype <> 'TEXT'), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY layer, x, y, w, h) AS INT) AS rank FROM c) SELECT file_id, layer, x, y, w, h, w * h AS area, 2 * (w + h) AS perimeter, label, distance, rank FROM r LEFT JOIN nn USING (file_id, x, y, w, h) WHERE rank <= 200"),
}
