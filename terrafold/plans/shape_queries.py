"""Queries over plots and features of any shape: rectangles, triangles and L-shapes made of the parcels' boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import overlay as O
from ..operators import runs as R
from .fixtures import oracle, spread
from .space_queries import ZONES, features, kinds, parcels


def shaped(s, d):
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    at = lambda x, y: G.point(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)
    triangle = F.array(at("x0", "y0"), at("x1", "y0"), at("x0", "y1"))
    corner = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", my), at(mx, my), at(mx, "y1"), at("x0", "y1"))
    return spread(parcels(s, d)).select("plot_id", F.when(F.col("plot_id") % 3 == 0, G.rectangle("x0", "y0", "x1", "y1")).when(F.col("plot_id") % 3 == 1, triangle).otherwise(corner).alias("ring"), "x0", "y0", "x1", "y1")


def drawn(s, d):
    """Features as points, lines, triangles and, now and then, nothing."""
    x, y = F.col("fx0") + 0.25, F.col("fy0") + 0.25
    points = [G.point(x, y), G.point(x + F.col("w") + 1.5, y), G.point(x, y + F.col("h") + 1.5)]
    k = F.col("feature_id") % 11
    return features(s, d).select("feature_id", "plot_id", "layer_key", F.when(k == 0, F.lit(None)).when(k < 3, F.array(*points[:1])).when(k < 6, F.array(*points[:2])).otherwise(F.array(*points)).alias("shape"))


def sets(s, d):
    moved = G.rectangle(F.col("x0") + 5, F.col("y0") + 7, F.col("x1") + 5, F.col("y1") + 7)
    return R.set_areas(shaped(s, d).withColumn("other", moved), "ring", "other")


def constraints(s, d):
    own = O.constraint_counts(features(s, d), kinds(s, d))
    return own.unionByName(O.utility_collisions(drawn(s, d), shaped(s, d)))


QUERIES = {
    "u4_shape_sets": sets,
    "g10_site_buffer": lambda s, d: R.buffered_areas(shaped(s, d), "ring", F.element_at(F.array(F.lit(0.0), F.lit(10.0), F.lit(None).cast("double")), (F.col("plot_id") % 3 + 1).cast("int")), 2.0),
    "g21_shape_zones": lambda s, d: R.zone_areas_on(shaped(s, d), "ring", features(s, d)),
    "g22_shape_envelopes": lambda s, d: R.buildable_zones(shaped(s, d), "ring", features(s, d)),
    "j2_shape_relations": lambda s, d: O.ring_relations(drawn(s, d), shaped(s, d)),
    "a13_collisions": constraints,
}
SHAPES = """, s AS (SELECT *, CASE plot_id % 3 WHEN 0 THEN [x0, x1, x1, x0] WHEN 1 THEN [x0, x1, x0] ELSE [x0, x1, x1, (x0 + x1) / 2, (x0 + x1) / 2, x0] END AS xs, CASE plot_id % 3 WHEN 0 THEN [y0, y0, y1, y1] WHEN 1 THEN [y0, y0, y1] ELSE [y0, y0, (y0 + y1) / 2, (y0 + y1) / 2, y1, y1] END AS ys FROM f_parcels),
e AS (SELECT plot_id, xs[i] AS ax, ys[i] AS ay, xs[i % len(xs) + 1] AS bx, ys[i % len(xs) + 1] AS ey FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM s))"""
#: Of a point (x, y) and the edges: how often they cross its row to the right, whether it is on one, its least distance.
SEEN = """count(*) FILTER ((ay > y) <> (ey > y) AND ax + (y - ay) * (bx - ax) / (ey - ay) > x) % 2 = 1 AS odd, bool_or((ay > y) <> (ey > y) AND abs(ax + (y - ay) * (bx - ax) / (ey - ay) - x) <= 1e-9) AS upon,
  min(sqrt(pow(x - ax - greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / (pow(bx - ax, 2) + pow(ey - ay, 2)))) * (bx - ax), 2) + pow(y - ay - greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / (pow(bx - ax, 2) + pow(ey - ay, 2)))) * (ey - ay), 2))) AS dist"""


def grid(margin, res):
    box = lambda c, extra: f"range(CAST(floor(({c}0 - {margin}) / {res}) AS BIGINT), CAST(ceil(({c}1 + {margin} + {extra}) / {res}) AS BIGINT))"
    return f""", g1 AS (SELECT plot_id, y0, y1, unnest({box('x', 5)}) AS ix FROM s), g AS (SELECT plot_id, ix, unnest({box('y', 7)}) AS iy FROM g1), c AS (SELECT plot_id, ix, iy, (ix + 0.5) * {res} AS x, (iy + 0.5) * {res} AS y FROM g),
seen AS (SELECT c.plot_id, ix, iy, x, y, {SEEN} FROM c JOIN e USING (plot_id) GROUP BY c.plot_id, ix, iy, x, y)"""


SHAPE_POINTS = """, fs AS (SELECT feature_id, plot_id AS site, layer_key, fx0 + 0.25 AS x, fy0 + 0.25 AS y, w + 1.5 AS w, h + 1.5 AS h, feature_id % 11 AS k FROM f_features),
fp AS (SELECT feature_id, site, layer_key, CASE WHEN k < 3 THEN [x] WHEN k < 6 THEN [x, x + w] ELSE [x, x + w, x] END AS px, CASE WHEN k < 3 THEN [y] WHEN k < 6 THEN [y, y] ELSE [y, y, y + h] END AS py FROM fs WHERE k > 0),
fe AS (SELECT feature_id, px[i] AS cx, py[i] AS cy, px[i % len(px) + 1] AS dx, py[i % len(px) + 1] AS dy FROM (SELECT *, unnest(range(1, len(px) + 1)) AS i FROM fp)),
near AS (SELECT feature_id, site, layer_key, plot_id, px, py FROM fp JOIN s ON list_min(px) <= x1 + 30 AND list_max(px) >= x0 - 30 AND list_min(py) <= y1 + 30 AND list_max(py) >= y0 - 30),
pts AS (SELECT feature_id, plot_id, i, x, y, """ + SEEN + """ FROM (SELECT feature_id, plot_id, unnest(range(len(px))) AS i, unnest(px) AS x, unnest(py) AS y FROM near) JOIN e USING (plot_id) GROUP BY feature_id, plot_id, i, x, y),
held AS (SELECT feature_id, plot_id, bool_and(odd) AS all_in, bool_or(odd AND i = 0) AS first_in, bool_and(odd OR dist <= 30) AS around FROM pts GROUP BY 1, 2),
crossing AS (SELECT near.feature_id, near.plot_id, bool_or(abs(t) >= 1e-9 AND ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / t BETWEEN 0 AND 1 AND ((cx - ax) * (ey - ay) - (cy - ay) * (bx - ax)) / t BETWEEN 0 AND 1) AS crosses
  FROM near JOIN fe USING (feature_id) JOIN (SELECT * FROM e) ee ON ee.plot_id = near.plot_id, LATERAL (SELECT (bx - ax) * (dy - cy) - (ey - ay) * (dx - cx) AS t) GROUP BY 1, 2),
back AS (SELECT near.feature_id, near.plot_id, count(*) FILTER ((cy > ys[1]) <> (dy > ys[1]) AND cx + (ys[1] - cy) * (dx - cx) / (dy - cy) > xs[1]) % 2 = 1 AS held_in FROM near JOIN fe USING (feature_id) JOIN s ON s.plot_id = near.plot_id GROUP BY 1, 2),
rel AS (SELECT feature_id, plot_id, all_in AND NOT crosses AS within_plot, crosses OR first_in OR held_in AS intersects_plot, around AS within_site FROM held JOIN crossing USING (feature_id, plot_id) JOIN back USING (feature_id, plot_id))"""
ORACLE = {
    "u4_shape_sets": oracle("f_parcels", SHAPES + grid(0, 1) + """, m AS (SELECT plot_id, odd OR upon AS p, x >= x0 + 5 AND x <= x1 + 5 AND y >= y0 + 7 AND y <= y1 + 7 AS q FROM seen JOIN s USING (plot_id))
SELECT plot_id, CAST(nullif(count(*) FILTER (p OR q), 0) AS DOUBLE) AS "both", CAST(nullif(count(*) FILTER (p AND q), 0) AS DOUBLE) AS common, CAST(nullif(count(*) FILTER (p AND NOT q), 0) AS DOUBLE) AS rest FROM m GROUP BY 1"""),
    "g10_site_buffer": oracle("f_parcels", SHAPES + grid(32, 2.0) + " SELECT plot_id, 4.0 * count(*) AS area FROM seen WHERE odd OR upon OR dist <= CASE plot_id % 3 WHEN 1 THEN 10 ELSE 30 END + 1e-9 GROUP BY 1"),
    "g21_shape_zones": oracle("f_parcels f_features", SHAPES + grid(0, 1) + ZONES + " SELECT plot_id, kind, CAST(count(*) AS DOUBLE) AS area FROM seen JOIN z USING (plot_id, ix, iy) WHERE odd OR upon GROUP BY 1, 2"),
    "g22_shape_envelopes": oracle("f_parcels f_features", SHAPES + grid(0, 1) + ZONES + """, own AS (SELECT * FROM seen WHERE odd OR upon), fr AS (SELECT plot_id, ix, iy FROM own ANTI JOIN z USING (plot_id, ix, iy) WHERE dist >= 4 - 1e-9),
k(dx, dy) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)), inner_ AS (SELECT plot_id, ix, iy FROM (SELECT plot_id, ix + dx AS ix, iy + dy AS iy FROM fr CROSS JOIN k) GROUP BY 1, 2, 3 HAVING count(*) = 9),
n AS (SELECT plot_id, CAST(count(*) AS DOUBLE) AS plot_area FROM own GROUP BY 1), b AS (SELECT plot_id, CAST(count(*) AS DOUBLE) AS b FROM fr GROUP BY 1), i AS (SELECT plot_id, CAST(count(*) AS DOUBLE) AS i FROM inner_ GROUP BY 1)
SELECT plot_id, plot_area, coalesce(b, 0.0) AS buildable_area, coalesce(b, plot_area) AS envelope_area, coalesce(i, b, plot_area) AS preferred_area FROM n LEFT JOIN b USING (plot_id) LEFT JOIN i USING (plot_id)"""),
    "j2_shape_relations": oracle("f_parcels f_features", SHAPES + SHAPE_POINTS + " SELECT * FROM rel WHERE intersects_plot OR within_site UNION ALL SELECT feature_id, NULL, NULL, NULL, NULL FROM fs WHERE k = 0"),
    "a13_collisions": oracle("f_parcels f_features", SHAPES + SHAPE_POINTS + ", k(kind) AS (VALUES " + ", ".join(f"('{x}')" for x in (*O.RESTRICTED, "tree")) + """) SELECT p.plot_id, kind, count(f.feature_id) AS n FROM (SELECT DISTINCT plot_id FROM f_features) p CROSS JOIN k LEFT JOIN f_features f ON f.plot_id = p.plot_id AND f.layer_key = kind GROUP BY 1, 2
UNION ALL SELECT plot_id, 'utility_collision', count(*) FROM rel JOIN fp USING (feature_id) WHERE plot_id = site AND intersects_plot AND layer_key LIKE '%pipe' GROUP BY 1"""),
}
