"""Queries over boundaries, rings, picks, typed values and nested listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from ..operators import boundary as B
from ..operators import overlay as O
from ..operators.extraction import CATALOGUE
from ..operators.register import active_of
from ..sources.gml import gml_features
from .fixtures import oracle, spread, view
from .space_queries import CAND, LINK, ZONES, candidates, cells, entities, features, parcels, requests, ring


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def loose_segments(s, d):
    """Each plot's sides as segments of two layers, one end a little off; every fifth plot lacks a side."""
    side = lambda n, layer, ax, ay, bx, by: F.struct(F.lit(n).alias("n"), F.lit(layer).alias("layer"), (F.col(ax) + 0.003).alias("ax"), F.col(ay).alias("ay"), F.col(bx).alias("bx"), (F.col(by) - 0.002).alias("by"))
    sides = F.array(side(0, "A", "x0", "y0", "x1", "y0"), side(1, "B", "x1", "y1", "x1", "y0"), side(2, "A", "x1", "y1", "x0", "y1"), side(3, "B", "x0", "y0", "x0", "y1"))
    return parcels(s, d).select("plot_id", F.floor(F.col("plot_id") / 20).alias("file_id"), F.inline(sides)).where("plot_id % 5 <> 0 OR n <> 2").drop("plot_id", "n")


def ring_building(s, d):
    r = F.col("ring")
    return B.rings(loose_segments(s, d)).select("file_id", "layer", F.size(r).alias("points"), F.round(G.area(r), 3).alias("area"), F.round(G.bounds(r)["x0"], 3).alias("x0"), F.round(G.bounds(r)["y0"], 3).alias("y0"))


def insets(s, d):
    widths = F.array((F.col("plot_id") % 3 + 1).cast("double"), (F.col("plot_id") % 4 + 1).cast("double"), F.lit(None).cast("double"), F.lit(2.0))
    r = F.col("inset")
    out = B.inset(parcels(s, d).withColumn("ring", ring()).withColumn("widths", widths), "ring", "widths")
    return out.select("plot_id", F.round(G.area(r), 6).alias("area"), F.round(G.bounds(r)["x0"], 6).alias("x0"), F.round(G.bounds(r)["y0"], 6).alias("y0"), F.round(G.bounds(r)["x1"], 6).alias("x1"), F.round(G.bounds(r)["y1"], 6).alias("y1"))


def sites(s, d):
    """Plots and their sites, which don't hold every seventh plot; every eleventh plot has no site."""
    by = F.when(F.col("plot_id") % 7 == 0, -5.0).otherwise(30.0)
    site = F.when(F.col("plot_id") % 11 != 0, G.rectangle(F.col("x0") - by, F.col("y0") - by, F.col("x1") + by, F.col("y1") + by))
    return parcels(s, d).select("plot_id", ring().alias("plot"), site.alias("site"))


def shapes(s, d):
    return features(s, d).where("geom_type = 'Polygon'").select("feature_id", "plot_id", G.rectangle("fx0", "fy0", "fx1", "fy1").alias("shape"))


def land_use(s, d):
    line = F.col("geom_type") == "LineString"
    shape = F.when(line, F.array(G.point(F.col("fx0"), F.col("fy0")), G.point(F.col("fx1"), F.col("fy1")))).otherwise(G.rectangle("fx0", "fy0", "fx1", "fy1"))
    return features(s, d).where("geom_type <> 'Point'").select("feature_id", "plot_id", line.alias("is_line"), (F.col("layer_key") == "existing_building").alias("is_building"), shape.alias("shape"))


def point_sets(s, d):
    """Each feature's box against its plot: clipped points, halves by the plot's diagonal, the common box, the plot's rest."""
    j = shapes(s, d).join(sites(s, d).hint("merge"), "plot_id")
    half = G.split_by_line(F.col("plot"), F.get("plot", F.lit(0)), F.get("plot", F.lit(1)))
    return j.select("feature_id", F.size(G.clipped(F.col("shape"), F.col("plot"))).alias("on_plot"), F.size(F.get(half, F.lit(0))).alias("half"), G.area(G.united(F.array("plot", "shape"))).alias("box"), F.size(G.difference(F.col("plot"), F.col("shape"))).alias("rest"))


def either_key(s, d):
    k = F.col("plot_id")
    plots = parcels(s, d).select("plot_id", (k % 40).alias("project_id"), F.col("parcel_number").alias("parcel_id"), F.when(k % 3 == 0, F.concat(F.lit("x"), (k % 90).cast("string"))).otherwise(F.col("parcel_number")).alias("external_ref"))
    doc = F.col("doc_id")
    wanted = F.when(doc % 2 == 0, F.concat(F.lit("x"), (doc % 90).cast("string"))).otherwise(F.concat((doc % 499 + 1).cast("string"), F.lit("/"), (doc % 7 + 1).cast("string")))
    return B.either_key(table(s, d, "documents").select(doc.alias("request_id"), (doc % 40).alias("project_id"), wanted.alias("wanted"), (doc % 5 < 2).alias("has_geometry")), plots)


def jobs(s, d):
    """Each drawing's import job with its boundary candidates and the selected one."""
    c = candidates(s, d).select("file_id", "rank", "layer")
    out = B.nested(entities(s, d).select("file_id").distinct(), c, "file_id", ["rank"], "candidates")
    return out.select("file_id", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["layer"])), ",").alias("told"), F.get("candidates", F.lit(0))["layer"].alias("selected"))


def uploads(s, d):
    """Each upload with its extracted rows."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    out = B.nested(table(s, d, "orders").select(F.col("o_orderkey").alias("upload_id")), rows, "upload_id", ["line"], "fields")
    return out.select("upload_id", F.size("fields").alias("n"), F.array_join(F.transform("fields", lambda x: F.concat_ws(":", x["line"].cast("string"), x["flag"])), ",").alias("told"))


def reasons(s, d):
    e = entities(s, d).select("file_id", F.concat_ws("/", "layer", "etype").alias("reason"), (F.col("y") * 1000 + F.col("x")).alias("place"))
    return B.first_distinct(e, "file_id", "reason", "place").select("file_id", F.array_join("reasons", ",").alias("reasons"))


def typed_values(s, d):
    p = table(s, d, "part")
    n = F.col("p_size").cast("string")
    kinds = [F.concat(F.lit('{"a": '), n, F.lit("}")), F.concat(F.lit("["), n, F.lit(", 1]")), F.lit("true"), n, F.concat(n, F.lit(".25")), F.concat(F.lit('"'), n, F.lit(' m"')), F.lit("null"), F.concat(n, F.lit(" m"))]
    value, kind = V.typed(F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int")))
    return p.select("p_partkey", value.alias("value"), kind.alias("kind"))


def form_rows(s, d):
    p = table(s, d, "part")
    size = F.concat(F.col("p_size").cast("string"), F.lit(",5"))
    form = F.create_map(F.lit("ridge"), F.when(F.col("p_partkey") % 3 == 0, "high").otherwise(size), F.lit("city"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")), F.lit("unknown"), F.lit("x"))
    row = V.form_columns(form, {"ridge": "ridge_height", "city": "locality", "roof": "roof_type"}, {"ridge_height"})
    return p.select("p_partkey", row["ridge_height"].alias("ridge_height"), row["locality"].alias("locality"), F.size(row).alias("n"))


def source_kinds(s, d):
    k = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    status, kind = pick(("manual_placeholder", "derived", "imported"), k % 3), pick(("analysis", "reference", "geoportal", "odd"), k % 4)
    return table(s, d, "part").select("p_partkey", V.source_kind(status, kind).alias("kind"))


def external(s, d):
    doc = F.col("doc_id")
    docs = table(s, d, "documents").select("doc_id")
    told = F.array(*(F.struct(F.lit(k).alias("field_key"), F.when((doc + i) % 3 != 0, (doc + i).cast("string")).alias("value"), F.when(doc % 2 == 0, "cm").otherwise("").alias("unit"), F.when((doc + i) % 4 == 0, 0.5).alias("confidence")) for i, k in enumerate(("maxBuildingHeightM", "primaryPurpose"))))
    return B.merged_external(docs.select("doc_id", F.inline(told)), docs, CATALOGUE)


def names(s, d):
    k = F.col("p_partkey")
    n = (k % 90).cast("string")
    street = F.concat(F.lit(" Kwiatowa  "), n, F.element_at(F.array(*map(F.lit, (" 00-950 Warszawa", " gmina Rajec", ", lok. 3", " w dzielnicy Wola", " OBRĘB 7 ."))), (k % 5 + 1).cast("int")))
    place = F.element_at(F.array(*map(F.lit, ("Warszawskie dawniej Warszawie", "Radom gm. Rajec", "Bielin, Wola", " Ciechanów. ", "Szczecinek 78-400 x"))), (k % 5 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", T.street_name(street).alias("street"), T.place_name(place).alias("place"))


def normal_texts(s, d):
    """F18 over whole pages with line ends and dashes of other kinds."""
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\r\n\r\n  a – b\t c  "))
    out = T.normal_text(text)
    return view(s, d, "f_pages").select("doc_id", F.md5(out).alias("md5"), F.length(out).alias("n_chars"))


def on_warning(s, d):
    """Every third request lacks a number, so that plots of one precinct and locality tie."""
    asked = requests(s, d).withColumn("number", F.when(F.col("request_id") % 3 != 0, F.col("number")))
    return B.on_warning(O.linked(asked, parcels(s, d), 3)).select("request_id", "plot_id", "rank")


def gml(s, d):
    """S3: bodies with one member, several dimensions, coordinates, featureMembers, and a ring that is too short."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    points = F.element_at(F.array(*(F.lit(x) for x in ("<gml:posList>0 0 {s} 0 {s} 10 0 10</gml:posList>", '<gml:posList srsDimension="3">0 0 5 {s} 0 5 {s} 10 5 0 10 5 0 0 5</gml:posList>', "<gml:coordinates>0,0 {s},0 {s},10 0,10</gml:coordinates>", "<gml:posList>0 0 {s} 0 {s} 10</gml:posList>"))), (k % 4 + 1).cast("int"))
    one = lambda n: F.concat(F.lit(f'<ms:plot gml:id="p{n}.'), k.cast("string"), F.lit('"><gml:boundedBy>x</gml:boundedBy><ms:nr>'), (k % 499 + 1).cast("string"), F.lit(" &amp; 1</ms:nr><ms:empty/><ms:geom><gml:Polygon><gml:exterior><gml:LinearRing>"), F.replace(points, F.lit("{s}"), size), F.lit("</gml:LinearRing></gml:exterior></gml:Polygon></ms:geom></ms:plot>"))
    single = lambda n: F.concat(F.lit("<gml:featureMember>"), one(n), F.lit("</gml:featureMember>"))
    inner = F.when(k % 3 == 0, F.concat(F.lit("<gml:featureMembers>"), one(0), one(1), F.lit("</gml:featureMembers>"))).when(k % 3 == 1, single(0)).otherwise(F.concat(single(0), single(1)))
    bodies = spread(table(s, d, "part")).select(k.alias("payload_id"), F.concat(F.lit('<wfs:FeatureCollection xmlns:gml="g">'), inner, F.lit("</wfs:FeatureCollection>")).alias("body"))
    r = F.get("rings", F.lit(0))
    return gml_features(bodies).select("payload_id", "n", "id", F.col("properties")["nr"].alias("nr"), F.size("properties").alias("n_properties"), F.size(r).alias("points"), G.area(r).alias("area"))


def variant_links(s, d):
    """Precincts with a prefix and localities in capitals or with marks that the register lacks."""
    r = F.col("request_id")
    precinct = F.when(r % 3 == 0, F.concat(F.lit("obr. 3-"), "precinct")).when(r % 3 == 1, F.regexp_replace("precinct", "^0+", "")).otherwise(F.col("precinct"))
    locality = F.when(r % 5 == 0, F.upper("locality")).when(r % 5 == 1, F.translate("locality", "o", "ó")).otherwise(F.col("locality"))
    return O.linked(requests(s, d).withColumn("precinct", precinct).withColumn("locality", locality), parcels(s, d))


def recomputed(s, d):
    """The stored contexts of two of three plots, analysed anew from the stored layers."""
    stored = parcels(s, d).where("plot_id % 3 <> 0").withColumn("version", (F.col("plot_id") % 4).cast("int"))
    return O.buildable(stored, features(s, d)).join(stored.select("plot_id", "version").hint("merge"), "plot_id").select("plot_id", (F.col("version") + 1).alias("version"), "buildable_area")


QUERIES = {
    "g15_g16_j8_ring_building": ring_building,
    "g19_variable_inset": insets,
    "g6_j14_relation_checks": lambda s, d: B.relation_checks(sites(s, d), shapes(s, d)),
    "a15_boundary_summary": lambda s, d: B.boundary_summary(sites(s, d), land_use(s, d)),
    "u5_point_sets": point_sets,
    "t9_plot_pick": lambda s, d: B.plot_pick(entities(s, d)),
    "t2_on_warning": on_warning,
    "j1_precinct_variants": variant_links,
    "t7_newest_projects": lambda s, d: active_of(view(s, d, "f_projects")).select("project_id", "user_id", "created_at").orderBy(F.desc("created_at"), F.desc("project_id")),
    "j16_either_key": either_key,
    "j17_job_candidates": jobs,
    "j18_upload_rows": uploads,
    "a19_reason_lists": reasons,
    "a20_recomputed": recomputed,
    "u1_layer_union": lambda s, d: B.union_layers({"parcels": parcels(s, d).select("plot_id", "parcel_number"), "features": features(s, d).select("plot_id", "feature_id")}),
    "p12_typed_values": typed_values,
    "p13_form_rows": form_rows,
    "p16_source_kinds": source_kinds,
    "p22_external_results": external,
    "f18_normal_text": normal_texts,
    "s3_gml_features": gml,
    "f19_names": names,
}
SITE = ", s AS (SELECT *, CASE WHEN plot_id % 7 = 0 THEN -5 ELSE 30 END AS r, plot_id % 11 <> 0 AS has FROM f_parcels), f AS (SELECT *, fx0 + w AS fx1, fy0 + h AS fy1 FROM f_features)"
ON = "{0} >= x0 - {2} AND {0} < x1 + {2} AND {1} >= y0 - {2} AND {1} < y1 + {2}"
INSIDE = " AND ".join(ON.format(x, y, "{0}") for x in ("fx0", "fx1") for y in ("fy0", "fy1"))
N_ON = " + ".join(f"CAST({ON.format(x, y, '0')} AS INT)" for x in ("fx0", "fx1") for y in ("fy0", "fy1"))
N_CUT = " + ".join(f"CAST({x} >= fx0 AND {x} < fx1 AND {y} >= fy0 AND {y} < fy1 AS INT)" for x in ("x0", "x1") for y in ("y0", "y1"))
MEET = f"""(((y0 BETWEEN fy0 AND fy1 OR y1 BETWEEN fy0 AND fy1) AND (fx0 BETWEEN x0 AND x1 OR fx1 BETWEEN x0 AND x1)) OR ((fy0 BETWEEN y0 AND y1 OR fy1 BETWEEN y0 AND y1) AND (x0 BETWEEN fx0 AND fx1 OR x1 BETWEEN fx0 AND fx1))
  OR ({ON.format('fx0', 'fy0', '0')}) OR (x0 >= fx0 AND x0 < fx1 AND y0 >= fy0 AND y0 < fy1))"""
HAS_PLOT = "(has AND r > 0)"
UNNUMBERED = LINK.replace("SELECT doc_id AS request_id, CAST(", "SELECT doc_id AS request_id, CASE WHEN doc_id % 3 <> 0 THEN '' END || CAST(").replace("CAST(number = parcel_number AS INT)", "CAST(coalesce(number = parcel_number, false) AS INT)")
ORACLE = {
    "g15_g16_j8_ring_building": oracle("f_parcels", "SELECT CAST(floor(plot_id / 20) AS BIGINT) AS file_id, CASE WHEN x1 - x0 >= y1 - y0 THEN 'A' ELSE 'B' END AS layer, 4 AS points, round((x1 - x0) * (y1 - y0), 3) AS area, x0, y0 FROM f_parcels WHERE plot_id % 5 <> 0"),
    "g19_variable_inset": oracle("f_parcels", ", i AS (SELECT plot_id, x0 + 2 AS x0, y0 + plot_id % 3 + 1 AS y0, x1 - plot_id % 4 - 1 AS x1, y1 - 3 AS y1 FROM f_parcels) SELECT plot_id, (x1 - x0) * (y1 - y0) AS area, x0, y0, x1, y1 FROM i"),
    "g6_j14_relation_checks": oracle("f_parcels f_features", SITE + f" SELECT feature_id, s.plot_id, {HAS_PLOT} AS site_contains_plot, ({INSIDE.format('0')}) OR (has AND {INSIDE.format('r')}) AS in_range, {MEET} AS useful FROM f JOIN s USING (plot_id) WHERE geom_type = 'Polygon'"),
    "a15_boundary_summary": oracle("f_parcels f_features", SITE + f""", j AS (SELECT feature_id, s.plot_id, geom_type = 'LineString' AS line, layer_key = 'existing_building' AS building, w * h AS area, {N_ON} AS n_on FROM f JOIN s USING (plot_id) WHERE geom_type <> 'Point'),
k AS (SELECT *, count(*) FILTER (line) OVER (PARTITION BY plot_id ORDER BY feature_id DESC ROWS UNBOUNDED PRECEDING) AS later FROM j), g AS (SELECT plot_id, count(*) FILTER (line) AS cuts, coalesce(sum(pow(2, later)) FILTER (NOT line AND n_on >= 3), 0) AS parts, count(*) FILTER (building) AS zones, sum(area) FILTER (building) AS zoned FROM k GROUP BY 1)
SELECT plot_id, (x1 - x0) * (y1 - y0) AS plot_area, 2 * (x1 - x0 + y1 - y0) AS plot_perimeter, {HAS_PLOT} AS site_contains_plot, CAST(pow(2, coalesce(cuts, 0)) + coalesce(parts, 0) AS BIGINT) AS split_count, CASE WHEN coalesce(zones, 0) > 0 THEN zoned ELSE (x1 - x0) * (y1 - y0) END AS buildable_area FROM s LEFT JOIN g USING (plot_id)"""),
    "u5_point_sets": oracle("f_parcels f_features", SITE + f" SELECT feature_id, {N_ON} AS on_plot, 4 AS half, (greatest(x1, fx1) - least(x0, fx0)) * (greatest(y1, fy1) - least(y0, fy0)) AS box, CASE WHEN NOT {MEET} THEN 4 WHEN fx0 <= x0 AND fx1 >= x1 THEN 0 ELSE 4 - ({N_CUT}) END AS rest FROM f JOIN s USING (plot_id) WHERE geom_type = 'Polygon'"),
    "t9_plot_pick": oracle("f_entities", ", r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN layer IN ('DZIALKI', 'egb_granica') THEN 0 ELSE 1 END, w * h DESC, layer, x, y, w, h) AS k FROM f_entities WHERE etype = 'LWPOLYLINE' AND closed), b AS (SELECT file_id, min(x) FILTER (d) AS x0, min(y) FILTER (d) AS y0, max(x + w) FILTER (d) AS x1, max(y + h) FILTER (d) AS y1 FROM (SELECT *, etype IN ('LWPOLYLINE', 'LINE') AS d FROM f_entities) GROUP BY 1) SELECT b.file_id, layer, x, y, w, h, x0, y0, x1, y1 FROM b LEFT JOIN r ON r.file_id = b.file_id AND k = 1 AND w * h > 0"),
    "t2_on_warning": oracle("f_parcels", UNNUMBERED + ", a AS (SELECT request_id FROM k WHERE rank = 1 AND score - nxt <= 5) SELECT request_id, plot_id, rank FROM k SEMI JOIN a USING (request_id) WHERE rank <= 3"),
    "j1_precinct_variants": oracle("f_parcels", LINK + " SELECT request_id, plot_id, score, rank, rank = 1 AND score - nxt <= 5 AS ambiguous FROM k"),
    "t7_newest_projects": oracle("f_projects", "SELECT project_id, user_id, created_at FROM f_projects WHERE deleted_at IS NULL ORDER BY created_at DESC, project_id DESC"),
    "j16_either_key": oracle("f_parcels", """, p AS (SELECT plot_id, plot_id % 40 AS project_id, parcel_number AS a, CASE WHEN plot_id % 3 = 0 THEN 'x' || plot_id % 90 ELSE parcel_number END AS b FROM f_parcels),
q AS (SELECT doc_id AS request_id, doc_id % 40 AS project_id, CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id % 90 ELSE (doc_id % 499 + 1) || '/' || (doc_id % 7 + 1) END AS wanted FROM documents), m AS (SELECT request_id, (SELECT min(plot_id) FROM p WHERE p.project_id = q.project_id AND (a = wanted OR b = wanted)) AS plot_id FROM q)
SELECT request_id, plot_id, CASE WHEN plot_id IS NULL THEN 'insert' WHEN request_id % 5 < 2 THEN 'update' ELSE 'keep' END AS action FROM m"""),
    "j17_job_candidates": oracle("f_entities", CAND + " SELECT file_id, CAST(count(rank) AS INT) AS n, coalesce(string_agg(rank || ':' || layer, ',' ORDER BY rank), '') AS told, max(layer) FILTER (rank = 1) AS selected FROM (SELECT DISTINCT file_id FROM f_entities) LEFT JOIN cd USING (file_id) GROUP BY 1"),
    "j18_upload_rows": "SELECT o_orderkey AS upload_id, CAST(count(l_orderkey) AS INT) AS n, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS told FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "a19_reason_lists": oracle("f_entities", ", g AS (SELECT file_id, layer || '/' || etype AS reason, min(y * 1000 + x) AS place FROM f_entities GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY place, reason) AS k FROM g) SELECT file_id, string_agg(reason, ',' ORDER BY k) AS reasons FROM r WHERE k <= 6 GROUP BY 1"),
    "a20_recomputed": oracle("f_parcels f_features", ZONES + cells("ic", 4) + ", fr AS (SELECT plot_id, CAST(count(*) AS DOUBLE) AS free FROM ic ANTI JOIN z USING (plot_id, ix, iy) GROUP BY 1) SELECT plot_id, CAST(plot_id % 4 + 1 AS INT) AS version, coalesce(free, 0.0) AS buildable_area FROM f_parcels LEFT JOIN fr USING (plot_id) WHERE plot_id % 3 <> 0"),
    "u1_layer_union": oracle("f_parcels f_features", "SELECT plot_id, parcel_number, 'parcels' AS layer_name, NULL::BIGINT AS feature_id FROM f_parcels UNION ALL SELECT plot_id, NULL, 'features', feature_id FROM f_features"),
    "p12_typed_values": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '{"a": ' || p_size || '}' WHEN 1 THEN '[' || p_size || ', 1]' WHEN 2 THEN 'true' WHEN 3 THEN '' || p_size WHEN 4 THEN p_size || '.25' WHEN 6 THEN NULL ELSE p_size || ' m' END AS value, split_part('JSON,JSON,BOOLEAN,INTEGER,NUMBER,TEXT,TEXT,TEXT', ',', CAST(p_partkey % 8 + 1 AS INT)) AS kind FROM part""",
    "p13_form_rows": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size || '.5' END AS ridge_height, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS locality, 2 AS n FROM part",
    "s3_gml_features": "SELECT p_partkey AS payload_id, n, 'p' || n || '.' || p_partkey AS id, (p_partkey % 499 + 1) || ' & 1' AS nr, 1 AS n_properties, CASE WHEN p_partkey % 4 = 2 THEN 4 ELSE 5 END AS points, p_size * 10.0 AS area FROM part, (VALUES (0), (1)) k(n) WHERE p_partkey % 4 <> 3 AND (n = 0 OR p_partkey % 3 <> 1)",
    "p16_source_kinds": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'placeholder' WHEN p_partkey % 3 = 1 OR p_partkey % 4 = 0 THEN 'derived' ELSE 'imported' END AS kind FROM part",
    "p22_external_results": "WITH k(field_key, own, i) AS (VALUES " + ", ".join(f"('{key}', {repr(unit) if unit else 'NULL'}, {({'maxBuildingHeightM': '0', 'primaryPurpose': '1'}).get(key, 'NULL')})" for key, unit in CATALOGUE) + ") SELECT doc_id, field_key, CASE WHEN (doc_id + i) % 3 <> 0 THEN CAST(doc_id + i AS VARCHAR) END AS value, CASE WHEN i IS NOT NULL AND doc_id % 2 = 0 THEN 'cm' ELSE own END AS unit, CASE WHEN (doc_id + i) % 3 <> 0 THEN CASE WHEN (doc_id + i) % 4 = 0 THEN 0.5 ELSE 0.75 END ELSE 0.0 END AS confidence, CASE WHEN (doc_id + i) % 3 <> 0 THEN 'EXTRACTED' ELSE 'REQUIRES_REVIEW' END AS status FROM documents CROSS JOIN k",
    "f18_normal_text": oracle("f_pages", r""", t AS (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10)) || chr(13) || chr(10) || chr(13) || chr(10) || '  a – b' || chr(9) || ' c  ' AS t FROM f_pages), a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g'), '[‐‑‒–—−]', '-', 'g') AS t FROM t), o AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '\n{2,}', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM a) SELECT doc_id, md5(t) AS md5, CAST(length(t) AS INT) AS n_chars FROM o"""),
    "f19_names": "SELECT p_partkey, 'Kwiatowa ' || p_partkey % 90 || CASE WHEN p_partkey % 5 = 3 THEN ' w' ELSE '' END AS street, split_part('Warszawa,Radom,Bielin,Ciechanów,Szczecinek', ',', CAST(p_partkey % 5 + 1 AS INT)) AS place FROM part",
}
