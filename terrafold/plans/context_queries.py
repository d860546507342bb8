"""Queries over site contexts and over locations told by free text, with DuckDB SQL where its expressions can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import forms as P
from ..operators import location as L
from ..operators import overlay as O
from .document_queries import pages
from .fixtures import oracle, view
from .space_queries import REL, ZONES, cells, features, parcels


def layered(s, d):
    """Features with their layer's label, group, order, import strategy and kind of source."""
    layers = X.catalogue(s)
    told = layers.select("layer_key", "strategy", X.source_kind(F.col("target_status"), F.col("source_type")).alias("source_kind"))
    return X.enriched(features(s, d), layers).join(F.broadcast(told), "layer_key").select("feature_id", "layer_key", "label", "layer_group", "sort_order", "strategy", "source_kind")  # a fixed list of 60 layers


def objects(s, d):
    """Features that touch a plot's site, tagged; context_id is the plot's."""
    f = features(s, d)
    return X.tagged(O.relations(f, parcels(s, d)).join(f.select("feature_id", "layer_key", "geom_type").hint("merge"), "feature_id").withColumnRenamed("plot_id", "context_id"))


def summaries(s, d):
    found = view(s, d, "f_features").groupBy(F.col("plot_id").alias("context_id"), "layer_key").agg(F.count("*").alias("n"), F.count_if(F.col("feature_id") % 11 == 0).alias("n_bad"))
    return X.import_summary(found)


def exports(s, d):
    analysis = O.buildable(parcels(s, d), features(s, d)).select(F.col("plot_id").alias("context_id"), "buildable_area")
    return X.semantic_export(objects(s, d), analysis)


def locations(s, d):
    return L.locations(pages(s, d)).withColumn("parcels", F.array_join("parcels", ","))


def merged_locations(s, d):
    """Two documents of three are cut in two pages before what tells where the plot lies."""
    told = pages(s, d)
    at = F.when(F.col("doc_id") % 3 > 0, F.expr("locate(' położona', text)")).otherwise(0)
    both = F.array(F.struct(F.lit(1).alias("page"), F.expr("substr(text, 1, at - 1)").alias("text")), F.struct(F.lit(2).alias("page"), F.expr("substr(text, at)").alias("text")))
    cut = told.withColumn("at", at).select("doc_id", F.inline(F.when(F.col("at") > 0, both).otherwise(F.array(F.struct("page", "text")))))
    return L.merged_locations(cut).withColumn("parcels", F.array_join("parcels", ",")).withColumn("sources", F.to_json("sources"))


def sentences(s, d):
    """Every second document writes its plot's and precinct's numbers as a key sentence has them."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace(F.replace("text", F.lit("nr ewid. "), F.lit("nr ew. ")), F.lit("obręb 00"), F.lit("obręb nr 4-05-"))).otherwise(F.col("text"))
    return P.key_sentences(pages(s, d).withColumn("text", text)).drop("page")


def marks(s, d):
    sign, (shown, day) = L.issue_sign(F.col("text")), L.long_date(F.col("text"))
    return pages(s, d).select("doc_id", sign.alias("sign"), shown.alias("shown"), F.date_format(day, "yyyy-MM-dd").alias("day"))


CATALOGUE = ", k(layer_key, label, layer_group, sort_order, strategy, status, kind) AS (VALUES " + ", ".join(
    f"('{key}', '{label}', '{group}', {i}, '{(how := X.strategy(key, able, ()))}', '{X.STRATEGIES[how]}', '{'placeholder' if X.STRATEGIES[how] == 'manual_placeholder' else 'derived' if X.STRATEGIES[how] == 'derived' else X.SOURCE_KINDS.get(source, 'imported')}')"
    for i, (key, label, group, source, _, able) in enumerate(X.LAYERS)
) + ")"
OBJECTS = REL + """, t AS (SELECT feature_id, plot_id AS context_id, layer_key, within_plot, intersects_plot, CASE WHEN within_plot THEN 'on_plot' WHEN intersects_plot THEN 'collision' ELSE 'site_context' END AS plot_relation,
  CASE WHEN layer_key IN ('water_pipe', 'gas_pipe') THEN intersects_plot END AS collision, CASE WHEN layer_key = 'tree' THEN CASE WHEN within_plot THEN 'plot' ELSE 'neighborhood' END END AS tree_context FROM rel),
nt AS (SELECT * FROM t WHERE within_plot OR intersects_plot OR coalesce(collision, false) OR layer_key IN ('adjacent_building', 'no_build_zone', 'flood_zone'))"""
QUERIES = {
    "j4_p15_p16_layered_features": layered,
    "g23_tagged_objects": lambda s, d: objects(s, d).select("feature_id", "context_id", "plot_relation", "collision", "tree_context"),
    "p9_objects_of_note": lambda s, d: X.of_note(objects(s, d)).select("feature_id", "context_id", "layer_key", "plot_relation"),
    "a11_import_summary": summaries,
    "s12_semantic_export": exports,
    "w4_locations": locations,
    "w4_merged_locations": merged_locations,
    "p5c_street_references": lambda s, d: L.street_references(pages(s, d)),
    "p5d_locality_references": lambda s, d: L.locality_references(pages(s, d)),
    "f24_f26_document_marks": marks,
    "p4_flat_form": lambda s, d: P.flat_form(pages(s, d)),
    "p4_form_patterns": lambda s, d: P.pattern_form(pages(s, d)),
    "p6_key_sentences": sentences,
}
#: Word borders as Spark's patterns have them, for DuckDB, whose own know only ASCII.
A, Z = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
CLEAN = r"nullif(trim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[,:;.)]+$', '')), '')"


def form_sql() -> str:
    shape = {"clean": CLEAN.format("{0}"), "upper": "upper({0})", "lower": "lower({0})", "trim": "nullif(trim({0}), '')", "number": "CAST(TRY_CAST(replace({0}, ',', '.') AS DOUBLE) AS VARCHAR)"}
    wide = lambda p: (A + p[2:] if p.startswith(r"\b") else p).replace(r")\b", ")" + Z)
    values: dict[str, list[str]] = {}
    for key, pattern, kind in P.PATTERNS:
        values.setdefault(key, []).append(shape[kind].format(f"nullif(regexp_extract(text, '(?i){wide(pattern)}', 1), '')"))
    rows = " UNION ALL ".join(f"SELECT doc_id, '{key}' AS form_key, coalesce({', '.join(some)}) AS value FROM f_pages" for key, some in values.items())
    return f" SELECT doc_id, form_key, value, CASE WHEN value <> '' AND coalesce(TRY_CAST(value AS DOUBLE), 1) <> 0 THEN 0.7 ELSE 0.0 END AS confidence FROM ({rows})"


SENTENCE_SQL = rf""", t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, 'nr ewid. ', 'nr ew. '), 'obręb 00', 'obręb nr 4-05-') ELSE text END AS text FROM f_pages),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM t),
k AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)działk|dzialk') AND regexp_matches(x, '(?i)obr')), true) AS pos FROM l),
s AS (SELECT *, array_to_string(ls[pos:pos + 2], ' ') AS said FROM k),
r AS (SELECT *, nullif(regexp_extract(said, '(?i){P.SENTENCE["numer_dzialki"]}', 1), '') AS a, nullif(regexp_extract(said, '(?i)obr[ęe]b[\p{{L}}\p{{N}}_]*\s+nr\s*(\d{{1,2}}(?:-\d{{1,2}}){{2}})', 1), '') AS b,
  nullif(regexp_extract(said, '(?i)przy\s+((?:(?:ul|al|pl|os)\.?|(?:ulica|aleja|plac|osiedle))\s*[:\-]?\s*[^,.\n]+?)(?:\s+w{Z}|,|\.|{A}\d{{2}}-\d{{3}}{Z}|$)', 1), '') AS c,
  coalesce(nullif(trim(regexp_extract(text, '{A}\d{{2}}-\d{{3}}\s+{P.NAME}', 1)), ''), regexp_extract_all(said, '{A}w\s+([A-Za-zĄĆĘŁŃÓŚŹŻąęćłńóśźż\-]+)', 1)[-1]) AS d FROM s)
SELECT doc_id, regexp_replace(trim(a), '\s*/\s*', '/', 'g') AS numer_dzialki, trim(b) AS obreb, trim(c, ' ,.;') AS ulica, CASE WHEN lower(d) LIKE 'warszaw%' AND lower(d) LIKE '%wie' THEN 'Warszawa' ELSE trim(d, ' .,') END AS miejscowosc,
  CASE WHEN a IS NULL THEN 0.0 ELSE 0.9 END AS numer_dzialki_confidence, CASE WHEN b IS NULL THEN 0.0 ELSE 0.9 END AS obreb_confidence, CASE WHEN c IS NULL THEN 0.0 ELSE 0.8 END AS ulica_confidence, CASE WHEN d IS NULL THEN 0.0 ELSE 0.7 END AS miejscowosc_confidence, said FROM r"""
ORACLE = {
    "p4_form_patterns": oracle("f_pages", form_sql()),
    "p6_key_sentences": oracle("f_pages", SENTENCE_SQL),
    "j4_p15_p16_layered_features": oracle("f_features", CATALOGUE + " SELECT feature_id, layer_key, label, layer_group, CAST(sort_order AS INT) AS sort_order, strategy, kind AS source_kind FROM f_features JOIN k USING (layer_key)"),
    "g23_tagged_objects": oracle("f_parcels f_features", OBJECTS + " SELECT feature_id, context_id, plot_relation, collision, tree_context FROM t"),
    "p9_objects_of_note": oracle("f_parcels f_features", OBJECTS + " SELECT feature_id, context_id, layer_key, plot_relation FROM nt"),
    "a11_import_summary": oracle("f_features", CATALOGUE + """, g AS (SELECT plot_id AS context_id, layer_key, count(*) AS n, count(*) FILTER (feature_id % 11 = 0) AS b FROM f_features GROUP BY 1, 2),
  e AS (SELECT c.context_id, k.*, n, b, strategy = 'try_direct_import' OR k.layer_key = 'adjacent_building' AS asked FROM (SELECT DISTINCT context_id FROM g) c CROSS JOIN k LEFT JOIN g ON g.context_id = c.context_id AND g.layer_key = k.layer_key),
  st AS (SELECT *, CASE WHEN strategy = 'core_geometry' THEN 'loaded' WHEN asked THEN CASE WHEN n IS NULL THEN 'unavailable' WHEN n = 0 THEN 'empty' WHEN n = b THEN 'error' ELSE 'loaded' END ELSE status END AS s, asked AND coalesce(b, 0) > 0 AS bad FROM e),
  o AS (SELECT context_id, coalesce(string_agg(layer_key, ',' ORDER BY sort_order) FILTER (s = 'loaded'), '') AS loaded, coalesce(string_agg(layer_key, ',' ORDER BY sort_order) FILTER (s = 'empty'), '') AS empty, coalesce(string_agg(layer_key, ',' ORDER BY sort_order) FILTER (s = 'unavailable'), '') AS unavailable,
    coalesce(string_agg(layer_key, ',' ORDER BY sort_order) FILTER (bad), '') AS errors, CAST(sum(CASE WHEN strategy = 'core_geometry' THEN 1 WHEN asked THEN coalesce(n - b, 0) ELSE 0 END) AS BIGINT) AS n_objects FROM st GROUP BY 1)
  SELECT *, CASE WHEN loaded = '' AND empty <> '' THEN 'empty' WHEN loaded = '' AND unavailable = '' THEN 'derived' WHEN unavailable <> '' OR errors <> '' THEN CASE WHEN loaded = '' THEN 'unavailable' ELSE 'error' END ELSE 'loaded' END AS status FROM o"""),
    "s12_semantic_export": oracle("f_parcels f_features", ZONES + cells("ic", 4) + ", fr AS (SELECT plot_id, count(*) AS free FROM ic ANTI JOIN z USING (plot_id, ix, iy) GROUP BY 1)" + OBJECTS + """, la AS (SELECT context_id, layer_key, min(geom_type) AS g, count(*) AS n FROM t JOIN f_features USING (feature_id, layer_key) GROUP BY 1, 2),
  lj AS (SELECT context_id, string_agg('{"layerKey":"' || layer_key || '","geometryType":"' || g || '","featureCount":' || n || '}', ',' ORDER BY layer_key) AS l FROM la GROUP BY 1), oj AS (SELECT context_id, string_agg('{"id":' || feature_id || ',"layerKey":"' || layer_key || '","plotRelation":"' || plot_relation || '"}', ',' ORDER BY feature_id) AS o FROM nt GROUP BY 1)
  SELECT context_id, '{"layers":[' || l || '],"importantObjects":[' || coalesce(o, '') || '],"analysisSummary":{"buildableArea":' || coalesce(free, 0) || ',"hasBuildableArea":' || CASE WHEN free > 0 THEN 'true' ELSE 'false' END || '}}' AS json FROM lj LEFT JOIN oj USING (context_id) LEFT JOIN fr ON fr.plot_id = context_id"""),
    "f24_f26_document_marks": oracle("f_pages", r""", m AS (SELECT doc_id, text, regexp_extract(text, '(?i)(?:^|\n)\s*(?:znak sprawy|sygn\.?|sygnatura)\s*[:\-]?\s*([A-Z0-9./-]{4,})', 1) AS a, regexp_extract(text, '(?i)(?:^|[^\p{L}\p{N}_])(\d{1,2}\s+(?:stycznia|lutego|marca|kwietnia|maja|czerwca|lipca|sierpnia|września|października|listopada|grudnia)\s+\d{4}\s*r?\.?)', 1) AS w FROM f_pages),
  q AS (SELECT doc_id, list_filter(list_transform(string_split(substr(text, 1, 1600), chr(10)), lambda x: regexp_extract(x, '(?i)^\s*([A-Z0-9]{1,8}(?:[-./][A-Z0-9]{1,12}){2,})\s*$', 1)), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]'))[1] AS b FROM f_pages)
  SELECT doc_id, coalesce(nullif(regexp_replace(a, '[,:;.)]+$', ''), ''), b) AS sign, nullif(regexp_replace(trim(regexp_replace(w, '\s+', ' ', 'g')), '[,:;.)]+$', ''), '') AS shown, CASE WHEN w <> '' THEN '2024-05-' || lpad(regexp_extract(w, '^(\d+)', 1), 2, '0') END AS day FROM m JOIN q USING (doc_id)"""),
}
