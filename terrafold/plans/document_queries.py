"""Queries over page text, payloads and streams, and the flagship from text to footprints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction as E
from ..operators import overlay as O
from ..operators.register import single_parcel
from ..sources import payloads as S
from ..streaming import jobs as J
from . import register_queries
from .fixtures import oracle, spread, view


def pages(s, d):
    return spread(view(s, d, "f_pages"))


def payloads(s, d):
    """Whole bodies of four kinds, told apart by the id's remainder by 4: good, broken, pages, and empty or featureless ones."""
    good, pages_ = view(s, d, "f_payloads"), s.read.parquet(f"{d}/pages.parquet")
    kind = lambda c, k: (F.col(c) * 4 + k).alias("payload_id")
    broken = good.where("payload_id % 10 = 0").select(kind("payload_id", 1), F.substr("body", F.lit(1), F.lit(40)).alias("body"))
    odd = pages_.where("page_id % 9 < 2").select(kind("page_id", 3), F.when(F.col("page_id") % 9 == 0, "").otherwise('{"a":1}').alias("body"))
    return good.select(kind("payload_id", 0), "body").unionByName(broken).unionByName(pages_.select(kind("page_id", 2), F.col("html").alias("body"))).unionByName(odd)


def replies(s, d):
    p = view(s, d, "f_parcels")
    wkt = F.format_string("POLYGON((%d %d,%d %d,%d %d))", *(F.col(c).cast("int") for c in ("x0", "y0", "x1", "y0", "x1", "y1")))
    id_ = F.concat(F.lit("1412_1."), F.col("precinct"), F.lit("."), F.replace("parcel_number", F.lit("/"), F.lit("_")))
    reply = F.when(F.col("plot_id") % 3 == 0, F.concat(F.lit('{"id":"'), id_, F.lit('","geom_wkt":"'), wkt, F.lit('"}'))).when(F.col("plot_id") % 3 == 1, F.concat(wkt, F.lit("|"), id_)).otherwise(F.concat(F.lit("0103000020AB;"), F.lit("plain "), F.col("plot_id").cast("string")))
    a, b, c = S.parcel_reply(F.col("reply"), F.lit("asked"))
    ring = S.wkt_ring(F.col("wkt"))
    return p.select("plot_id", reply.alias("reply")).select("plot_id", a.alias("id"), b.alias("wkb"), c.alias("wkt")).select("plot_id", "id", "wkb", "wkt", F.size(ring).alias("points"), F.get(ring, F.lit(1))["x"].alias("second_x"))


def flagship(s, d) -> DataFrame:
    """Documents' limits on their parcels: text to fields, to a register parcel, to the footprint's limit; the 20 largest."""
    rules = E.plan_rules(pages(s, d))
    precinct = E.references(pages(s, d), E.PRECINCT, "precinct").where("pos = 0").select("doc_id", "precinct")
    asked = rules.join(precinct.hint("merge"), "doc_id").where("parcel IS NOT NULL").select(F.col("doc_id").alias("request_id"), F.col("parcel").alias("number"), "precinct", "height", "bio", "coverage")
    parcels = view(s, d, "f_parcels")
    exact = asked.join(parcels.select("plot_id", F.col("parcel_number").alias("number"), F.col("precinct").alias("p_precinct"), "x0", "y0", "x1", "y1").hint("merge"), "number").where("precinct = p_precinct")
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col(c), F.lit(30.0))))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    limit = F.round(F.least(area * share("coverage") / 100, area * (1 - share("bio") / 100)), 6)
    return exact.select(F.col("request_id").alias("doc_id"), "plot_id", "height", area.alias("area"), limit.alias("limit")).orderBy(F.desc("limit"), "doc_id", "plot_id").limit(20)


def scratch(s) -> str:
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and not s.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def calls_stream(s, d, files=1):
    e = J.read_table(s, d, "events", files)
    return e.select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.element_at(F.array(F.lit("ULDK"), F.lit("WFS"), F.lit("KIEG")), (F.col("user_id") % 3 + 1).cast("int")).alias("source"), (F.col("event_type") != "error").alias("ok"))


def files(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("plan."), F.element_at(F.array(*map(F.lit, ("PDF", "png", "exe", "dxf"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "text/plain").when(F.col("p_partkey") % 4 == 0, "application/pdf").when(F.col("p_partkey") % 4 == 1, "image/png").otherwise("application/dxf").alias("media_type"), ((F.col("p_partkey") % 30) * (1 << 20)).alias("size"))


WINDOW_COLUMNS = ("doc_id", "n", "radius", "score", "has_footer", "qualified")
QUERIES = {
    "flagship_plan_footprints": flagship,
    "p2_planning_fields": lambda s, d: E.fields(pages(s, d)).select("doc_id", "field_key", "value_num", "value_text", "unit", "confidence", "status"),
    "p5a_parcel_references": lambda s, d: E.references(pages(s, d), E.PARCEL, "parcel"),
    "p5b_precinct_references": lambda s, d: E.references(pages(s, d), E.PRECINCT, "precinct"),
    "a5_single_parcel": lambda s, d: single_parcel(E.references(pages(s, d), E.PARCEL_LABEL, "parcel")),
    "w1_context_windows": lambda s, d: E.windows(pages(s, d)),
    "w2_window_scores": lambda s, d: E.scored(E.windows(pages(s, d))).select(*WINDOW_COLUMNS),
    "w3_subject_window": lambda s, d: E.subject_window(pages(s, d)).select("doc_id", "n", "radius", "text"),
    "s1_page_scan": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f")).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page"), F.length("text").alias("n")),
    "s2_features": lambda s, d: S.features(payloads(s, d)).select("payload_id", "n", "number", "geom_type"),
    "s4_payload_format": lambda s, d: S.parsed_collections(payloads(s, d)).select("payload_id", "format", "error"),
    "s5_s6_parcel_replies": replies,
    "s7_exported": lambda s, d: S.exported(view(s, d, "f_features"), "plot_id"),
    "s8_decoded": lambda s, d: payloads(s, d).select("payload_id", S.decoded(F.col("body"))[1].alias("raw")),
    "s9_upload_check": lambda s, d: S.eligible(files(s, d)).select("p_partkey", "reject_reason"),
    "t_1_success_stream": lambda s, d: J.drained_updates(J.success_rates(calls_stream(s, d, None)), ["source", "begin"], scratch(s)),
    "t_3_debounced": lambda s, d: J.debounced(view(s, d, "f_edits")).withColumn("value", F.round("value", 6)),
    "t_4_circuit_stream": lambda s, d: J.drained_batches(calls_stream(s, d, None), J.circuit_states(at := scratch(s)), at).select("call_id", "failures", "is_open"),
    "t_5_rate_limit_stream": lambda s, d: J.drained_batches(calls_stream(s, d, None), J.rate_limits(at := scratch(s), most=3, seconds=600), at),
}
LINES = ", r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM f_pages), l AS (SELECT doc_id, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM r WHERE trim(line) <> ''), w AS (SELECT a.doc_id, 1 AS page, a.n, k.radius, string_agg(b.line, chr(10) ORDER BY b.n) AS text FROM l a CROSS JOIN (VALUES (1), (2)) k(radius) JOIN l b ON b.doc_id = a.doc_id AND abs(b.n - a.n) <= k.radius GROUP BY ALL)"
#: Word borders as Spark's patterns have them (any script's letters), for DuckDB, whose own know only ASCII.
A, Z = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
SCORES = rf""", g AS (SELECT *, lower(text) AS t FROM w), h AS (SELECT *, (regexp_matches(t, 'dzia[łl]k') OR regexp_matches(t, '{A}dz\.[\p{{L}}\p{{N}}_]')) AND regexp_matches(t, 'ewid|ew\.|nr\s+dzia[łl]k') AS p, regexp_matches(t, '[o0]br[eę]b|{A}obr\.[\p{{L}}\p{{N}}_]') AS o, regexp_matches(t, 'po[łl]o[zż]on') AS loc,
  regexp_matches(t, '{A}przy\s+ul|{A}rejonie\s+ul|{A}ul\.\s+[a-ząćęłńóśźż]') AS st, regexp_matches(text, '{A}w\s+[A-ZĄĆĘŁŃÓŚŹŻ]') OR regexp_matches(t, '{A}(?:warszawa|radom|szczecinek|ciechan[óo]w){Z}') AS city,
  regexp_matches(text, 'po[łl]o[zż]on[\p{{L}}\p{{N}}_]*[^\n]{{0,40}}{A}w\s+[A-ZĄĆĘŁŃÓŚŹŻ]') AS near, regexp_matches(t, 'po[łl]o[zż]enie\s+nieruchomo') AS pos,
  regexp_matches(t, '{A}(?:urz[aą]d|wydzia[łl]|tel|fax|e-?mail|www|bip|krs|nip|regon|\d{{2}}-\d{{3}}){Z}') AS foot FROM g),
sc AS (SELECT *, CASE WHEN p THEN 5 ELSE 0 END + CASE WHEN o THEN 4 ELSE 0 END + CASE WHEN loc THEN 3 ELSE 0 END + CASE WHEN st THEN 2 ELSE 0 END + CASE WHEN near THEN 2 ELSE 0 END + CASE WHEN p AND o AND (city OR loc OR st OR pos) THEN 4 ELSE 0 END - CASE WHEN foot THEN 10 ELSE 0 END AS score FROM h)"""
PAY = ", y AS (SELECT 4 * payload_id AS payload_id, body FROM f_payloads UNION ALL SELECT 4 * payload_id + 1, substr(body, 1, 40) FROM f_payloads WHERE payload_id % 10 = 0 UNION ALL SELECT 4 * page_id + 2, html FROM pages UNION ALL SELECT 4 * page_id + 3, CASE page_id % 9 WHEN 0 THEN '' ELSE '{\"a\":1}' END FROM pages WHERE page_id % 9 < 2)"
PARCEL_NO = "CAST(doc_id % 499 + 1 AS VARCHAR) || '/' || CAST(doc_id % 7 + 1 AS VARCHAR)"
RULES = f", f AS (SELECT doc_id, {PARCEL_NO} AS number, lpad(CAST(doc_id % 97 + 1 AS VARCHAR), 4, '0') AS precinct, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 9 + 6.5 END AS height, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 8 * 5 + 20 END AS bio, doc_id % 6 * 5 + 15 AS coverage FROM documents)"
CALLS = ", c AS (SELECT call_id, ts, source, ok FROM f_calls)"
#: A value's clean form, and the fields' and references' patterns run by DuckDB's own expressions over the pages' text.
CLEAN = r"nullif(trim(regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[,:;.)]+$', '')), '')"


def quoted(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def reference_sql(pattern: str, name: str) -> str:
    return f" SELECT doc_id, page, pos, {CLEAN.format('raw')} AS {name} FROM (SELECT doc_id, page, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, page, regexp_extract_all(text, {quoted(pattern)}, 1) AS l FROM f_pages)) WHERE {CLEAN.format('raw')} IS NOT NULL"


def field_sql() -> str:
    parts, first = [], {}
    for key, pattern, kind, unit, confidence in E.FIELDS:
        value = {"number": "TRY_CAST(replace(v, ',', '.') AS DOUBLE)", "count": "TRY_CAST(v AS DOUBLE)"}.get(kind, "CAST(NULL AS DOUBLE)")
        text = {"text": CLEAN.format("v"), "lower": "lower(trim(v))", "upper": "upper(v)", "line": "nullif(trim(v), '')"}.get(kind, "CAST(NULL AS VARCHAR)")
        sure = f"({value if kind in ('number', 'count') else text} IS NOT NULL" + (f" AND contains(raw, '{unit}'))" if unit and unit != "@" else ")")
        shown = "u" if unit == "@" else f"'{unit}'" if unit else "CAST(NULL AS VARCHAR)"
        other = f" AND NOT regexp_matches(text, {quoted(first[key])})" if key in first else ""
        parts.append(f"SELECT doc_id, '{key}' AS field_key, CASE WHEN {sure} THEN {value} END AS value_num, CASE WHEN {sure} THEN {text} END AS value_text, {shown} AS unit, CASE WHEN {sure} THEN {confidence} ELSE 0.0 END AS confidence, CASE WHEN {sure} THEN 'EXTRACTED' ELSE 'REQUIRES_REVIEW' END AS status FROM (SELECT doc_id, regexp_extract(text, {quoted(pattern)}, 0) AS raw, regexp_extract(text, {quoted(pattern)}, 1) AS v, {f'regexp_extract(text, {quoted(pattern)}, 2)' if unit == '@' else 'NULL'} AS u FROM f_pages WHERE regexp_matches(text, {quoted(pattern)}){other})")
        first.setdefault(key, pattern)
    return " " + " UNION ALL ".join(parts)


FIELD_SQL = field_sql()
ORACLE = {
    "flagship_plan_footprints": oracle("f_parcels", RULES + " SELECT doc_id, plot_id, CAST(height AS DOUBLE) AS height, (x1 - x0) * (y1 - y0) AS area, round(least((x1 - x0) * (y1 - y0) * coverage / 100, (x1 - x0) * (y1 - y0) * (1 - coalesce(bio, 30) / 100)), 6) AS \"limit\" FROM f JOIN f_parcels p ON number = parcel_number AND f.precinct = p.precinct ORDER BY \"limit\" DESC, doc_id, plot_id LIMIT 20"),
    "p2_planning_fields": oracle("f_pages", FIELD_SQL),
    "p5a_parcel_references": oracle("f_pages", reference_sql(E.PARCEL, "parcel")),
    "p5b_precinct_references": oracle("f_pages", reference_sql(E.PRECINCT, "precinct")),
    "a5_single_parcel": oracle("f_pages", r" SELECT doc_id, CASE WHEN len(list_distinct(l)) = 1 THEN l[1] END AS parcel FROM (SELECT doc_id, regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])ewid(?:\.|encyjn[\p{L}\p{N}_]+)?\s*(?:nr\s*)?(\d+(?:/\d+)?[a-z]?)', 1) AS l FROM f_pages) WHERE len(l) > 0"),
    "w1_context_windows": oracle("f_pages", LINES + " SELECT * FROM w"),
    "w2_window_scores": oracle("f_pages", LINES + SCORES + " SELECT doc_id, n, radius, score, foot AS has_footer, p AND o AS qualified FROM sc"),
    "w3_subject_window": oracle("f_pages", LINES + SCORES + " SELECT doc_id, n, radius, text FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p AND o DESC, foot, score DESC, n, radius) = 1"),
    "s1_page_scan": "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents) SELECT doc_id, page, length(t) AS n FROM p",
    "s2_features": oracle("f_payloads", PAY + " SELECT payload_id, 0 AS n, json_extract_string(body, '$.features[0].properties.numer_dzialki') AS number, json_extract_string(body, '$.features[0].geometry.type') AS geom_type FROM y WHERE payload_id % 4 = 0"),
    "s4_payload_format": oracle("f_payloads", PAY + " SELECT payload_id, CASE WHEN body = '' THEN 'empty' WHEN starts_with(body, '{') THEN 'json' WHEN starts_with(lower(body), '<!doctype html') OR contains(lower(body), '<html') THEN 'html' ELSE 'unknown' END AS format, CASE WHEN body = '' THEN 'empty_response' WHEN starts_with(body, '{') THEN CASE WHEN NOT json_valid(body) THEN 'invalid_json' WHEN json_extract(body, '$.features') IS NULL THEN 'missing_features' END WHEN contains(lower(body), 'html') THEN 'html_response' ELSE 'unsupported' END AS error FROM y"),
    "s5_s6_parcel_replies": oracle("f_parcels", ", a AS (SELECT plot_id, '1412_1.' || precinct || '.' || replace(parcel_number, '/', '_') AS i, 'POLYGON((' || CAST(x0 AS INT) || ' ' || CAST(y0 AS INT) || ',' || CAST(x1 AS INT) || ' ' || CAST(y0 AS INT) || ',' || CAST(x1 AS INT) || ' ' || CAST(y1 AS INT) || '))' AS w, x1 FROM f_parcels) SELECT plot_id, CASE WHEN plot_id % 3 < 2 THEN i ELSE '0103000020AB' END AS id, CASE WHEN plot_id % 3 = 2 THEN '0103000020AB' END AS wkb, CASE WHEN plot_id % 3 < 2 THEN w END AS wkt, CASE WHEN plot_id % 3 < 2 THEN 3 END AS points, CASE WHEN plot_id % 3 < 2 THEN x1 END AS second_x FROM a"),
    "s7_exported": oracle("f_features", """ SELECT plot_id, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","properties":{"layer":"' || layer_key || '","feature_id":"' || feature_id || '"}}', ',' ORDER BY feature_id) || ']}' AS json FROM f_features GROUP BY 1"""),
    "s8_decoded": oracle("f_payloads", PAY + " SELECT payload_id, CASE WHEN NOT json_valid(body) THEN body END AS raw FROM y"),
    "s9_upload_check": "WITH f AS (SELECT p_partkey, p_partkey % 4 AS k, CASE WHEN p_partkey % 5 = 0 THEN 'text/plain' WHEN p_partkey % 4 = 0 THEN 'application/pdf' WHEN p_partkey % 4 = 1 THEN 'image/png' ELSE 'application/dxf' END AS m, (p_partkey % 30) * 1048576 AS s FROM part) SELECT p_partkey, CASE WHEN k = 2 THEN 'EXTENSION' WHEN m <> CASE k WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE 'application/dxf' END THEN 'MEDIA_TYPE' WHEN s <= 0 THEN 'EMPTY' WHEN s > CASE k WHEN 3 THEN 50 ELSE 20 END * 1048576 THEN 'TOO_LARGE' END AS reject_reason FROM f",
    "t_3_debounced": oracle("f_edits", ", g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new FROM f_edits WINDOW w AS (PARTITION BY parcel_id, field_key ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY parcel_id, field_key ORDER BY ts) AS s FROM g) SELECT parcel_id, field_key, round(arg_max(value, ts), 6) AS value, count(*) AS edits, max(ts) AS saved_at FROM n GROUP BY parcel_id, field_key, s"),
    "t_4_circuit_stream": oracle("f_calls", ", r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source ORDER BY ts, call_id) AS run FROM f_calls), f AS (SELECT call_id, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY source, run ORDER BY ts, call_id) AS BIGINT) AS failures FROM r) SELECT call_id, failures, failures >= 5 AS is_open FROM f"),
    "t_1_success_stream": register_queries.ORACLE["t_1_success_windows"],
    "t_4_circuit_stream": register_queries.ORACLE["t_4_circuit"],
}
