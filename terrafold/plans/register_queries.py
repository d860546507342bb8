"""Queries over registers, costs, histories and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from ..operators import register as R
from .fixtures import oracle, view


def v(name):
    return lambda spark, sf: view(spark, sf, name)


projects, users, edits, calls, costs, parcels = (v(n) for n in ("f_projects", "f_users", "f_edits", "f_calls", "f_cost_items", "f_parcels"))
CONDITIONS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN repeat('x', 256) ELSE ' U' || CAST(o_orderkey % 9 AS STRING) || ' ' END AS label, CASE o_orderkey % 5 WHEN 0 THEN '9,50' WHEN 1 THEN '-1' WHEN 2 THEN 'abc' ELSE ' ' END AS height,
  CASE o_orderkey % 7 WHEN 0 THEN '91' WHEN 1 THEN '45.5' ELSE '' END AS slope, CASE o_orderkey % 3 WHEN 0 THEN '100' WHEN 1 THEN '100,01' ELSE '30' END AS share, CASE o_orderkey % 4 WHEN 0 THEN '2.5' ELSE '3' END AS storeys FROM orders"""
PAYLOADS = """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '{"city":" R' || CAST(o_orderkey % 90 AS STRING) || ' ","max_building_height":"' || CAST(o_orderkey % 30 AS STRING) || ',5"}' WHEN 1 THEN '{"max_building_height":"-' || CAST(o_orderkey % 3 AS STRING) || '"}'
  WHEN 2 THEN '{"services_allowed":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE '"true"' END || '}' WHEN 3 THEN '{"roof_slope_max_deg":' || CAST(o_orderkey % 180 AS STRING) || '}' WHEN 4 THEN '{"max_storeys_above":"' || CAST(o_orderkey % 5 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '.5' ELSE '' END || '"}'
  WHEN 5 THEN '{"landUses":[{"symbol":"MN","area":"' || CAST(o_orderkey % 50 AS STRING) || ',25"}]}' WHEN 6 THEN '{"plot_number":"' || repeat('x', CAST(250 + o_orderkey % 13 AS INT)) || '"}' ELSE '{"city":' END AS payload FROM orders"""
LAND = """SELECT o_custkey AS parent, CASE WHEN o_orderkey % 40 = 0 THEN repeat('X', 100) ELSE ' r ' || CAST(o_orderkey % 6 AS STRING) END AS symbol, CAST(o_orderkey % 900 AS DECIMAL(12,2)) AS area FROM orders"""


def from_sql(spark, sf, sql):
    from .fixtures import TABLES

    return spark.sql(TABLES.sub(lambda m: f"FROM parquet.`{sf}/{m[1]}.parquet`", sql))


def text_map(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def cents(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def stored_and_new(spark, sf):
    e = edits(spark, sf).select("id", "parcel_id", "field_key", F.round(F.col("value"), 2).cast("string").alias("value"))
    return e.where("id % 3 = 0"), e.where("id % 3 <> 0")


def cache_sides(spark, sf):
    c = calls(spark, sf)
    key = (F.col("call_id") % 40).alias("key")
    return c.where("NOT ok OR call_id % 2 = 0").select(F.col("call_id").alias("request_id"), key, "ts"), c.where("ok AND call_id % 2 = 1").select(key, "ts")


def fallback(spark, sf):
    c = calls(spark, sf).select(F.col("call_id").alias("request_id"), "ok", (F.col("call_id") % 2 == 0).alias("fallback_enabled"))
    side = lambda test, name: c.where(test).select("request_id", F.concat(F.lit(name), F.col("request_id").cast("string")).alias("result"))
    return H.with_fallback(c.select("request_id", "fallback_enabled"), side("ok", "p"), side("request_id % 3 = 0", "f"), side("request_id % 5 = 0", "c"))


def nested(spark, sf):
    plots = parcels(spark, sf).select("plot_id", (F.col("plot_id") % 500).alias("project_id"))
    e = edits(spark, sf)
    params = e.groupBy(F.col("parcel_id").alias("plot_id"), F.col("field_key").alias("key")).agg(F.max("id").cast("string").alias("value"))
    out = R.nested_plots(projects(spark, sf), plots, params)
    return out.select("project_id", F.coalesce(F.array_join(F.transform("plots", lambda p: F.concat(p["plot_id"].cast("string"), F.lit(":"), F.coalesce(F.array_join(F.transform(p["parameters"], lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","), F.lit("")))), ";"), F.lit("")).alias("plots"))


def missing(spark, sf):
    e = edits(spark, sf)
    keys = e.sparkSession.createDataFrame([(k,) for k in ("view", "signup", "error", "click", "purchase", "maxStoreys", "roofType")], "field_key string")
    return R.pad_missing(e.groupBy(F.col("parcel_id").alias("doc_id"), "field_key").agg(F.lit("EXTRACTED").alias("status")), keys)


QUERIES = {
    "p1_active_projects": lambda s, d: R.active_of(projects(s, d)).select("project_id", "user_id", "status"),
    "a6_cost_rollup": lambda s, d: cents(R.cost_rollup(costs(s, d)), "net", "gross"),
    "a7_admin_overview": lambda s, d: R.overview(users(s, d), projects(s, d)),
    "w5_w7_versions": lambda s, d: R.versions(projects(s, d), ["user_id", "status"], [F.col("created_at"), F.col("project_id")]).select("project_id", "version", "is_current"),
    "w6_latest_project": lambda s, d: R.latest(projects(s, d), ["user_id"], [F.desc("created_at"), F.desc("project_id")]).select("user_id", "project_id"),
    "w10_last_three": lambda s, d: R.latest(projects(s, d), ["user_id"], [F.desc("created_at"), F.desc("project_id")], 3).select("user_id", "project_id"),
    "w9_edit_history": lambda s, d: R.history(edits(s, d)).select("id", "old_value", "changed"),
    "j13_upsert": lambda s, d: R.upsert(*stored_and_new(s, d), ["parcel_id", "field_key"], "id"),
    "p11_changed_fields": lambda s, d: R.changed_fields(*(R.latest(x, ["parcel_id", "field_key"], [F.desc("id")]).drop("id") for x in stored_and_new(s, d)), ["parcel_id", "field_key"]),
    "p18_cascade_delete": lambda s, d: R.cascade(costs(s, d), projects(s, d).where("deleted_at IS NOT NULL"), "project_id").groupBy("project_id").agg(F.count("*").alias("n")),
    "a4_rule_map": lambda s, d: R.rule_map(edits(s, d).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))).select("parcel_id", text_map(F.col("rules")).alias("rules"), text_map(F.col("provenance")).alias("provenance")),
    "u2_missing_fields": missing,
    "p10_conditions": lambda s, d: cents(R.validate_conditions(from_sql(s, d, CONDITIONS)), "height", "slope", "share"),
    "p10_checked_conditions": lambda s, d: R.checked_conditions(from_sql(s, d, PAYLOADS)).withColumn("accepted", text_map(F.col("accepted"))),
    "a17_land_uses": lambda s, d: R.replace_land_uses(from_sql(s, d, LAND).groupBy("parent").agg(F.lit("OLD").alias("symbol"), F.lit(1).cast("decimal(12,2)").alias("area")), from_sql(s, d, LAND)).withColumn("area", F.col("area").cast("double")),
    "p19_default_child": lambda s, d: R.default_children(projects(s, d), costs(s, d), F.concat(F.lit("plot "), F.col("project_id").cast("string"))),
    "p20_label_conflict": lambda s, d: R.label_conflicts(projects(s, d), ["user_id", "status"], F.col("project_id")).select("project_id", "error_code"),
    "j5_nested_plots": nested,
    "f21_error_class": lambda s, d: H.classified(calls(s, d)).select("call_id", "error_class", "retryable"),
    "a14_source_counters": lambda s, d: H.counters(calls(s, d)),
    "t_1_success_windows": lambda s, d: H.success_windows(calls(s, d)),
    "t_2_dominant_errors": lambda s, d: H.dominant_errors(calls(s, d)),
    "t_4_circuit": lambda s, d: H.circuit(calls(s, d)).select("call_id", "failures", "is_open"),
    "t_6_folded_retries": lambda s, d: H.folded_retries(calls(s, d)),
    "j9_cached_results": lambda s, d: H.cached_results(*cache_sides(s, d)),
    "w11_plain_rate": lambda s, d: H.plain_rate(calls(s, d)).select("call_id", "n", "refused"),
    "j10_source_fallback": fallback,
}
CLASS = """CASE WHEN error_text IS NULL THEN NULL WHEN contains(lower(error_text), 'tunnel connection failed: 403') THEN 'PROXY_CONNECT_403' WHEN contains(lower(error_text), 'timed out') THEN 'TCP_TIMEOUT' WHEN contains(lower(error_text), 'ssl') THEN 'TLS_ERROR' WHEN contains(lower(error_text), 'network is unreachable') THEN 'NETWORK_UNREACHABLE' ELSE 'NETWORK_ERROR' END"""
SIDES = ", e AS (SELECT id, parcel_id, field_key, CAST(round(value, 2) AS VARCHAR) AS value FROM f_edits)"
VERSION = "row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, project_id DESC)"
CENTS = "CAST(CAST(TRY_CAST(replace(trim({0}), ',', '.') AS DECIMAL(28,10)) AS DECIMAL(18,2)) AS VARCHAR)"
GIVEN = {k: f"json_extract_string(payload, '$.{k}')" for k in ("city", "max_building_height", "services_allowed", "roof_slope_max_deg", "max_storeys_above", "plot_number")}
ORACLE = {
    "p10_checked_conditions": f"""WITH p AS ({PAYLOADS}), g AS (SELECT id, {", ".join(f"CASE WHEN json_valid(payload) THEN {v} END AS {k}" for k, v in GIVEN.items())}, json_valid(payload) AS valid, CASE WHEN json_valid(payload) THEN json_type(payload, '$.services_allowed') END AS kind,
  CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.landUses[0].symbol') END AS symbol, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.landUses[0].area') END AS area FROM p),
f AS (SELECT *, CASE WHEN NOT valid THEN 'INVALID_JSON' WHEN length(plot_number) > 255 THEN 'FIELD_TOO_LONG' WHEN kind <> 'BOOLEAN' THEN 'INVALID_BOOLEAN' WHEN TRY_CAST(max_building_height AS DOUBLE) < 0 THEN 'NEGATIVE_NUMBER' WHEN max_storeys_above LIKE '%.%' THEN 'INVALID_INTEGER' WHEN CAST(roof_slope_max_deg AS INT) > 90 THEN 'VALUE_OUT_OF_RANGE' END AS error_code FROM g)
SELECT id, error_code, CASE error_code WHEN 'INVALID_JSON' THEN 'payload' WHEN 'FIELD_TOO_LONG' THEN 'plot_number' WHEN 'INVALID_BOOLEAN' THEN 'services_allowed' WHEN 'NEGATIVE_NUMBER' THEN 'max_building_height' WHEN 'INVALID_INTEGER' THEN 'max_storeys_above' WHEN 'VALUE_OUT_OF_RANGE' THEN 'roof_slope_max_deg' END AS error_field,
  CASE WHEN error_code IS NULL THEN concat_ws(';', 'plot_number=' || plot_number, 'city=' || trim(city), 'services_allowed=' || services_allowed, 'land_uses=' || symbol || '=' || {CENTS.format("area")}, 'max_building_height=' || {CENTS.format("max_building_height")}, 'max_storeys_above=' || max_storeys_above, 'roof_slope_max_deg=' || {CENTS.format("roof_slope_max_deg")}) END AS accepted FROM f""",
    "p1_active_projects": oracle("f_projects", "SELECT project_id, user_id, status FROM f_projects WHERE deleted_at IS NULL"),
    "a6_cost_rollup": oracle("f_cost_items", "SELECT project_id, count(*) AS n_items, CAST(sum(CAST(quantity * unit_price AS DECIMAL(14,2))) AS DOUBLE) AS net, CAST(sum(CAST(quantity * unit_price AS DECIMAL(14,2))) AS DOUBLE) AS gross FROM f_cost_items GROUP BY 1"),
    "a7_admin_overview": oracle("f_projects f_users", "SELECT (SELECT count(*) FROM f_users) AS users, (SELECT count(*) FROM f_users WHERE is_admin) AS admins, (SELECT count(*) FROM f_projects WHERE deleted_at IS NULL) AS projects, (SELECT count(*) FROM f_projects WHERE deleted_at IS NULL AND status = 'o') AS active"),
    "w5_w7_versions": oracle("f_projects", "SELECT project_id, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at, project_id) AS version, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at, project_id) = count(*) OVER (PARTITION BY user_id, status) AS is_current FROM f_projects"),
    "w6_latest_project": oracle("f_projects", f"SELECT user_id, project_id FROM f_projects QUALIFY {VERSION} = 1"),
    "w10_last_three": oracle("f_projects", f"SELECT user_id, project_id FROM f_projects QUALIFY {VERSION} <= 3"),
    "w9_edit_history": oracle("f_edits", "SELECT id, lag(value) OVER w AS old_value, lag(value) OVER w IS DISTINCT FROM value AS changed FROM f_edits WINDOW w AS (PARTITION BY parcel_id, field_key ORDER BY ts, id)"),
    "j13_upsert": oracle("f_edits", SIDES + " SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY parcel_id, field_key ORDER BY CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END DESC, id DESC) = 1"),
    "p11_changed_fields": oracle("f_edits", SIDES + ", l AS (SELECT parcel_id, field_key, id % 3 = 0 AS old, value FROM e QUALIFY row_number() OVER (PARTITION BY parcel_id, field_key, id % 3 = 0 ORDER BY id DESC) = 1) SELECT coalesce(a.parcel_id, b.parcel_id) AS parcel_id, coalesce(a.field_key, b.field_key) AS field_key, a.value AS old_value, b.value AS new_value FROM (SELECT * FROM l WHERE old) a FULL JOIN (SELECT * FROM l WHERE NOT old) b ON a.parcel_id = b.parcel_id AND a.field_key = b.field_key WHERE a.value IS DISTINCT FROM b.value"),
    "p18_cascade_delete": oracle("f_cost_items f_projects", "SELECT project_id, count(*) AS n FROM f_cost_items WHERE project_id NOT IN (SELECT project_id FROM f_projects WHERE deleted_at IS NOT NULL) GROUP BY 1"),
    "a4_rule_map": oracle("f_edits", ", l AS (SELECT parcel_id, field_key, arg_max(CAST(round(value * 100) AS BIGINT), id) AS v, max(id) AS id FROM f_edits WHERE value IS NOT NULL GROUP BY 1, 2) SELECT parcel_id, string_agg(field_key || '=' || v, ';' ORDER BY field_key) AS rules, string_agg(field_key || '=' || id, ';' ORDER BY field_key) AS provenance FROM l GROUP BY 1"),
    "u2_missing_fields": oracle("f_edits", ", f AS (SELECT DISTINCT parcel_id AS doc_id, field_key FROM f_edits), k(field_key) AS (VALUES ('view'), ('signup'), ('error'), ('click'), ('purchase'), ('maxStoreys'), ('roofType')) SELECT d.doc_id, k.field_key, CASE WHEN f.doc_id IS NULL THEN 'REQUIRES_REVIEW' ELSE 'EXTRACTED' END AS status FROM (SELECT DISTINCT doc_id FROM f) d CROSS JOIN k LEFT JOIN f ON f.doc_id = d.doc_id AND f.field_key = k.field_key"),
    "p10_conditions": f"""WITH c AS ({CONDITIONS}), t AS (SELECT *, TRY_CAST(replace(trim(height), ',', '.') AS DECIMAL(12,2)) AS h, TRY_CAST(replace(trim(slope), ',', '.') AS DECIMAL(12,2)) AS sl, TRY_CAST(replace(trim(share), ',', '.') AS DECIMAL(12,2)) AS sh FROM c)
SELECT id, trim(label) AS label, CAST(h AS DOUBLE) AS height, CAST(sl AS DOUBLE) AS slope, CAST(sh AS DOUBLE) AS share, CASE WHEN trim(storeys) SIMILAR TO '[0-9]+' THEN CAST(trim(storeys) AS INT) END AS storeys,
  CASE WHEN length(trim(label)) > 255 THEN 'LABEL_TOO_LONG' WHEN trim(height) <> '' AND h IS NULL THEN 'HEIGHT_INVALID' WHEN h < 0 THEN 'HEIGHT_NEGATIVE' WHEN trim(slope) <> '' AND sl IS NULL THEN 'SLOPE_INVALID' WHEN sl < 0 OR sl > 90 THEN 'SLOPE_RANGE' WHEN trim(share) <> '' AND sh IS NULL THEN 'SHARE_INVALID' WHEN sh < 0 OR sh > 100 THEN 'SHARE_RANGE' WHEN NOT trim(storeys) SIMILAR TO '[0-9]+' THEN 'STOREYS_INVALID' END AS error_code FROM t""",
    "a17_land_uses": f"WITH i AS ({LAND}), s AS (SELECT parent, upper(regexp_replace(symbol, '\\s+', '', 'g')) AS symbol, CAST(area AS DOUBLE) AS area FROM i), o AS (SELECT parent, bool_and(length(symbol) <= 64) AS ok FROM s GROUP BY 1) SELECT s.* FROM s JOIN o USING (parent) WHERE ok UNION ALL SELECT parent, 'OLD', 1.0 FROM o WHERE NOT ok",
    "p19_default_child": oracle("f_projects f_cost_items", "SELECT project_id, 'plot ' || project_id AS label FROM f_projects WHERE project_id NOT IN (SELECT project_id FROM f_cost_items)"),
    "p20_label_conflict": oracle("f_projects", "SELECT project_id, CASE WHEN row_number() OVER (PARTITION BY user_id, status ORDER BY project_id) > 1 THEN 'CONFLICT' END AS error_code FROM f_projects"),
    "j5_nested_plots": oracle("f_projects f_parcels f_edits", ", q AS (SELECT parcel_id AS plot_id, field_key AS key, CAST(max(id) AS VARCHAR) AS value FROM f_edits GROUP BY 1, 2), n AS (SELECT plot_id, string_agg(key || '=' || value, ',' ORDER BY key) AS t FROM q GROUP BY 1), m AS (SELECT plot_id % 500 AS project_id, string_agg(plot_id || ':' || coalesce(t, ''), ';' ORDER BY plot_id) AS plots FROM f_parcels LEFT JOIN n USING (plot_id) GROUP BY 1) SELECT project_id, coalesce(plots, '') AS plots FROM f_projects LEFT JOIN m USING (project_id)"),
    "f21_error_class": oracle("f_calls", f"SELECT call_id, {CLASS} AS error_class, coalesce({CLASS} IN ('TCP_TIMEOUT', 'NETWORK_UNREACHABLE', 'NETWORK_ERROR'), false) AS retryable FROM f_calls"),
    "a14_source_counters": oracle("f_calls", f"SELECT source, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, (SELECT {CLASS} FROM f_calls b WHERE b.source = a.source ORDER BY ts DESC, call_id DESC LIMIT 1) AS last_error FROM f_calls a GROUP BY source"),
    "t_1_success_windows": oracle("f_calls", "SELECT source, time_bucket(INTERVAL 15 MINUTE, ts) AS begin, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (ok) < 0.9 * count(*) AS alert FROM f_calls GROUP BY 1, 2"),
    "t_2_dominant_errors": oracle("f_calls", f", w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS begin, {CLASS} AS error_class FROM f_calls CROSS JOIN (VALUES (0), (1), (2)) x(k) WHERE NOT ok), g AS (SELECT begin, error_class, count(*) AS n FROM w GROUP BY 1, 2) SELECT begin, error_class, n, CAST(sum(n) OVER (PARTITION BY begin) AS BIGINT) AS total FROM g QUALIFY n > 0.2 * sum(n) OVER (PARTITION BY begin)"),
    "t_4_circuit": oracle("f_calls", ", r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source ORDER BY ts, call_id) AS run FROM f_calls), f AS (SELECT call_id, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY source, run ORDER BY ts, call_id) AS BIGINT) AS failures FROM r) SELECT call_id, failures, failures >= 5 AS is_open FROM f"),
    "t_6_folded_retries": oracle("f_calls", ", g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY source ORDER BY ts) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS new FROM f_calls), n AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY ts) AS s FROM g) SELECT source, min(ts) AS begin, count(*) AS attempts, min(call_id) FILTER (ok) AS first_ok FROM n GROUP BY source, s"),
    "j9_cached_results": oracle("f_calls", ", q AS (SELECT call_id AS request_id, call_id % 40 AS key, ts FROM f_calls WHERE NOT ok OR call_id % 2 = 0), r AS (SELECT call_id % 40 AS key, ts AS hit FROM f_calls WHERE ok AND call_id % 2 = 1), j AS (SELECT request_id, hit, floor(epoch(ts)) - floor(epoch(hit)) AS age FROM q ASOF LEFT JOIN r ON q.key = r.key AND q.ts >= r.hit) SELECT request_id, CASE WHEN age <= 86400 THEN hit END AS hit_ts, CASE WHEN age <= 3600 THEN 'hit' WHEN age <= 86400 THEN 'stale' ELSE 'miss' END AS state FROM j"),
    "w11_plain_rate": oracle("f_calls", ", s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM f_calls) SELECT call_id, count(*) OVER w AS n, count(*) OVER w > 30 AS refused FROM s WINDOW w AS (PARTITION BY source ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)"),
    "j10_source_fallback": oracle("f_calls", ", c AS (SELECT call_id AS i, CASE WHEN ok THEN 'p' || call_id END AS p, CASE WHEN call_id % 6 = 0 THEN 'f' || call_id END AS f, CASE WHEN call_id % 5 = 0 THEN 'c' || call_id END AS c FROM f_calls) SELECT i AS request_id, coalesce(p, f, c) AS result, CASE WHEN p IS NOT NULL THEN 'SUCCESS' WHEN coalesce(f, c) IS NOT NULL THEN 'SUCCESS_PARTIAL' ELSE 'INFRA_ERROR' END AS status, CASE WHEN p IS NOT NULL THEN '' WHEN f IS NOT NULL THEN 'PRIMARY_FAILED,FALLBACK_USED' WHEN c IS NOT NULL THEN 'PRIMARY_FAILED,STALE_CACHE' ELSE 'PRIMARY_FAILED' END AS flags FROM c"),
}
