"""Queries that run as streams over all that the tables hold: intake, caches, rule refresh and a sink of several tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators.overlay import site_summary
from ..sources.sinks import commit, committed
from ..streaming import intake as I
from ..streaming import jobs as J
from . import register_queries
from .document_queries import FIELD_SQL, scratch
from .fixtures import TABLES, VIEWS, oracle, view
from .register_queries import text_map
from .text_queries import EVIDENCE, PENALTY, RANKED, SUMS, TOP


def streamed(s, d, name, files=1):
    """A view over the one table that it reads, as a stream."""
    table = TABLES.search(VIEWS[name])[1]
    at = f"stream_{uuid.uuid4().hex}"
    J.read_table(s, d, table, files).createOrReplaceTempView(at)
    return s.sql(TABLES.sub(f"FROM {at}", VIEWS[name]))


def cache_stream(s, d):
    calls = streamed(s, d, "f_calls", None)
    put = F.col("ok") & (F.col("call_id") % 2 == 1)
    asks = calls.select((F.col("call_id") % 40).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(~put, F.col("call_id")).alias("request_id"))
    return J.drained(J.cached(asks), scratch(s)).withColumn("hit_ts", F.col("hit_ts").cast("timestamp_ntz"))


def rule_refresh(s, d):
    at = scratch(s)
    edits = streamed(s, d, "f_edits").withColumn("value", F.round(F.col("value") * 100))
    edits.writeStream.foreachBatch(J.refresh_rules(at)).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    whole = F.transform_values("rules", lambda k, v: v.cast("double").cast("bigint").cast("string"))
    return J.current_rules(s, at).select("parcel_id", text_map(whole).alias("rules"), text_map(F.col("provenance")).alias("provenance"))


UPLOADS = """
SELECT *, 'plan_' || CAST(doc_id AS STRING) || '.' || split_part('PDF,png,exe,dxf', ',', CAST(doc_id % 4 + 1 AS INT)) AS name,
  CASE WHEN doc_id % 5 = 0 THEN 'text/plain' ELSE split_part('application/pdf,image/png,application/pdf,application/dxf', ',', CAST(doc_id % 4 + 1 AS INT)) END AS media_type,
  (doc_id % 30) * 1048576 AS size, CASE WHEN doc_id % 17 = 0 THEN '' ELSE split_part('PLAN,MAP,DECISION', ',', CAST(doc_id % 3 + 1 AS INT)) END AS document_type, doc_id * 90 AS seconds FROM """


def intake(s, d):
    at = scratch(s)
    pages = f"pages_{uuid.uuid4().hex}"
    streamed(s, d, "f_pages", None).createOrReplaceTempView(pages)
    I.intake(s.sql(UPLOADS + pages).withColumn("uploaded_at", F.timestamp_seconds("seconds")), at)
    return I.outcomes(s, at).select("doc_id", "reject_reason", "version", "file_type", "confidence", "n_fields")


SITE = {"objects": "feature_id long, plot_id long, layer_key string", "layers": "plot_id long, layer_key string, n long", "context": "plot_id long, buildings long, networks long, roads long, layers long, has_flood boolean, has_trees boolean"}


def site_sink(s, d):
    """Three tables of the sites, committed in two batches, as their readers find them."""
    at, every = scratch(s), view(s, d, "f_features")
    for batch, test in enumerate(("plot_id % 2 = 0", "plot_id % 2 <> 0")):
        features = every.where(test)
        commit({"objects": features.select("feature_id", "plot_id", "layer_key"), "layers": features.groupBy("plot_id", "layer_key").agg(F.count("*").alias("n")), "context": site_summary(features)}, at, batch)
    told = [committed(s, at, name, schema).groupBy("batch").agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.sum("plot_id").alias("total")) for name, schema in SITE.items()]
    return reduce(lambda a, b: a.unionByName(b), told)


QUERIES = {"t_7_cache_stream": cache_stream, "t_8_rule_refresh": rule_refresh, "t_9_intake": intake, "s11_site_sink": site_sink}
ORACLE = {
    "t_7_cache_stream": register_queries.ORACLE["j9_cached_results"],
    "t_8_rule_refresh": oracle("f_edits", ", l AS (SELECT parcel_id, field_key, CAST(round(value * 100) AS BIGINT) AS v, id FROM f_edits QUALIFY row_number() OVER (PARTITION BY parcel_id, field_key ORDER BY ts DESC, id DESC) = 1) SELECT parcel_id, string_agg(field_key || '=' || v, ';' ORDER BY field_key) AS rules, string_agg(field_key || '=' || id, ';' ORDER BY field_key) AS provenance FROM l WHERE v IS NOT NULL GROUP BY 1"),
    "t_9_intake": oracle("f_pages", f""", up AS ({UPLOADS} f_pages), said AS (SELECT *, CASE WHEN document_type = '' THEN 'TYPE' WHEN doc_id % 4 = 2 THEN 'EXTENSION' WHEN doc_id % 5 = 0 THEN 'MEDIA_TYPE' WHEN size <= 0 THEN 'EMPTY' WHEN size > CASE doc_id % 4 WHEN 3 THEN 50 ELSE 20 END * 1048576 THEN 'TOO_LARGE' END AS reject_reason FROM up),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY document_type ORDER BY seconds, doc_id) AS version FROM said WHERE reject_reason IS NULL),
taken AS (SELECT doc_id, text FROM said WHERE reject_reason IS NULL),
f_lines AS (SELECT doc_id, 1 AS page, CAST(i - 1 AS INT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM taken))""" + EVIDENCE + SUMS + RANKED + f""",
t AS {TOP.replace('FROM documents', 'FROM taken')}, kind AS (SELECT doc_id, CASE WHEN winner_score < 1 THEN 'INNE' ELSE winner END AS file_type, round(greatest(0.0, least(1.0, winner_score / 420.0) - {PENALTY}), 3) AS confidence FROM best JOIN t USING (doc_id)),
counted AS (SELECT doc_id, count(*) AS n_fields FROM ({FIELD_SQL}) GROUP BY 1)
SELECT doc_id, reject_reason, version, file_type, confidence, CASE WHEN reject_reason IS NULL THEN coalesce(n_fields, 0) END AS n_fields
FROM said LEFT JOIN numbered USING (doc_id) LEFT JOIN kind USING (doc_id) LEFT JOIN counted USING (doc_id)"""),
    "s11_site_sink": oracle("f_features", """, f AS (SELECT CAST(plot_id % 2 AS INT) AS batch, * FROM f_features)
SELECT batch, 'objects' AS "table", count(*) AS n, sum(plot_id) AS total FROM f GROUP BY 1 UNION ALL SELECT batch, 'layers', count(*), sum(plot_id) FROM (SELECT DISTINCT batch, plot_id, layer_key FROM f) GROUP BY 1
UNION ALL SELECT batch, 'context', count(*), sum(plot_id) FROM (SELECT DISTINCT batch, plot_id FROM f) GROUP BY 1"""),
}
