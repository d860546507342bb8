"""Planning-domain views over the driver's tables, whole texts included; the SQL runs alike on Spark and DuckDB. The only place that invents data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "f_pages": """
SELECT doc_id, 1 AS page,
  'URZAD GMINY, Wydział Geodezji, tel. 123-456-789' || chr(10) ||
  'Działka nr ewid. ' || CAST(doc_id % 499 + 1 AS STRING) || '/' || CAST(doc_id % 7 + 1 AS STRING) ||
  ' obręb ' || lpad(CAST(doc_id % 97 + 1 AS STRING), 4, '0') || ' ' || split_part('Rajec,Wola,Bielin', ',', CAST(doc_id % 3 + 1 AS INT)) ||
  ' położona w ' || split_part('Radomiu,Szczecinku,Ciechanowie,Warszawie', ',', CAST(doc_id % 4 + 1 AS INT)) ||
  CASE WHEN doc_id % 5 = 0 THEN '.' ELSE ' przy ul. ' || split_part('Kwiatowej,Klonowej,Operowej', ',', CAST(doc_id % 3 + 1 AS INT)) || ' ' || CAST(doc_id % 90 + 1 AS STRING) || '.' END || chr(10) ||
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'Maksymalna wysokość zabudowy: ' || CAST(doc_id % 9 + 6 AS STRING) || ',5 m.' || chr(10) END ||
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Powierzchnia biologicznie czynna ' || CAST(doc_id % 8 * 5 + 20 AS STRING) || ' %.' || chr(10) END ||
  CASE WHEN doc_id % 11 = 0 THEN 'Wysokość kalenicy ' || CAST(doc_id % 7 + 8 AS STRING) || ' m.' || chr(10) || 'Kąt nachylenia 35 stopni' || chr(10) || 'Dach dwuspadowy' || chr(10) ELSE '' END ||
  CASE WHEN doc_id % 13 = 0 THEN 'Znak sprawy: AB.123.' || CAST(doc_id AS STRING) || chr(10) || 'z dnia ' || CAST(doc_id % 28 + 1 AS STRING) || ' maja 2024 r.' || chr(10) || 'Przeznaczenie podstawowe: zabudowa mieszkaniowa ' || CAST(doc_id % 5 AS STRING) || ',' || chr(10) ELSE '' END ||
  coalesce(text, '') || chr(10) ||
  'Maksymalna powierzchnia zabudowy ' || CAST(doc_id % 6 * 5 + 15 AS STRING) || ' %.' AS text
FROM documents""",
    "f_lines": """
SELECT doc_id, 1 AS page, CAST(n AS INT) AS line_no, line FROM {lines of documents}
UNION ALL
SELECT doc_id, 1 AS page, CAST(n - 4 AS INT) AS line_no,
  translate(split_part('wypis i wyrys z mpzp;decyzja o warunkach zabudowy;uchwala nr 12 rady gminy;ustalam warunki zabudowy;pouczenie i odwolanie', ';', CAST((doc_id + n) % 5 + 1 AS INT)),
            CASE WHEN doc_id % 3 = 0 THEN 'oe' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN '03' ELSE '' END) AS line
FROM documents CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE (doc_id + n) % 4 = 0""",
    "f_parcels": """
SELECT p_partkey AS plot_id,
  CAST(p_partkey % 499 + 1 AS STRING) || '/' || CAST(p_partkey % 7 + 1 AS STRING) AS parcel_number,
  lpad(CAST(p_partkey % 97 + 1 AS STRING), 4, '0') AS precinct,
  split_part('Radomiu,Szczecinku,Ciechanowie,Warszawie', ',', CAST(p_partkey % 4 + 1 AS INT)) AS locality,
  CAST(p_partkey % 100 * 80 AS DOUBLE) AS x0, CAST(floor(p_partkey / 100) * 80 AS DOUBLE) AS y0,
  CAST(p_partkey % 100 * 80 + 20 + p_size % 30 AS DOUBLE) AS x1, CAST(floor(p_partkey / 100) * 80 + 20 + p_partkey % 25 AS DOUBLE) AS y1
FROM part""",
    "f_features": """
SELECT o_orderkey AS feature_id, CAST(floor(o_orderkey / 8) AS BIGINT) AS plot_id,
  split_part('existing_building,adjacent_building,water_pipe,gas_pipe,tree,no_build_zone,flood_zone,road_edge', ',', CAST(o_orderkey % 8 + 1 AS INT)) AS layer_key,
  CASE WHEN o_orderkey % 8 IN (2, 3, 7) THEN 'LineString' WHEN o_orderkey % 8 = 4 THEN 'Point' ELSE 'Polygon' END AS geom_type,
  CAST(floor(o_orderkey / 8) % 100 * 80 - 8 + o_orderkey * 7 % 50 AS DOUBLE) AS fx0,
  CAST(floor(floor(o_orderkey / 8) / 100) * 80 - 8 + o_orderkey * 11 % 50 AS DOUBLE) AS fy0,
  CAST(CASE WHEN o_orderkey % 8 = 4 THEN 0 ELSE 2 + o_orderkey % 6 END AS DOUBLE) AS w,
  CAST(CASE WHEN o_orderkey % 8 IN (2, 3, 4, 7) THEN 0 ELSE 2 + o_orderkey % 5 END AS DOUBLE) AS h
FROM orders""",
    "f_projects": """
SELECT o_orderkey AS project_id, o_custkey AS user_id, lower(o_orderstatus) AS status, o_orderdate AS created_at,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at FROM orders""",
    "f_users": """
SELECT c_custkey AS user_id, c_name AS full_name, c_custkey % 50 = 0 AS is_admin FROM customer""",
    "f_cost_items": """
SELECT l_orderkey AS project_id, l_returnflag AS category, CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
  CAST(l_partkey % 900 + 100 AS DECIMAL(12,2)) AS unit_price FROM lineitem""",
    "f_entities": """
SELECT CAST(floor(l_orderkey / 10) AS BIGINT) AS file_id,
  split_part('DZIALKI,droga_A,Budynek,woda,GAZ,opis,egb_granica', ',', CAST(l_linenumber % 7 + 1 AS INT)) AS layer,
  split_part('LWPOLYLINE,LINE,TEXT,CIRCLE', ',', CAST(l_suppkey % 4 + 1 AS INT)) AS etype, l_returnflag = 'A' AS closed,
  CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_suppkey % 200 AS DOUBLE) AS y, l_quantity AS w, CAST(l_linenumber * 3 AS DOUBLE) AS h
FROM lineitem""",
    "f_edits": """
SELECT event_id AS id, ts, user_id AS parcel_id, event_type AS field_key, value FROM events""",
    "f_calls": """
SELECT event_id AS call_id, ts, split_part('ULDK,WFS,KIEG', ',', CAST(user_id % 3 + 1 AS INT)) AS source, event_type <> 'error' AS ok,
  CASE WHEN event_type <> 'error' THEN NULL ELSE split_part('Tunnel connection failed: 403;timed out;Network is unreachable;SSL handshake;HTTP 503', ';', CAST(event_id % 5 + 1 AS INT)) END AS error_text FROM events""",
    "f_payloads": """
SELECT p_partkey AS payload_id,
  '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"numer_dzialki":"' || CAST(p_partkey % 499 + 1 AS STRING) || '/' || CAST(p_partkey % 7 + 1 AS STRING) ||
  '"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[' || CAST(p_size AS STRING) || ',0],[' || CAST(p_size AS STRING) || ',10],[0,10],[0,0]]]}}]}' AS body
FROM part""",
}
TABLES = re.compile(r"FROM (documents|part|orders|customer|lineitem|events)\b")


#: All lines of whole texts, numbered, in each engine's words.
LINES = "{lines of documents}"
SPARK_LINES = "(SELECT doc_id, n, line FROM (SELECT {hint} doc_id, text FROM documents) LATERAL VIEW posexplode(split(text, chr(10))) x AS n, line)"
DUCK_LINES = "(SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables; where the documents have fewer partitions than there are cores, whole texts are dealt out before they are split into lines."""
    sql, hint = VIEWS[name], ""
    if LINES in sql:
        cores = spark.sparkContext.defaultParallelism
        hint = f"/*+ REPARTITION({cores}) */" if spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() < cores else ""
    return spark.sql(TABLES.sub(lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", sql.replace(LINES, SPARK_LINES.replace("{hint}", hint))))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it has fewer partitions than there are cores; for work that costs far more than a shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def oracle(names: str, sql: str) -> str:
    """DuckDB SQL over the named views; sql may go on with further common tables after a leading comma."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace(LINES, DUCK_LINES)})" for n in names.split()) + "\n" + sql
