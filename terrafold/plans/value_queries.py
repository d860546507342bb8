"""Queries over small value functions, previews and remembered choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import cad as C
from ..operators.register import latest
from .fixtures import oracle, view


def scalars(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    return p.select("p_partkey", V.rgb_hex(k % 256, 250 + k % 6, 251 + k % 5).alias("colour"), V.display(F.col("p_size").cast("string"), F.when(k % 2 == 0, "m").otherwise(" ")).alias("shown"), V.safe_float(F.when(k % 3 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))).alias("num"), V.arc_points(k % 13 / F.lit(2.0)).alias("pieces"), T.land_use_symbol(F.concat(F.lit(" mn "), (k % 5).cast("string"))).alias("symbol"))


def previews(s, d):
    """Each asked number with the state of its matches in the register."""
    n = view(s, d, "f_parcels").groupBy("parcel_number").agg(F.count("*").alias("n"), F.min("plot_id").alias("plot_id"))
    asked = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat((F.col("doc_id") % 520 + 1).cast("string"), F.lit("/"), (F.col("doc_id") % 7 + 1).cast("string")).alias("parcel_number"))
    return asked.join(n.hint("merge"), "parcel_number", "left").select("doc_id", F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "MULTIPLE").otherwise("FOUND").alias("status"), F.when(F.col("n") == 1, F.col("plot_id")).alias("plot_id"))


def remembered(s, d):
    """The latest layer chosen for a signature is remembered for every drawing of that signature."""
    e = view(s, d, "f_entities")
    signed = C.signatures(e)
    chosen = e.where("closed").groupBy("file_id").agg(F.min("layer").alias("layer")).join(signed.hint("merge"), "file_id")
    last = latest(chosen, ["signature"], [F.desc("file_id")]).select("signature", F.col("layer").alias("preferred"))
    return signed.join(last.hint("merge"), "signature", "left").select("file_id", "preferred")


def searched(s, d):
    """A register's search predicate from its column names."""
    test = V.search_predicate({"precinct": "precinct", "locality": "locality"}, F.lit(""), F.array(F.lit("0007"), F.lit("0031")), F.lit("radom"))
    return view(s, d, "f_parcels").where(test).select("plot_id")


def parts_ranked(s, d):
    """The largest part of each group of shapes, the first on ties."""
    shapes = view(s, d, "f_entities").where("closed").select("file_id", "layer", "x", "y", (F.col("w") * F.col("h")).alias("area"))
    order = Window.partitionBy("file_id", "layer").orderBy(F.desc("area"), "x", "y")
    return shapes.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


QUERIES = {"f20_f29_values": scalars, "j15_parcel_preview": previews, "j11_w12_remembered_layer": remembered, "p8_register_search": searched, "t8_largest_part": parts_ranked}
ORACLE = {
    "f20_f29_values": "SELECT p_partkey, CASE WHEN p_partkey % 256 >= 250 THEN '#000000' ELSE '#' || lpad(lower(to_hex(p_partkey % 256)), 2, '0') || lower(to_hex(250 + p_partkey % 6)) || lower(to_hex(251 + p_partkey % 5)) END AS colour, p_size || CASE WHEN p_partkey % 2 = 0 THEN ' m' ELSE '' END AS shown, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 0.5 END AS num, CAST(greatest(8, floor(32 * (p_partkey % 13 / 2.0) / (2 * pi()))) AS INT) AS pieces, 'MN' || p_partkey % 5 AS symbol FROM part",
    "j15_parcel_preview": oracle("f_parcels", ", n AS (SELECT parcel_number, count(*) AS n, min(plot_id) AS plot_id FROM f_parcels GROUP BY 1) SELECT doc_id, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'MULTIPLE' ELSE 'FOUND' END AS status, CASE WHEN n = 1 THEN plot_id END AS plot_id FROM documents LEFT JOIN n ON parcel_number = CAST(doc_id % 520 + 1 AS VARCHAR) || '/' || CAST(doc_id % 7 + 1 AS VARCHAR)"),
    "j11_w12_remembered_layer": oracle("f_entities", ", s AS (SELECT file_id, array_to_string(list_sort(list(DISTINCT lower(layer))), '|') AS g, min(layer) FILTER (closed) AS l FROM f_entities GROUP BY 1), c AS (SELECT g, arg_max(l, file_id) AS preferred FROM s WHERE l IS NOT NULL GROUP BY 1) SELECT file_id, preferred FROM s LEFT JOIN c USING (g)"),
    "p8_register_search": oracle("f_parcels", "SELECT plot_id FROM f_parcels WHERE precinct IN ('0007', '0031') AND contains(lower(locality), 'radom')"),
    "t8_largest_part": oracle("f_entities", "SELECT file_id, layer, x, y, w * h AS area FROM f_entities WHERE closed QUALIFY row_number() OVER (PARTITION BY file_id, layer ORDER BY w * h DESC, x, y) = 1"),
}
