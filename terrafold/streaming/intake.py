"""T-9: intake of uploaded documents as a stream of files: checked, versioned, read for planning fields and classified."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.classify import class_scores, final_class, top_text, winners
from ..operators.extraction import fields
from ..sources.payloads import eligible
from ..sources.sinks import commit, committed

#: Uploads are numbered within stretches of so many seconds, and stretches within a type.
STRETCH = 3_600
DOCUMENTS = "doc_id long, document_type string, name string, size long, uploaded_at timestamp, version long"
REJECTS = "doc_id long, name string, reject_reason string"
FIELDS = "doc_id long, field_key string, value_num double, value_text string, unit string, raw string, page int, confidence double, status string"
CLASSES = "doc_id long, file_type string, confidence double"
VERSIONS = "document_type string, last long"


def checked(uploads: DataFrame) -> DataFrame:
    """uploads with reject_reason: no type, no name, then the upload checks' own; null for those to be taken in."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return eligible(uploads).withColumn("reject_reason", F.when(empty("document_type"), "TYPE").when(empty("name"), "NAME").otherwise(F.col("reject_reason")))


def versioned(uploads: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """uploads with version: one more than the last of their type, by time and id; before: document_type, last of earlier batches.

    Numbers are counted within stretches of time, so a frequent type is many window groups; only stretches' sizes are summed by type.
    """
    stretched = uploads.withColumn("stretch_", F.floor(F.unix_timestamp("uploaded_at") / STRETCH))
    sizes = stretched.groupBy("document_type", "stretch_").agg(F.count("*").alias("n_"))
    if before is not None:
        sizes = sizes.unionByName(before.select("document_type", F.lit(-(1 << 62)).alias("stretch_"), F.col("last").alias("n_")))
    earlier = Window.partitionBy("document_type").orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("document_type", "stretch_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("first_"))
    within = Window.partitionBy("document_type", "stretch_").orderBy("uploaded_at", "doc_id")
    own = stretched.withColumn("version", F.row_number().over(within))
    return own.join(first.hint("merge"), ["document_type", "stretch_"]).withColumn("version", (F.col("version") + F.col("first_")).cast("long")).drop("stretch_", "first_")


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, line of all lines."""
    return pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def take_in(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: uploads (doc_id, name, media_type, size, document_type, uploaded_at, page, text), a row a page or one with neither.

    Each batch commits five tables by its number: rejects, documents, fields, classes, and versions, the last number of each type
    so far, which the next batch goes on from. A batch that comes again after a restart finds what it has written and changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cores = spark.sparkContext.defaultParallelism
        batch = (batch if batch.rdd.getNumPartitions() >= cores else batch.repartition(cores)).persist()  # patterns cost far more than a shuffle of the texts
        seen = checked(batch)
        one = ["doc_id", "document_type", "name", "size", "uploaded_at"]
        uploads = seen.select(*one, "reject_reason").distinct()
        good = uploads.where("reject_reason IS NULL").select(*one)
        pages = seen.where("reject_reason IS NULL AND text IS NOT NULL").select("doc_id", "page", "text")
        before = committed(spark, folder, "versions", VERSIONS).where(F.col("batch") == number - 1) if number else spark.createDataFrame([], VERSIONS)
        documents = versioned(good, before)
        last = documents.groupBy("document_type").agg(F.max("version").alias("last"))
        kept = before.select("document_type", "last").join(last.hint("merge"), "document_type", "left_anti")
        classes = final_class(winners(class_scores(lines_of(pages))), top_text(pages))
        commit({"documents": documents, "versions": last.unionByName(kept), "rejects": uploads.where("reject_reason IS NOT NULL").select("doc_id", "name", "reject_reason"), "fields": fields(pages), "classes": classes}, folder, number)
        batch.unpersist()

    return run


def intake(uploads: DataFrame, folder: str) -> None:
    """Takes in all uploads that a stream has and folder hasn't seen."""
    uploads.writeStream.foreachBatch(take_in(folder)).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()


def outcomes(spark, folder: str) -> DataFrame:
    """doc_id, reject_reason, version, file_type, confidence, n_fields of everything that has been taken in or refused."""
    read = lambda name, schema: committed(spark, folder, name, schema).drop("batch")
    counted = read("fields", FIELDS).groupBy("doc_id").agg(F.count("*").alias("n_fields"))
    known = read("documents", DOCUMENTS).select("doc_id", F.lit(None).cast("string").alias("reject_reason"), "version")
    known = known.join(read("classes", CLASSES).hint("merge"), "doc_id", "left").join(counted.hint("merge"), "doc_id", "left").withColumn("n_fields", F.coalesce("n_fields", F.lit(0)))
    refused = read("rejects", REJECTS).select("doc_id", "reject_reason")
    return known.unionByName(refused, allowMissingColumns=True)
