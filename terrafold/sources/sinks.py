"""A sink of several tables: each batch's tables are written by its number, its manifest last, and readers see whole batches only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, status string, n long, batch int"


def manifest(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """table, status ("ok" or the error), n and batch of what has been committed; empty where nothing has been yet."""
    path = f"{folder}/commits" + ("" if batch is None else f"/batch={batch}")
    try:
        found = spark.read.option("basePath", f"{folder}/commits").schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], MANIFEST)
    return found


def commit(tables: dict[str, DataFrame], folder: str, batch: int) -> dict[str, str]:
    """Writes the tables of a batch to folder/name/batch=N and tells each one's status.

    A table that fails stands in the manifest with its error and doesn't stop the others. A batch that comes again writes
    only what isn't there yet, so a restarted stream leaves each row once.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = {r["table"]: (r["status"], r["n"]) for r in manifest(spark, folder, batch).collect()}
    left = [name for name in tables if rows.get(name, ("",))[0] != "ok"]
    for name in left:
        path = f"{folder}/{name}/batch={batch}"
        try:
            tables[name].write.mode("overwrite").parquet(path)
            rows[name] = ("ok", spark.read.schema(tables[name].schema).parquet(path).count())
        except Exception as e:  # noqa: BLE001  each table stands alone
            rows[name] = (f"error: {type(e).__name__}", None)
    if left:
        told = spark.createDataFrame([(name, status, n) for name, (status, n) in sorted(rows.items())], "table string, status string, n long")
        told.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={batch}")
    return {name: status for name, (status, _) in rows.items()}


def committed(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table's rows, with their batch, of the batches whose manifest has it as written; files of other batches aren't told."""
    done = manifest(spark, folder).where((F.col("table") == name) & (F.col("status") == "ok")).select("batch")
    if done.isEmpty():
        return spark.createDataFrame([], schema + ", batch int")
    return spark.read.schema(schema + ", batch int").parquet(f"{folder}/{name}").join(done.hint("merge"), "batch", "left_semi")


def failed(spark: SparkSession, folder: str) -> DataFrame:
    """table, batch, status of what a batch couldn't write."""
    return manifest(spark, folder).where("status <> 'ok'").select("table", "batch", "status")
