"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold up to 10,000 rows; operators take a batch apart into steps of about so many bytes of text.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder; what follows doesn't run it again and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any longer; else they stay until the driver's next collection, which a driver with little to do hardly has."""
    gc.collect()
    for _ in range(2):  # the plan's last objects go with the second collection only
        time.sleep(0.5)  # Python's references to the JVM's objects are given up by a thread that wakes ten times a second
        spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, newline, vertical tab, form feed and carriage return, as UTF-8."""
    return text.encode().split() if text else []


def steps(sizes, limit: int = STEP_BYTES):
    """Index ranges whose sizes add up to about the limit; a larger row is a range of its own."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, so that other columns can't clash with its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: A key filter has 2 ** FILTER_BITS bits (1 MB) whatever the number of keys; more keys only let more rows through.
FILTER_BITS = 23


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df with maybe: false only where df's key isn't in the keys' first column; a bit table of fixed size is broadcast, so few rows need a shuffle to be sure."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bits = keys.select(place(F.col(keys.columns[0])).alias("p_")).select(F.expr("p_ div 64").alias("w_"), F.expr("shiftleft(1L, int(p_ % 64))").alias("b_")).groupBy("w_").agg(F.bit_or("b_").alias("b_"))
    placed = df.withColumn("p_", place(F.col(key)))
    joined = placed.join(F.broadcast(bits), F.expr("p_ div 64 = w_"), "left")
    return joined.withColumn("maybe", F.expr("coalesce((shiftright(b_, int(p_ % 64)) & 1) = 1, false)")).drop("p_", "w_", "b_")
