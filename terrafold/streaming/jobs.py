"""Event-time jobs over logs of calls and edits: each takes a streaming (or plain) frame and returns one."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import STRETCH, carried_failures, classified, looking_back, success_windows
from ..operators.register import rule_map

LATE = "10 minutes"


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int | None = 1) -> DataFrame:
    """A folder's table of this name, one file or a folder of them, as a stream of its files; files None: all in one batch, for jobs that need the order of time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema)
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may also be a single file


def success_rates(calls: DataFrame) -> DataFrame:
    """T-1: success_windows of a stream; a window's state goes when the watermark has passed its end."""
    return success_windows(calls.withWatermark("ts", LATE))


def error_counts(calls: DataFrame) -> DataFrame:
    """T-2: errors of a class in sliding windows."""
    told = classified(calls.withWatermark("ts", LATE).where("NOT ok"))
    return told.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w"), "error_class").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "error_class", "n")


def debounced(edits: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """T-3: a burst of edits of a parcel's field, with gaps below the wait, becomes one save of its last value."""
    grouped = edits.withWatermark("ts", LATE).groupBy("parcel_id", "field_key", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("edits"), F.max("ts").alias("saved_at")).select("parcel_id", "field_key", "value", "edits", "saved_at")


def segments(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """calls (source, call_id, ts, before) dealt to segments that can be decided apart: with segment, at (microseconds) and copied.

    Where no call of the last seconds had more than most calls in the seconds up to it, all of them were accepted, whatever was
    before. There a new segment may begin, at most one a stretch, and these calls go to it too, as copies that are known to be accepted.
    A source under its limit is thus many segments; one that is over it all the time stays one, and is read as a stream.
    """
    width, stretch = seconds * 1_000_000, max(STRETCH, seconds) * 1_000_000
    timed = calls.withColumn("at", F.unix_micros("ts"))
    crowded = looking_back(timed, "at", stretch, 1 - width, 0, F.count("*"), "n_").withColumn("busy_", F.col("n_") > most)
    quiet = looking_back(crowded, "at", stretch, -width, -1, F.count_if("busy_"), "b_").withColumn("s_", F.floor(F.col("at") / stretch))
    starts = quiet.groupBy("source", "s_").agg(F.min(F.when(F.col("b_") == 0, F.col("at"))).alias("start_"))
    by_source = Window.partitionBy("source").orderBy("s_")
    earlier = F.last(F.when(F.col("start_").isNotNull(), F.col("s_")), ignorenulls=True).over(by_source.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(F.struct("s_", "start_")).over(by_source)
    starts = starts.withColumn("earlier_", F.coalesce(earlier, F.lit(-(1 << 62)))).withColumn("next_", F.when(after["s_"] == F.col("s_") + 1, after["start_"]))
    told = quiet.join(starts.hint("merge"), ["source", "s_"])
    own = F.when(F.col("at") >= F.col("start_"), F.col("s_")).otherwise(F.col("earlier_"))
    ahead = lambda start, s: F.when((F.col("at") < F.col(start)) & (F.col("at") > F.col(start) - width), F.struct(s.alias("segment"), F.lit(True).alias("copied")))
    places = F.array_compact(F.array(F.struct(own.alias("segment"), F.lit(False).alias("copied")), ahead("start_", F.col("s_")), ahead("next_", F.col("s_") + 1)))
    return told.select("source", "call_id", "ts", "before", "at", F.explode(places).alias("x")).select("source", "call_id", "ts", "before", "at", "x.segment", "x.copied")


def rate_limits(folder: str, most: int = 30, seconds: int = 60) -> Callable[[DataFrame, int], None]:
    """T-5 for foreachBatch, into folder/out: source, call_id, ts, accepted; a call is refused while most accepted ones of its source are less than seconds old.

    Segments of a source are decided apart; a segment's calls come sorted, a frame after the other, and only the last accepted times are
    kept, most at most. The next batch is handed the last accepted calls of each source.
    """

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, kept = None, deque()
        for calls in frames:
            accepted = []
            for name, at, sure in zip(zip(calls["source"], calls["segment"]), calls["at"], calls["before"] | calls["copied"]):
                if name != own:
                    own, kept = name, deque()
                while kept and at - kept[0] >= seconds * 1_000_000:
                    kept.popleft()
                accepted.append(sure or len(kept) < most)
                if accepted[-1]:
                    kept.append(at)
            yield calls.assign(accepted=accepted)[["source", "call_id", "ts", "before", "copied", "accepted"]]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        calls = batch.select("source", "call_id", "ts", F.lit(False).alias("before"))
        if number:
            calls = calls.unionByName(spark.read.parquet(f"{folder}/last-{number - 1}"))
        dealt = segments(calls, most, seconds).repartition("source", "segment").sortWithinPartitions("source", "segment", "at", F.desc(F.col("before") | F.col("copied")), "call_id")
        out = dealt.mapInPandas(decide, "source string, call_id long, ts timestamp, before boolean, copied boolean, accepted boolean").where("NOT copied").drop("copied")
        out.write.mode("overwrite").parquet(f"{folder}/all-{number}")
        done = spark.read.parquet(f"{folder}/all-{number}")
        done.where("NOT before").select("source", "call_id", "ts", "accepted").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        ends = done.groupBy("source").agg(F.max("ts").alias("end"))
        last = done.where("accepted").join(ends.hint("merge"), "source").where(F.col("ts") > F.col("end") - F.expr(f"INTERVAL {seconds} SECONDS"))
        last.select("source", "call_id", "ts", F.lit(True).alias("before")).write.mode("overwrite").parquet(f"{folder}/last-{number}")

    return run


def circuit_states(folder: str, most: int = 5) -> Callable[[DataFrame, int], None]:
    """T-4 for foreachBatch: source, call_id, ts, failures since the last success, is_open, into folder/out; a batch hands on one row a source."""

    def run(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.parquet(f"{folder}/last-{number - 1}") if number else None
        out, left = carried_failures(batch.select("source", "call_id", "ts", "ok"), most, before)
        out.select("source", "call_id", "ts", "failures", "is_open").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        left.write.mode("overwrite").parquet(f"{folder}/last-{number}")

    return run


def retries(calls: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """T-6: a source's attempts, folded by session, with the first that succeeded."""
    grouped = calls.withWatermark("ts", LATE).groupBy("source", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("attempts"), F.min(F.when(F.col("ok"), F.col("call_id"))).alias("first_ok")).select("source", F.col("w.start").alias("begin"), "attempts", "first_ok")


def cached(asks: DataFrame, fresh_s: int = 3600, stale_s: int = 86_400) -> DataFrame:
    """T-7: request_id, hit_ts, state (hit, stale or miss) of requests answered from a cache whose entries live for stale_s.

    asks: key, ts, request_id (null for a result that is put into the cache). State is the newest result's time, for each key and stretch of
    stale_s; a result counts for its own stretch and the next, so a hot key is many groups. A stretch's state goes when the watermark
    has passed its end. Rows of a batch are taken in the order of time, results before requests of the same moment.
    """
    live = stale_s * 1_000_000
    timed = asks.withWatermark("ts", LATE).select("key", "ts", "request_id", F.unix_micros("ts").alias("at"))
    stretch = F.floor(F.col("at") / live)
    dealt = timed.withColumn("s", F.explode(F.when(F.col("request_id").isNull(), F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))

    def answer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        put = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"], na_position="first")
        result = rows["request_id"].isna().to_numpy()
        at = rows["at"].to_numpy()
        newest = np.maximum.accumulate(np.concatenate([[put], np.where(result, at, -1)]))
        state.update((int(newest[-1]),))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * stale_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"].to_numpy()[~result].astype("int64"), "at": at[~result], "put": newest[1:][~result]})

    told = dealt.groupBy("key", "s").applyInPandasWithState(answer, "request_id long, at long, put long", "put long", "append", GroupStateTimeout.EventTimeTimeout)
    age = F.floor(F.col("at") / 1_000_000) - F.floor(F.col("put") / 1_000_000)
    known = (F.col("put") >= 0) & (age <= stale_s)
    return told.select("request_id", F.when(known, F.timestamp_micros("put")).alias("hit_ts"), F.when(known & (age <= fresh_s), "hit").when(known, "stale").otherwise("miss").alias("state"))


EDITS = "id long, ts timestamp, parcel_id long, field_key string, value double"
RULES = "parcel_id long, rules map<string, string>, provenance map<string, string>"


def places(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Of each bucket the batch that wrote it last, as of the last whole batch (below `before`); as many entries as there are buckets."""
    try:
        told = spark.read.schema("bucket int, version int, batch int").parquet(f"{folder}/places")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    told = told if before is None else told.where(F.col("batch") < before)
    last = told.agg(F.max("batch").alias("batch"))
    return {r["bucket"]: r["version"] for r in told.join(last.hint("merge"), "batch").collect()}


def bucketed(spark: SparkSession, folder: str, name: str, schema: str, at: dict[int, int]) -> DataFrame:
    """A bucketed table's rows in the versions given."""
    if not at:
        return spark.createDataFrame([], schema)
    kept = ", ".join(f"({v}, {b})" for b, v in sorted(at.items()))
    return spark.read.schema(schema + ", version int, bucket int").parquet(f"{folder}/{name}").where(f"(version, bucket) IN ({kept})").drop("version", "bucket")


def refresh_rules(folder: str, buckets: int = 64, spread: int = 4) -> Callable[[DataFrame, int], None]:
    """T-8 for foreachBatch: puts field edits over the stored ones, the latest by event time and id, and makes the parcels' rule maps anew.

    Edits and rules lie in buckets by parcel. A batch writes new versions of the buckets that it touches, then, last, where each bucket
    lies; other buckets' files stay as they are, readers never see half a batch, and a batch that comes again writes the same.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("parcel_id"), F.lit(buckets)).cast("int").alias("bucket")
        new = batch.select("id", F.col("ts").cast("timestamp").alias("ts"), "parcel_id", "field_key", F.col("value").cast("double").alias("value"))
        known = places(spark, folder, number)
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]
        stored = bucketed(spark, folder, "edits", EDITS, {b: known[b] for b in touched if b in known})
        row = F.struct("id", "ts", "value")
        merged = stored.unionByName(new).groupBy("parcel_id", "field_key").agg(F.max_by(row, F.struct("ts", "id")).alias("x")).select("x.id", "x.ts", "parcel_id", "field_key", "x.value")
        part = F.pmod(F.xxhash64("parcel_id", F.lit(1)), F.lit(spread))
        put = lambda df, name: df.withColumn("bucket", bucket).repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}/version={number}")
        put(merged, "edits")
        put(rule_map(bucketed(spark, folder, "edits", EDITS, {b: number for b in touched})), "rules")
        told = sorted((known | {b: number for b in touched}).items())
        spark.createDataFrame(told, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/places/batch={number}")

    return run


def current_rules(spark: SparkSession, folder: str) -> DataFrame:
    """parcel_id, rules, provenance as of the last whole batch."""
    return bucketed(spark, folder, "rules", RULES, places(spark, folder))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there, appends to folder/out, and gives the result as a plain frame."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def drained_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], folder: str) -> DataFrame:
    """Runs a foreachBatch job over all that is there; what it has written to folder/out, without the batch."""
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def drained_updates(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Runs an aggregation over all that is there and gives each key's last row, so windows that are still open at the end count.

    State is bounded by the stream's watermark; each batch writes the rows that it changed.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    names = [c for c in stream.columns if c not in keys]
    last = stream.sparkSession.read.parquet(f"{folder}/out").groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)
