"""Source health: error classes, counters, circuits, retries, caches and rate limits over a log of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import network_class

#: Classes worth another try.
RETRYABLE = ("TCP_TIMEOUT", "DNS_ERROR", "NETWORK_UNREACHABLE", "TCP_BLOCKED", "NETWORK_ERROR")


def classified(calls: DataFrame) -> DataFrame:
    kind = network_class(F.col("error_text"))
    return calls.withColumn("error_class", kind).withColumn("retryable", F.coalesce(kind.isin(*RETRYABLE), F.lit(False)))


def counters(calls: DataFrame) -> DataFrame:
    """source, successes, failures, last_error (null once a success came after it)."""
    told = classified(calls)
    return told.groupBy("source").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.max_by("error_class", F.struct("ts", "call_id")).alias("last_error"))


def success_windows(calls: DataFrame, width: str = "15 minutes", least: float = 0.9) -> DataFrame:
    """source, begin, n, ok, alert of tumbling windows; the same frame works on a stream with a watermark."""
    grouped = calls.groupBy("source", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    return grouped.select("source", F.col("w.start").alias("begin"), "n", "n_ok", (F.col("n_ok") < least * F.col("n")).alias("alert"))


def error_windows(calls: DataFrame, width: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """begin, error_class, n of sliding windows."""
    errors = classified(calls.where("NOT ok"))
    return errors.groupBy(F.window("ts", width, slide).alias("w"), "error_class").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "error_class", "n")


def dominant_errors(calls: DataFrame, share: float = 0.2) -> DataFrame:
    """The classes that make more than the share of a sliding window's errors."""
    per = error_windows(calls)
    total = F.sum("n").over(Window.partitionBy("begin"))
    return per.withColumn("total", total).where(F.col("n") > share * F.col("total"))


#: A source's calls are looked at in stretches of so many seconds, so a source is many tasks.
STRETCH = 3_600


def circuit(calls: DataFrame, most: int = 5) -> DataFrame:
    """Each call with the failures since its source's last success, and whether the circuit is open after it."""
    return carried_failures(calls, most)[0]


def carried_failures(calls: DataFrame, most: int = 5, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """circuit's rows, and source, left: its failures at the end; before: the same of earlier calls.

    Calls are counted within stretches; each stretch hands on one row, its failures at the end and whether it had a success.
    """
    told = calls.withColumn("stretch", F.floor(F.unix_timestamp("ts") / STRETCH))
    order = lambda *by: Window.partitionBy("source", "stretch", *by).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = told.withColumn("run_", F.count_if("ok").over(order())).withColumn("near_", F.count_if(~F.col("ok")).over(order("run_")))
    ends = near.groupBy("source", "stretch").agg(F.max_by("near_", F.struct("ts", "call_id")).alias("left"), (F.max("run_") > 0).alias("cut"))
    if before is not None:
        ends = ends.unionByName(before.select("source", F.lit(-(1 << 62)).alias("stretch"), "left", F.lit(True).alias("cut")))
    up_to = lambda *by: Window.partitionBy("source", *by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ends.withColumn("part", F.count_if("cut").over(up_to())).withColumn("at_end", F.sum("left").over(up_to("part")))
    carried = summed.withColumn("carried_", F.coalesce(F.lag("at_end").over(Window.partitionBy("source").orderBy("stretch")), F.lit(0).cast("long")))
    joined = near.join(carried.select("source", "stretch", "carried_").hint("merge"), ["source", "stretch"])
    failures = F.col("near_") + F.when(F.col("run_") == 0, F.col("carried_")).otherwise(0)
    out = joined.withColumn("failures", failures).withColumn("is_open", F.col("failures") >= most).drop("stretch", "run_", "near_", "carried_")
    return out, summed.groupBy("source").agg(F.max_by("at_end", "stretch").alias("left"))


def looking_back(calls: DataFrame, at: str, stretch: int, first: int, last: int, value: Column, name: str) -> DataFrame:
    """calls with value aggregated over their source's calls whose at is first to last away (first < 0: earlier).

    Calls are dealt by stretches of at; those that later stretches look back to go there as well, so a source is many window groups.
    """
    place = lambda x: F.floor(x / F.lit(stretch))
    copied = calls.withColumn("s_", F.explode(F.sequence(place(F.col(at)), place(F.col(at) - first))))
    told = copied.withColumn(name, value.over(Window.partitionBy("source", "s_").orderBy(at).rangeBetween(first, last)))
    return told.where(F.col("s_") == place(F.col(at))).drop("s_")


def folded_retries(calls: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """source, begin, attempts, first_ok: a request's attempts are a session of calls."""
    grouped = calls.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("attempts"), F.min(F.when(F.col("ok"), F.col("call_id"))).alias("first_ok"))
    return grouped.select("source", F.col("w.start").alias("begin"), "attempts", "first_ok")


def cached_results(requests: DataFrame, results: DataFrame, fresh_s: int = 3600, stale_s: int = 86_400) -> DataFrame:
    """Each request with the newest earlier result of its key: hit where fresh, stale where younger than stale_s, else miss.

    An as-of join by a union and a window, with time in the key's stretch of stale_s, so a hot key is many groups.
    """
    stretch = lambda c: F.expr(f"int(floor(unix_timestamp({c}) / {stale_s}))")
    marks = results.select("key", F.col("ts"), F.lit(None).cast("long").alias("request_id"), F.col("ts").alias("hit_ts"), F.explode(F.array(stretch("ts"), stretch("ts") + 1)).alias("s"))
    asks = requests.select("key", "ts", "request_id", F.lit(None).cast("timestamp").alias("hit_ts"), stretch("ts").alias("s"))
    w = Window.partitionBy("key", "s").orderBy("ts", F.desc_nulls_first("request_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = marks.unionByName(asks).withColumn("hit", F.last("hit_ts", ignorenulls=True).over(w)).where("request_id IS NOT NULL")
    age = F.unix_timestamp("ts") - F.unix_timestamp("hit")
    return joined.select("request_id", F.when(age <= stale_s, F.col("hit")).alias("hit_ts"), F.when(age <= fresh_s, "hit").when(age <= stale_s, "stale").otherwise("miss").alias("state"))


def plain_rate(calls: DataFrame, seconds: int = 60, most: int = 30) -> DataFrame:
    """Each call with the number of its source's calls in the seconds up to it, and whether they are too many."""
    timed = calls.withColumn("at_", F.unix_timestamp("ts"))
    return looking_back(timed, "at_", max(STRETCH, seconds), 1 - seconds, 0, F.count("*"), "n").drop("at_").withColumn("refused", F.col("n") > most)


def with_fallback(requests: DataFrame, primary: DataFrame, fallback: DataFrame, cache: DataFrame) -> DataFrame:
    """request_id, result, status, flags: the primary's answer, else (where enabled) the fallback's, else the cache's."""
    out = requests
    for name, side in (("p", primary), ("f", fallback), ("c", cache)):
        out = out.join(side.select("request_id", F.col("result").alias(name)).hint("merge"), "request_id", "left")
    f = F.when(F.col("fallback_enabled"), F.col("f"))
    status = F.when(F.col("p").isNotNull(), "SUCCESS").when(f.isNotNull() | F.col("c").isNotNull(), "SUCCESS_PARTIAL").otherwise("INFRA_ERROR")
    flags = F.array_compact(F.array(F.when(F.col("p").isNull(), "PRIMARY_FAILED"), F.when(F.col("p").isNull() & f.isNotNull(), "FALLBACK_USED"), F.when(F.col("p").isNull() & f.isNull() & F.col("c").isNotNull(), "STALE_CACHE")))
    return out.select("request_id", F.coalesce("p", f, "c").alias("result"), status.alias("status"), F.array_join(flags, ",").alias("flags"))
