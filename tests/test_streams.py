"""Stream jobs: exact limits, caches, bucketed state, commits and intake, over several batches and restarts."""

import datetime as dt
import os
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from terrafold.operators import health
from terrafold.sources.sinks import commit, committed, failed, manifest
from terrafold.streaming import intake as I
from terrafold.streaming import jobs

START = dt.datetime(2026, 1, 1)
CALLS = "source string, call_id long, ts timestamp"


def seconds(x):
    return START + dt.timedelta(seconds=x)


def limited(rows, most, width):
    """call_id: accepted, one call after the other."""
    kept, out = {}, {}
    for source, call_id, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        last = kept.setdefault(source, deque())
        while last and (ts - last[0]).total_seconds() >= width:
            last.popleft()
        out[call_id] = len(last) < most
        if out[call_id]:
            last.append(ts)
    return out


def bursts(seed, hours=30):
    """One source: quiet hours, bursts over the limit, times of many equal moments."""
    r, t, rows = random.Random(seed), 0.0, []
    while t < hours * 3600:
        dense = r.random() < 0.4
        for _ in range(r.randint(5, 120)):
            t += r.choice([0, 0.25, 1, 1.5, 3]) if dense else r.choice([1.9, 2, 30, 200])
            rows.append(("a", len(rows), seconds(t)))
        t += r.choice([0, 59, 60, 61, 4000])
    return rows


@pytest.mark.parametrize("most, width", [(30, 60), (1, 60), (3, 4_000)])
def test_exact_limit_of_one_source(spark, tmp_path, most, width):
    rows = bursts(most)
    run = jobs.rate_limits(str(tmp_path), most, width)
    calls = spark.createDataFrame(rows, CALLS)
    run(calls.where(F.col("call_id") < 700), 0)
    run(calls.where(F.col("call_id") >= 700), 1)
    got = {r["call_id"]: r["accepted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = limited(rows, most, width)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_one_source_is_many_segments(spark):
    rows = bursts(30)
    calls = spark.createDataFrame(rows, CALLS).withColumn("before", F.lit(False))
    dealt = jobs.segments(calls, 30, 60).where("NOT copied")
    assert dealt.count() == len(rows) and dealt.select("segment").distinct().count() > 10
    steady = spark.createDataFrame([("a", i, seconds(i)) for i in range(8_000)], CALLS).withColumn("before", F.lit(False))
    assert jobs.segments(steady, 30, 60).select("segment").distinct().count() == 1


def test_looking_back_over_stretches(spark):
    rows = bursts(3, 4)
    calls = spark.createDataFrame(rows, CALLS)
    got = {r["call_id"]: (r["n"], r["refused"]) for r in health.plain_rate(calls).collect()}
    whole = [int((ts - START).total_seconds()) for _, _, ts in rows]
    want = {i: sum(t - 59 <= x <= t for x in whole) for i, t in enumerate(whole)}
    assert got == {i: (n, n > 30) for i, n in want.items()}


def test_cache_states(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "b", "c"]), seconds(r.randint(0, 400_000)), None if r.random() < 0.1 else i) for i in range(900)] + [("hot", seconds(500), None), ("hot", seconds(500), 2000), ("b", seconds(500 + 86_400), 2001)]
    asks = spark.createDataFrame(rows, "key string, ts timestamp, request_id long")
    asks.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(asks.schema).parquet(f"{tmp_path}/in")
    got = jobs.drained(jobs.cached(stream), f"{tmp_path}/s")
    want = health.cached_results(asks.where("request_id IS NOT NULL"), asks.where("request_id IS NULL").select("key", "ts"))
    same = lambda df: sorted(map(tuple, df.select("request_id", "hit_ts", "state").collect()))
    assert same(got) == same(want) and {r["state"] for r in got.collect()} == {"hit", "stale", "miss"}


def edits(spark, rows):
    return spark.createDataFrame([(i, seconds(t), p, k, v) for i, t, p, k, v in rows], jobs.EDITS)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_rule_refresh(spark, tmp_path):
    run = jobs.refresh_rules(str(tmp_path), buckets=8)
    first = edits(spark, [(i, 100, i, "height", float(i)) for i in range(40)] + [(100, 100, 3, "roof", 1.0), (101, 100, 4, "parcelReference", 1.0)])
    run(first, 0)
    before = {**files(f"{tmp_path}/edits"), **files(f"{tmp_path}/rules")}
    late = edits(spark, [(200, 50, 3, "height", 77.0), (201, 500, 3, "roof", 8.0), (202, 500, 3, "roof", 9.0)])
    run(late, 1)
    run(late, 1)  # a batch that comes again
    got = {r["parcel_id"]: (r["rules"], r["provenance"]) for r in jobs.current_rules(spark, str(tmp_path)).collect()}
    assert len(got) == 40 and got[3] == ({"height": "3.0", "roof": "9.0"}, {"height": "3", "roof": "202"}) and got[5][0] == {"height": "5.0"}
    after = {**files(f"{tmp_path}/edits"), **files(f"{tmp_path}/rules")}
    assert all(after[f] == t for f, t in before.items())
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(b) for b, v in jobs.places(spark, str(tmp_path)).items() if v == 1}
    run(edits(spark, [(300, 900, 10_000, "parcelReference", 1.0)]), 2)
    assert jobs.current_rules(spark, str(tmp_path)).count() == 40


def test_commits(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "x")
    bad = rows.select(F.raise_error(F.lit("no")).cast("long").alias("x"))
    at = str(tmp_path)
    assert committed(spark, at, "a", "x long").count() == 0 and manifest(spark, at).count() == 0
    got = commit({"a": rows, "b": bad}, at, 0)
    assert got["a"] == "ok" and got["b"].startswith("error")
    commit({"a": rows.where("x < 3"), "b": rows}, at, 1)
    rows.withColumn("batch", F.lit(2)).write.mode("append").partitionBy("batch").parquet(f"{at}/a")  # written, not committed
    assert committed(spark, at, "a", "x long").count() == 13 and committed(spark, at, "b", "x long").count() == 10
    assert [(r["table"], r["batch"]) for r in failed(spark, at).collect()] == [("b", 0)]
    assert commit({"a": rows.where("x < 1"), "b": rows}, at, 0) == {"a": "ok", "b": "ok"}  # only b is written
    assert committed(spark, at, "a", "x long").count() == 13 and failed(spark, at).count() == 0
    assert {(r["table"], r["batch"]): r["n"] for r in manifest(spark, at).collect()} == {("a", 0): 10, ("b", 0): 10, ("a", 1): 3, ("b", 1): 10}


UPLOADS = "doc_id long, name string, media_type string, size long, document_type string, uploaded_at timestamp, page int, text string"


def uploads(spark, ids):
    text = "Maksymalna wysokość zabudowy: 9 m\nwypis i wyrys z mpzp, działka nr 5, obręb 7"
    rows = []
    for i in ids:
        name, kind, size, type_ = [("a.pdf", "application/pdf", 10, "PLAN"), ("b.exe", "application/pdf", 10, "PLAN"), ("c.pdf", "text/plain", 10, "PLAN"), ("d.png", "image/png", 0, "MAP"), ("e.png", "image/png", 1 << 30, "MAP"), ("f.pdf", "application/pdf", 5, " "), ("", "application/pdf", 5, "MAP"), ("g.PNG", "IMAGE/PNG", 5, "MAP")][i % 8]
        rows += [(i, name, kind, size, type_, seconds(i * 700), page, text if page == 1 else None) for page in (1, 2)]
    return spark.createDataFrame(rows, UPLOADS)


def test_intake_restarts(spark, tmp_path):
    for k, ids in enumerate((range(0, 20), range(20, 40), range(40, 48))):
        uploads(spark, ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 1:
            continue  # two files wait for the second run
        stream = spark.readStream.schema(UPLOADS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        I.intake(stream, f"{tmp_path}/out")
    out = f"{tmp_path}/out"
    rows = {r["doc_id"]: r for r in I.outcomes(spark, out).collect()}
    assert len(rows) == 48 and manifest(spark, out).select("batch").distinct().count() == 3
    assert {i % 8: r["reject_reason"] for i, r in rows.items()} == {0: None, 1: "EXTENSION", 2: "MEDIA_TYPE", 3: "EMPTY", 4: "TOO_LARGE", 5: "TYPE", 6: "NAME", 7: None}
    assert [rows[i]["version"] for i in range(0, 48, 8)] == [1, 2, 3, 4, 5, 6] and [rows[i]["version"] for i in range(7, 48, 8)] == [1, 2, 3, 4, 5, 6]
    assert rows[0]["n_fields"] == 1 and rows[0]["file_type"] == "MPZP_WYPIS_WYRYS"
    before = files(out)
    I.take_in(out)(uploads(spark, range(40, 48)), 2)  # the last batch comes again, as after a crash before Spark's own commit
    assert files(out) == before
