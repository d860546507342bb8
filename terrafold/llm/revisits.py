"""Not-modified revisits of a web crawl, resolved to the response that they refer to.

A revisit record (status 304) is joined as of its time to the latest earlier full response (status 200) of its canonical
URL. It is resolved if its validators don't contradict that response's: an entity tag that both have must be equal (weak
and strong alike), else a modification time that both have must be equal, else nothing can be checked and it stays
unresolved. A resolved revisit takes the response's payload digest and length; its headers are the response's with those
that a 304 may update put over them.

The as-of join has two steps, so a URL that holds a third of all records is never gathered: within a URL and a stretch
of time (BUCKET seconds) a window carries the latest full response forward; each stretch's last response, one row a
stretch, is carried to the later stretches of its URL. Payloads stay where they are; only their digests move.

Records without a URL, time or id are kept and unresolved. Of responses of equal time the one of the greater id counts,
and a revisit of the same time as a response isn't later than it. Repeated records are resolved alike. An empty table
gives no rows. Headers are a map; a null map is empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 86_400
#: Headers that a 304 response may update, lower-case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """Scheme, www., default port, fragment, tracking parameters and a final slash go; the host is in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(bare, r"\?(.*)$", 1)), rf"&(?:{TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def plain_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """The revisits of records (record_id, url, ts in seconds, status, headers map of lower-case names, digest, length) with what they refer to."""
    base = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "status", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest", "length")
    base = base.where("status IN (200, 304)").withColumn("stretch", F.expr(f"ts div {BUCKET}"))
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "headers", "digest", "length"))
    keyed = base.where("canonical_url IS NOT NULL AND ts IS NOT NULL").withColumn("full", full)

    # Ties: revisits come before responses of the same second, responses in the order of their ids.
    within = Window.partitionBy("canonical_url", "stretch").orderBy("ts", F.desc("status"), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = keyed.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("status = 304")
    order = F.struct("ts", "record_id")
    ends = keyed.where("status = 200").groupBy("canonical_url", "stretch").agg(F.max_by("full", order).alias("carried"))
    asked = near.where("near IS NULL").select("canonical_url", "stretch").distinct()
    marks = ends.unionByName(asked, allowMissingColumns=True).groupBy("canonical_url", "stretch").agg(F.first("carried", ignorenulls=True).alias("carried"))
    before = Window.partitionBy("canonical_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("earlier", F.last("carried", ignorenulls=True).over(before)).where("earlier IS NOT NULL").select(F.col("canonical_url").alias("u"), F.col("stretch").alias("s"), "earlier")
    joined = near.join(earlier.hint("merge"), (F.col("canonical_url") == F.col("u")) & (F.col("stretch") == F.col("s")), "left").withColumn("found", F.coalesce("near", "earlier"))
    lost = base.where("status = 304 AND (canonical_url IS NULL OR ts IS NULL)").withColumn("found", F.lit(None).cast(keyed.schema["full"].dataType))
    every = joined.select("record_id", "canonical_url", "ts", "headers", "found").unionByName(lost.select("record_id", "canonical_url", "ts", "headers", "found"))

    tag, was_tag = plain_tag(F.col("headers")["etag"]), plain_tag(F.col("found.headers")["etag"])
    time, was_time = F.col("headers")["last-modified"], F.col("found.headers")["last-modified"]
    by = F.when(tag.isNotNull() & was_tag.isNotNull(), tag == was_tag).when(time.isNotNull() & was_time.isNotNull(), time == was_time)
    outcome = F.when(F.col("found").isNull(), "no response").when(by.isNull(), "no validator").when(by, "resolved").otherwise("modified")
    judged = every.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    updates = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("found.headers", lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    merged = F.when(ok, F.map_concat(kept, updates))
    return judged.select("record_id", "canonical_url", "ts", "outcome", F.col("found.record_id").alias("refers_to"), (F.col("ts") - F.col("found.ts")).alias("age"), F.when(ok, F.col("found.digest")).alias("digest"), F.when(ok, F.col("found.length")).alias("length"), merged.alias("headers"))


def header_text(headers: Column) -> Column:
    """name=value pairs in the order of the names, joined by newlines; null for no map."""
    return F.when(headers.isNotNull(), F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n"))


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl's records from pages: each page is fetched in full, and asked for again twice, later.

    The second asks give the page's tag (every fifth a tag that has changed, every seventh none) and modification time
    (none for every third), and come days after the fetch.
    """
    page = pages.select(F.col("page_id").alias("p"), "url", F.md5("html").alias("digest"), F.length("html").cast("long").alias("length"))
    stamp = lambda p: F.concat(F.lit("day "), (p % 1000).cast("string"))
    tag = F.concat(F.lit('"'), F.substr("digest", F.lit(1), F.lit(12)), F.lit('"'))
    string = lambda *pairs: F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    fetched = page.select((3 * F.col("p")).alias("record_id"), "url", (F.col("p") * 61).alias("ts"), F.lit(200).alias("status"), string(F.lit("etag"), tag, F.lit("last-modified"), stamp(F.col("p")), F.lit("content-type"), F.lit("text/html"), F.lit("date"), (F.col("p") * 61).cast("string")).alias("headers"), "digest", "length")
    out = fetched
    for k, days in ((1, 1), (2, 9)):
        ts = F.col("p") * 61 + days * 86_400 + 17
        said = F.when(F.col("p") % 7 == k, F.lit(None)).when(F.col("p") % 5 == k, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
        headers = string(F.lit("etag"), said, F.lit("last-modified"), F.when(F.col("p") % 3 != k, stamp(F.col("p"))), F.lit("date"), ts.cast("string"), F.lit("server"), F.lit("cache"))
        out = out.unionByName(page.select((3 * F.col("p") + k).alias("record_id"), "url", ts.alias("ts"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("length")))
    return out
