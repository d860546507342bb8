"""URL allow and block rules by a sort-merge range join.

A host becomes its labels in reverse, each ended by "/", so the hosts that a rule fits (its own and all subdomains) are
one interval of keys: from the rule's key to the same key with its last "/" raised to "0". URLs and the two ends of
every interval are range-partitioned and sorted together; each task sweeps its part once with a stack of the open,
nested intervals and compares a URL's path with the paths of the rules on the stack. What a task needs of the parts
before it, the stack at its begin, comes from a first sweep over the interval ends alone: each part's closed and opened
intervals compose like brackets, and only those summaries (a row a part) reach the driver. A hot host is dealt over
many parts, for the sort key goes on with the path and the id.

The rules of one host lie in a table by path, so a URL tries one prefix for each length that a path of the host has. The
longest rule (host and path together) wins, the longer host on equal length; of rules of equal host and path the verdict
that sorts last ("block" over "allow"). Null URLs and those without "://" have an empty host and path and fit no rule.
Equal URLs are separate rows. Without rules every URL has the default; an empty table of pages gives no rows; very long
URLs are judged whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts

END, RULE, URL = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.when(found, F.regexp_replace(url, r"^(?s).*?://", ""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.substr(F.regexp_extract(rest, r"^([^?#]*)", 1), F.length(host) + 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


class Host:
    """The open rules of one host, by path."""

    def __init__(self, name: str):
        self.name, self.paths, self.lengths = name, {}, []

    def put(self, path: str, verdict: str) -> None:
        self.paths[path] = verdict
        self.lengths = sorted({len(x) for x in self.paths}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


class Stack:
    """The hosts whose intervals are open, one within the other."""

    def __init__(self, rules):
        self.hosts: list[Host] = []
        for r in rules:
            self.open(r)

    def open(self, rule) -> None:
        if not self.hosts or self.hosts[-1].name != rule["rule_host"]:
            self.hosts.append(Host(rule["rule_host"]))
        self.hosts[-1].put(rule["rule_path"], rule["verdict"])

    def close(self, host: str) -> None:
        """All of a host's rules end at one key."""
        self.hosts = [h for h in self.hosts if h.name != host]

    def best(self, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        fits = [(len(h.name) + len(p), len(h.name), h.name + p, h.paths[p]) for h in self.hosts if (p := h.longest(path)) is not None]
        return max(fits)[2:] if fits else None


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's interval ends: the hosts closed but not opened in it, and the rules opened but not closed."""
    closed, opened = [], {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == RULE:
                opened.setdefault(row["rule_host"], []).append({x: row[x] for x in ("rule_host", "rule_path", "verdict")})
            elif opened.pop(row["rule_host"], None) is None:
                closed.append(row["rule_host"])
    if closed or opened:
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "closed": closed, "opened": [r for rules in opened.values() for r in rules]}], schema=SUMMARY)


RULE_TYPE = pa.struct([("rule_host", pa.string()), ("rule_path", pa.string()), ("verdict", pa.string())])
SUMMARY = pa.schema([("part", pa.int32()), ("closed", pa.list_(pa.string())), ("opened", pa.list_(RULE_TYPE))])
JUDGED = pa.schema([("url_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page's host, path, winning rule and verdict; rules: host, path, verdict (rows that are equal count once)."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("url_id"), host.alias("host"), path.alias("path"))
    urls = urls.select(host_key(F.col("host")).alias("key"), F.lit(URL).alias("kind"), F.col("path").alias("sort_path"), "url_id", "host", "path", *(F.lit(None).cast(t).alias(n) for n, t in (("rule_host", "string"), ("rule_path", "string"), ("verdict", "string"))))
    one = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").dropna().groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    begin = host_key(F.col("rule_host"))
    ends = [(RULE, begin), (END, F.concat(F.substr(begin, F.lit(1), F.length(begin) - 1), F.lit("0")))]
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("url_id", "long"), ("host", "string"), ("path", "string"))]
    events = [one.select(key.alias("key"), F.lit(kind).alias("kind"), F.lit("").alias("sort_path"), *blank, "rule_host", "rule_path", "verdict") for kind, key in ends]
    order = ["key", "kind", "sort_path", "url_id", "rule_path"]
    dealt = urls.unionByName(events[0]).unionByName(events[1]).repartitionByRange(parts(pages.sparkSession), *order).sortWithinPartitions(*order)
    dealt = cut(dealt)

    # One row a part reaches the driver: what is open at a part's begin is a chain of nested rules.
    found = {r["part"]: r for r in dealt.where(F.col("kind") != URL).mapInArrow(summaries, "part int, closed array<string>, opened array<struct<rule_host: string, rule_path: string, verdict: string>>").collect()}
    opened, stack = {}, []
    for part in range(max(found, default=-1) + 1):
        opened[part] = list(stack)
        if part in found:
            gone = set(found[part]["closed"])
            stack = [x for x in stack if x["rule_host"] not in gone] + [x.asDict() for x in found[part]["opened"]]
    last = list(stack)

    def sweep(batches):
        stack = Stack(opened.get(TaskContext.get().partitionId(), last))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == RULE:
                    stack.open(row)
                elif row["kind"] == END:
                    stack.close(row["rule_host"])
                else:
                    rule, verdict = stack.best(row["path"]) or (None, default)
                    out.append((row["url_id"], row["host"], row["path"], rule, verdict))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), JUDGED)], schema=JUDGED)

    return dealt.mapInArrow(sweep, "url_id long, host string, path string, rule string, verdict string").withColumnRenamed("url_id", id_col)
