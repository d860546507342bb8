"""Quality rules whose thresholds follow the corpus.

Each document's measures are counted once. For every language and source a mergeable quantile sketch of each measure is
kept: counts of logarithmic buckets of relative width GAMMA, which add up exactly, so the sketches of a language, and of
all, are sums of those below. A measure's threshold is the group's upper quartile plus FENCE times its interquartile
range (a floor of the range keeps a group of equal values from rejecting the next larger one); a group of fewer than
LEAST documents takes its language's threshold, a small language that of all. Documents are joined with their group's
thresholds and kept if no measure is beyond.

Measures are shrunk by a constant so that one key or symbol in a short text isn't judged. Null texts have no words and
fail. Null languages and sources are groups of their own. Equal rows are judged alike, separately. An empty table gives
no rows. Only doc_id, text, lang and source are read; documents whose id repeats stay separate rows. Very long texts are
measured whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
#: measure: (numerator, denominator, what is added to the denominator, floor of the interquartile range)
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 200, 0.01),
    "upper_share": ("n_upper", "word_chars", 200, 0.03),
    "dup_line_share": ("n_dup_lines", "n_lines", 10, 0.05),
    "repeat_share": ("n_repeat_words", "n_words", 200, 0.03),
}
GAMMA, FENCE, LEAST = 1.02, 6.0, 200
SMALLEST = 1e-4  # smaller values share the lowest bucket
#: Groups whose thresholds are broadcast at most (about 20 MB).
MOST_GROUPS = 100_000


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that are found twice or more, counted exactly; hashes only rule texts out."""
    if len(words) <= n:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    mixed = codes[: len(codes) - n + 1].copy()
    for i in range(1, n):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    windows = list(zip(*(words[i:] for i in range(n))))
    often = Counter(windows)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero([often[w] > 1 for w in windows])
    np.add.at(marks, at, 1)
    np.add.at(marks, at + n, -1)
    return int((np.cumsum(marks) > 0).sum())


UPPER = bytes(range(65, 91))


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    upper = len(raw) - len(raw.translate(None, UPPER))
    if not text.isascii():
        upper += sum(c.isupper() for c in text if c > "\x7f")
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), upper, len(lines)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


def count_measures(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [measures(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array([r[i] for r in rows], type=pa.int64()) for i in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return few.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def sketches(values: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: a group's sketch of a measure is its rows; sketches merge by adding n."""
    stacked = values.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.greatest(F.ceil(F.log(F.greatest(F.col(m), F.lit(SMALLEST))) / F.log(F.lit(GAMMA))), F.lit(-10_000)).cast("int").alias("bucket")) for m in MEASURES))).alias("x"))
    return stacked.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The groups' thresholds of each measure, as columns, and n_docs; by: the columns that name a group."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by, "measure").orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by, "measure")))
    lowest = int(np.ceil(np.log(SMALLEST) / np.log(GAMMA)))
    value = F.when(F.col("bucket") <= lowest, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket").cast("double")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    cuts = ranked.groupBy(*by, "measure").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("total").alias("n_docs"))
    floor = F.create_map(*(F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])))
    cuts = cuts.withColumn("most", F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), floor[F.col("measure")]))
    return cuts.groupBy(*by).agg(F.max("n_docs").alias("n_docs"), *(F.max(F.when(F.col("measure") == m, F.col("most"))).alias(m) for m in MEASURES))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the measures with the thresholds that held."""
    counted = cut(count_measures(docs))
    values = counted.select("*", *((F.col(a) / (F.col(b) + add)).alias(m) for m, (a, b, add, _) in MEASURES.items()))
    sketch = sketches(values)
    own, language, overall = thresholds(sketch, ["lang", "source"]), thresholds(sketch, ["lang"]), thresholds(sketch, [])
    pick = lambda side, m: F.when(F.col(f"{side}.n_docs") >= LEAST, F.col(f"{side}.{m}"))
    table = own.alias("own").join(language.alias("language").hint("merge"), F.expr("own.lang <=> language.lang"), "left").crossJoin(F.broadcast(overall.alias("overall")))  # overall is one row
    table = table.select(F.col("own.lang").alias("g_lang"), F.col("own.source").alias("g_source"), *(F.coalesce(pick("own", m), pick("language", m), F.col(f"overall.{m}")).alias(f"most_{m}") for m in MEASURES))
    table = cut(table)
    # Languages and sources are few and hot, so their thresholds go to the documents; only a table beyond the bound is met by a shuffle.
    table = F.broadcast(table) if table.count() <= MOST_GROUPS else table.hint("merge")
    joined = values.join(table, F.expr("lang <=> g_lang AND source <=> g_source"), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    beyond = F.greatest(*(F.col(m) > F.col(f"most_{m}") for m in MEASURES))
    return joined.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & ~beyond).alias("kept"), *MEASURES, *(f"most_{m}" for m in MEASURES))
