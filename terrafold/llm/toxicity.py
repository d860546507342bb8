"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Learning takes a sample of the labelled rows, chosen by a hash of their id, of about SAMPLE rows (the documented bound;
fewer labelled rows are all taken), and deals it into three folds by another hash:

* lexicon: words and word beginnings of FIRST to LAST letters that mark toxic rows (SUPPORT of them or more, EDGE times
  the odds of other rows) join the written words of INSULTS; at most LEXICON of them, the strongest.
* trees: Spark's gradient-boosted trees over the features below.
* calibration: Spark's isotonic regression of the label on the trees' probability.

Features of a whole text: density of written and of learned lexicon words, and of learned ones of distinct spelling; the
strongest learned word's and the mean weight; the share of lexicon words within NEAR words of a second-person word; shares of capitals and of
words in capitals, rates of punctuation, of exclamation and question marks and of repeated ones; rates of obfuscated
words (digits or signs among letters), of lexicon words found only when those are read as letters, and of words spelled out
letter by letter; the logarithm of the number of words. Labels, languages, sources and ids are no features.

Scoring is one pass over the documents without a shuffle; the lexicon is broadcast (at most LEXICON entries), trees and
calibration are Spark's own models. Null and empty texts have no words and are scored like any other. Rows that share an
id, and equal rows, are scored separately; several labels of one id count by their mean (a half or more is toxic), null labels not at all.
Very long texts are read whole. An empty table gives no rows. Without labelled rows of both kinds in each fold there is
nothing to learn, and the score is the density of written words, scaled by PRIOR. Only doc_id and text, and the labels'
doc_id and toxic, are read. Ties at the threshold are toxic.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, maybe_in

SAMPLE, LEXICON, SUPPORT, EDGE, FIRST, LAST = 20_000, 2_000, 5, 20.0, 4, 6
NEAR, THRESHOLD, PRIOR, KEPT = 5, 0.7, 100.0, 200_000
TREES, DEPTH, STEP = 20, 3, 0.3
#: Plain insults in the four languages, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb imbecile jerk bastard bitch asshole "
    "idiotisch dumm dummkopf abschaum versager arschloch widerlich wertlos trottel "
    "stupide imbécile crétin connard ordure débile minable salaud "
    "idiota estúpido estúpida imbécil basura perdedor asqueroso inútil payaso cabrón".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split())
#: Signs read as letters.
LOOKS_LIKE = [str.maketrans("013457@$!|€", f"o{one}eastasiie") for one in "il"]
EDGES = ".,;:!?\"'()[]{}<>*_-`~«»„“”¡¿…"
WRITTEN, LEARNED, SECOND, CAPITALS, OBFUSCATED, HIDDEN, SINGLE = (1 << i for i in range(7))
FEATURES = (
    "written_density", "learned_density", "distinct_density", "strongest", "mean_weight", "near_second_person", "capital_share", "capital_words",
    "punctuation_rate", "exclamation_rate", "question_rate", "repeated_marks", "obfuscation_rate", "hidden_density", "spelled_out", "log_words",
)


def terms(word: str) -> list[str]:
    """What of a bare lower-case word may be in the lexicon: the word, and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in range(FIRST, min(LAST, len(word) - 1) + 1))] if len(word) >= 3 else []


class WordSigns(dict):
    """What each written word shows: its flags and its weight in the learned lexicon; kept while there are few of them."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def weight(self, bare: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(bare)), default=0.0)

    def __missing__(self, word: str) -> tuple[int, float]:
        stripped = word.strip(EDGES)
        bare = stripped.lower()
        weight, flags = self.weight(bare), 0
        if bare in INSULTS:
            flags |= WRITTEN
        if weight:
            flags |= LEARNED
        if bare in SECOND_PERSON:
            flags |= SECOND
        if len(stripped) >= 3 and stripped.isupper():
            flags |= CAPITALS
        if len(bare) == 1 and bare.isalpha():
            flags |= SINGLE
        if len(bare) >= 4 and not bare.isalpha() and sum(map(str.isalpha, bare)) >= 2:
            flags |= OBFUSCATED
            plain = ["".join(c for c in bare.translate(t) if c.isalpha()) for t in LOOKS_LIKE]
            if any(p in INSULTS or self.weight(p) for p in plain) and not flags & (WRITTEN | LEARNED):
                flags |= HIDDEN
        if len(self) > KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = flags, weight
        return flags, weight


def features(text: str | None, signs: WordSigns) -> list[float]:
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    seen = [signs[w] for w in words]
    flags = np.fromiter((f for f, _ in seen), dtype=np.int64, count=len(seen))
    hits = np.flatnonzero(flags & (WRITTEN | LEARNED | HIDDEN))
    weights = [seen[i][1] for i in hits]
    second = np.flatnonzero(flags & SECOND)
    close = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(hits - second[np.minimum(at, len(second) - 1)]), np.abs(hits - second[np.maximum(at - 1, 0)]))
        close = int((gap <= NEAR).sum())
    share = lambda flag: float(np.count_nonzero(flags & flag)) / n
    single = (flags & SINGLE) > 0
    spelled = int((single[2:] & single[1:-1] & single[:-2]).sum()) if len(single) > 2 else 0
    distinct = len({words[i].strip(EDGES).lower() for i in hits})
    marks = sum(map(text.count, ".,;:!?"))
    return [
        share(WRITTEN), share(LEARNED), distinct / n, max(weights, default=0.0), sum(weights) / n, close / n, (sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.encode().translate(None, CAPITAL_BYTES))) / size, share(CAPITALS),
        marks / size, text.count("!") / size, text.count("?") / size, sum(map(text.count, ("!!", "??", "!?"))) / n, share(OBFUSCATED), share(HIDDEN), spelled / n, math.log1p(len(words)),
    ]


CAPITAL_BYTES = bytes(range(65, 91))


def with_features(docs: DataFrame, lexicon: dict[str, float], extra: str = "") -> DataFrame:
    """The documents' features; extra: further columns after doc_id and text, with their types, that stay."""
    told = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        signs = WordSigns(told.value)
        for batch in batches:
            rows = np.array([features(x.as_py(), signs) for x in batch.column(1)], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], [batch.schema.names[0], *batch.schema.names[2:], *FEATURES])

    return docs.mapInArrow(run, "doc_id long, " + extra + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, label, fold of the rows that learning takes."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("double").alias("label"))
    known = cut(known)
    share = most / max(most, known.count())
    place = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 20))
    known = known.where(place < F.lit(int(share * (1 << 20)))).withColumnRenamed("doc_id", "own_")
    likely = maybe_in(docs, "doc_id", known.select("own_")).where("maybe").select("doc_id", "text")
    return cut(likely.join(known.hint("merge"), F.expr("doc_id = own_")).select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int").alias("fold")))


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """The LEXICON strongest terms of toxic rows, with the logarithm of their odds; counted over the rows."""

    def run(batches):
        for batch in batches:
            toxic, all_ = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = {t for w in {w.strip(EDGES).lower() for w in set((text or "").split())} if len(w) <= 64 for t in terms(w)}
                all_.update(some)
                if label:
                    toxic.update(some)
            yield pa.RecordBatch.from_arrays([pa.array(list(toxic), type=pa.string()), pa.array([toxic[t] for t in toxic], type=pa.int64()), pa.array([all_[t] - toxic[t] for t in toxic], type=pa.int64())], ["term", "a", "b"])
            rest = [t for t in all_ if t not in toxic]
            yield pa.RecordBatch.from_arrays([pa.array(rest, type=pa.string()), pa.array([0] * len(rest), type=pa.int64()), pa.array([all_[t] for t in rest], type=pa.int64())], ["term", "a", "b"])

    totals = rows.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    counted = rows.select("text", "label").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = (F.col("a") / (toxic + 1.0)) / ((F.col("b") + 0.5) / (clean + 1.0))
    strong = counted.where(F.col("a") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= EDGE)
    return {r["term"]: math.log(r["odds"]) for r in strong.orderBy(F.desc("odds"), F.desc("a"), "term").limit(LEXICON).collect()}


def both_kinds(rows: DataFrame, fold) -> bool:
    return rows.where(fold).select("label").distinct().count() == 2


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, and the features, of every document."""
    docs = id_text(docs)
    rows = sample(docs, labels, most)
    trees_fold, isotonic_fold = F.col("fold").isin(2, 3), F.col("fold") == 4
    learnable = both_kinds(rows, trees_fold) and both_kinds(rows, isotonic_fold)
    lexicon = learned_lexicon(rows.where("fold < 2")) if learnable else {}
    ready = with_features(docs, lexicon).withColumn("held_out", held_out(F.col("doc_id")))
    names = ["doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), *FEATURES]
    if not learnable:
        return ready.withColumn("score", F.least(F.lit(1.0), PRIOR * F.col("written_density"))).select(*names)
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="inputs_")
    taught = cut(assemble.transform(with_features(rows.where("fold > 1").select("doc_id", "text", "label", "fold"), lexicon, "label double, fold int, ")).select("label", "fold", "inputs_"))
    trees = GBTClassifier(featuresCol="inputs_", labelCol="label", predictionCol="guess_", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=3, cacheNodeIds=False, seed=7).fit(taught.where(trees_fold))
    chance = lambda df: trees.transform(df).withColumn("chance_", vector_to_array("probability")[1])
    isotonic = IsotonicRegression(featuresCol="chance_", labelCol="label", predictionCol="fitted_").fit(chance(taught.where(isotonic_fold)).select("chance_", "label"))
    scored = isotonic.transform(chance(assemble.transform(ready)))
    return scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fitted_")))).select(*names)
