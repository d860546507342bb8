"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is coded as a space, its lower-cased words, each ended by a space, and one end mark, a newline. A byte is
predicted from up to ORDER bytes before it, across words, back to the text's first space. The trie's nodes are contexts
with the counts of the bytes that followed them in the training texts. Coding starts at the longest context: a context
with N occurrences of q different bytes gives a seen byte n / (N + q) and the escape q / (N + q) (method C); after an
escape the bytes seen in the longer context are excluded from the shorter one's counts, and below order 0 the bytes never
seen share the rest.

score_stream: a gram is a context and the byte coded in it. Tasks count their texts' grams; the counts are added by key,
and dealt out by the context's last LOW + 1 bytes, so all longer contexts that end alike meet in a task; the counts of
contexts of at most LOW bytes (bounded by their number) are broadcast. The HOT_GRAMS most frequent grams' code lengths
(a fixed number) are broadcast and summed where the text is read; a text's other grams are joined by a shuffle, so no
gram is hot there. The same join sums the base model's words, of which the HOT most frequent are broadcast as well.
Words and grams are told apart by 64-bit hashes in that join.

score: the same with contexts that end at the space before the word, so that word order doesn't count; a word's code
length is the same wherever it stands, and words are coded once, as joins of one table an order.

All texts are scored; those whose remainder is HELD are only scored. Null texts count as empty: just an end. A null id
is trained on. Without training texts all counts are 0. Rows that repeat count each time. Very long words are coded
whole. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, id_text, parts, steps

ORDER = 5
#: Words that are broadcast at most, with their counts and code lengths (about 10 MB).
HOT = 100_000
#: Coded bytes in context up to which their table is broadcast to the words; a larger one is joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Grams that are broadcast at most, with their code lengths (16 MB; 64 MB as a table).
HOT_GRAMS = 1_000_000
#: Contexts of so many bytes at most are broadcast with their counts.
LOW = 2
#: Different grams that a task keeps before it passes their counts on.
KEPT_GRAMS = 1_000_000
END = b"\n"


def held_out(modulus: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes.lower changes A-Z only


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (its count in the texts not held out, 0 if only others have it); the end mark counts as a word."""

    def run(batches):
        seen: Counter = Counter()
        other: set = set()

        def flush():
            words = [*seen, *(other - seen.keys())]
            batch = pa.RecordBatch.from_arrays([pa.array(words, type=pa.binary()), pa.array([seen.get(w, 0) for w in words], type=pa.int64())], ["word", "c"])
            seen.clear()
            other.clear()
            return batch

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = lowered(text.as_py())
                if held:
                    other.update(words)
                    other.add(END)
                else:
                    seen.update(words)
                    seen[END] += 1
                if len(seen) + len(other) > 400_000:
                    yield flush()
        if seen or other:
            yield flush()

    return docs.select("held_out", "text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def coded(words: DataFrame, order: int) -> DataFrame:
    """Every byte that is coded of every word: the columns of words, context (space first, at most order bytes), byte."""
    # Hexadecimal text keeps bytes apart in string functions: two digits a byte.
    whole = F.concat(F.lit("20"), F.hex("word"), F.when(F.col("word") == F.lit(END), F.lit("")).otherwise(F.lit("20")))
    at = F.explode(F.sequence(F.lit(1), F.expr("length(hex_) div 2 - 1")))
    out = words.withColumn("hex_", whole).select(*words.columns, "hex_", at.alias("at_"))
    first = F.greatest(F.lit(0), F.col("at_") - order)
    return out.select(*words.columns, F.substr("hex_", 2 * first + 1, 2 * (F.col("at_") - first)).alias("context"), F.substr("hex_", 2 * F.col("at_") + 1, F.lit(2)).alias("byte"))


def trie(counts: DataFrame, order: int) -> list[DataFrame]:
    """Tables of the contexts of 0 to order bytes: context, n (byte -> count), total, kinds; counts: context, byte, n."""
    longest, levels = None, [None] * (order + 1)
    for size in range(order, -1, -1):
        own = counts.where(F.length("context") == 2 * size)
        if longest is not None:
            own = own.unionByName(longest.select(F.substr("context", F.lit(3), F.lit(2 * order)).alias("context"), "byte", "n"))
        longest = cut(own.groupBy("context", "byte").agg(F.sum("n").alias("n")).repartition(parts(counts.sparkSession)))
        levels[size] = longest.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("byte", "n"))).alias("seen"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return levels


def code_lengths(wanted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """context, byte, bits10 (the byte's log10 probability) of the wanted bytes in context."""
    state = wanted.select("context", "byte", F.col("context").alias("at"), F.lit(0.0).alias("sum"), F.lit(False).alias("done"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("out"))
    for size in range(len(levels) - 1, -1, -1):
        node = levels[size].withColumnRenamed("context", "at_node").hint("merge")
        # Only those at this length look their context up; longer ones were cut before.
        state = state.withColumn("at", F.when(F.length("at") > 2 * size, F.substr("at", F.length("at") - 2 * size + 1, F.lit(2 * size))).otherwise(F.col("at")))
        joined = state.join(node, (F.length("at") == 2 * size) & (F.col("at") == F.col("at_node")), "left")
        left = "total - aggregate(map_keys(out), 0L, (s, b) -> s + coalesce(seen[b], 0L))"
        state = joined.withColumn("left", F.expr(left)).withColumn("new", F.expr("kinds - size(out)")).withColumn("n", F.expr("seen[byte]"))
        found, live = F.col("n").isNotNull() & ~F.col("done"), F.col("total").isNotNull() & ~F.col("done")
        denominator = F.col("left") + F.col("new")
        gain = F.when(found, F.log10(F.col("n") / denominator)).when(live & (F.col("new") > 0), F.log10(F.col("new") / denominator)).otherwise(0.0)
        state = state.select("context", "byte", "at", (F.col("sum") + gain).alias("sum"), (F.col("done") | found).alias("done"), F.when(live & ~found, F.col("seen")).otherwise(F.col("out")).alias("out"))
    rest = -F.log10(F.lit(256.0) - F.size("out"))
    return state.select("context", "byte", (F.col("sum") + F.when(F.col("done"), 0.0).otherwise(rest)).alias("code"))


def score_words(words: DataFrame, order: int = ORDER) -> DataFrame:
    """The words table with code, each word's log10 probability."""
    spark = words.sparkSession
    parted = coded(words.where("c > 0").select("word", "c"), order).groupBy("context", "byte").agg(F.sum("c").alias("n"))
    counts = cut(parted.repartition(parts(spark)))
    wanted = coded(words.select("word"), order).select("context", "byte").distinct()
    codes = cut(code_lengths(wanted, trie(counts, order)).select(F.xxhash64("context", "byte").alias("pair"), "code").repartition(parts(spark)))
    codes = F.broadcast(codes) if codes.count() <= MOST_BROADCAST else codes.hint("merge")
    pairs = coded(words, order).select("word", "c", F.xxhash64("context", "byte").alias("pair"))
    return pairs.join(codes, "pair").groupBy("word", "c").agg(F.sum("code").alias("code"))


def gram_steps(texts: list[str | None], order: int, limit: int = STEP_BYTES // 4):
    """Arrays of about limit bytes' grams, with the number of the text that each is of.

    A gram is an integer: a 1 before the context's and the coded byte's eight bits each, so grams of other lengths differ.
    """
    owners, pieces, skips, size = [], [], [], 0

    def flush():
        sizes = np.array([len(x) for x in pieces])
        u = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        v = u.copy()
        for j in range(1, order + 1):
            v[j:] |= u[:-j] << 8 * j
        place = np.arange(len(u)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = place >= np.repeat(skips, sizes)
        tops = np.int64(1) << 8 * (np.minimum(place[keep], order) + 1)
        return np.repeat(owners, sizes)[keep], (v[keep] & (tops - 1)) | tops

    for i, text in enumerate(texts):
        s = b" ".join([b"", *lowered(text), END])
        for a in range(0, len(s), limit):
            first = max(0, a - order)
            owners.append(i)
            pieces.append(s[first : a + limit])
            skips.append(a - first if a else 1)
            size += len(pieces[-1])
            if size >= limit:
                yield flush()
                owners, pieces, skips, size = [], [], [], 0
    if pieces:
        yield flush()


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, *counts
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(c[at], first) for c in counts)


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """gram, n (its count in the texts not held out), m (its count in all texts)."""

    def run(batches):
        kept: list = []

        def merged():
            return added(*(np.concatenate(c) for c in zip(*kept)))

        def rows(found):
            for a in range(0, len(found[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in found], ["gram", "n", "m"])

        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in steps(sizes):
                held = np.array(batch.column(0).slice(a, b - a).to_pylist(), dtype=bool)
                for owner, grams in gram_steps(batch.column(1).slice(a, b - a).to_pylist(), order):
                    only = held[owner]
                    for part, trained in ((grams[~only], True), (grams[only], False)):
                        part.sort()
                        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, dtype=np.int64)
                        m = np.diff(np.append(first, len(part)))
                        kept.append((part[first], m if trained else np.zeros_like(m), m))
                    if sum(len(k[0]) for k in kept) > KEPT_GRAMS:
                        kept = [merged()]
                        if len(kept[0][0]) > KEPT_GRAMS // 2:
                            yield from rows(kept[0])
                            kept = []
        if kept:
            yield from rows(merged())

    return docs.select("held_out", "text").mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Level:
    """The contexts of one length: sorted pairs (context and byte) with counts, and each context's total, kinds and, of its kinds, the count in the context one byte shorter."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, below: Level | None, size: int):
        self.pairs, self.n = pairs, n
        self.nodes, first = np.unique(pairs >> 8, return_index=True)
        self.total = np.add.reduceat(n, first) if len(first) else n
        self.kinds = np.diff(np.append(first, len(pairs)))
        shorter = below.n[np.searchsorted(below.pairs, pairs & ((1 << 8 * size) - 1))] if below else n
        self.shadow = np.add.reduceat(shorter, first) if len(first) else n


def found_at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the sorted table has each key, and its place."""
    if not len(table):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def levels_of(grams: np.ndarray, n: np.ndarray, sizes: range, levels: list[Level]) -> list[Level]:
    """levels, and those of the sizes after them, which all grams with such contexts are given for."""
    levels = list(levels)
    grams, n = grams[n > 0], n[n > 0]
    for size in sizes:
        sel = grams >= 1 << 8 * (size + 1)
        pairs, counts = added(grams[sel] & ((1 << 8 * (size + 1)) - 1), n[sel])
        levels.append(Level(pairs, counts, levels[-1] if levels else None, size))
    return levels


def gram_codes(grams: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probabilities of the grams."""
    code = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    kinds, shadow = np.zeros(len(grams), dtype=np.int64), np.zeros(len(grams), dtype=np.int64)  # of the longer context
    for size in range(len(levels) - 1, -1, -1):
        level = levels[size]
        here = open_[grams[open_] >= 1 << 8 * (size + 1)]
        pair = grams[here] & ((1 << 8 * (size + 1)) - 1)
        known, node = found_at(level.nodes, pair >> 8)
        here, pair, node = here[known], pair[known], node[known]
        left, new = level.total[node] - shadow[here], level.kinds[node] - kinds[here]
        seen, at = found_at(level.pairs, pair)
        code[here[seen]] += np.log10(level.n[at[seen]] / (left + new)[seen])
        escaped = ~seen & (new > 0)
        code[here[escaped]] += np.log10(new[escaped] / (left + new)[escaped])
        kinds[here], shadow[here] = level.kinds[node], level.shadow[node]
        open_ = np.setdiff1d(open_, here[seen], assume_unique=True)
    code[open_] -= np.log10(256 - kinds[open_])
    return code


def code_grams(counted: DataFrame, order: int) -> DataFrame:
    """gram, m, code (its log10 probability) of counted grams; order: more than LOW, at most 6."""
    spark = counted.sparkSession
    if not LOW < order <= 6:
        raise ValueError(f"order {order}")
    longer = F.col("gram") >= 1 << 8 * (LOW + 2)
    low = F.when(longer, F.col("gram").bitwiseAND((1 << 8 * (LOW + 1)) - 1).bitwiseOR(1 << 8 * (LOW + 1))).otherwise(F.col("gram"))
    rows = counted.where("n > 0").groupBy(low.alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # contexts of at most LOW bytes
    lowest = spark.sparkContext.broadcast(tuple(np.array(rows.column(c), dtype=np.int64) for c in ("gram", "n")))
    end = F.when(longer, F.shiftright("gram", 8).bitwiseAND((1 << 8 * (LOW + 1)) - 1)).otherwise(F.col("gram"))

    def run(batches):
        parts_ = [[np.array(c, dtype=np.int64) for c in batch.columns] for batch in batches]
        if not parts_:
            return
        grams, n, m = (np.concatenate(c) for c in zip(*parts_))
        levels = levels_of(grams, n, range(LOW + 1, order + 1), levels_of(*lowest.value, range(LOW + 1), []))
        code = gram_codes(grams, levels)
        for a in range(0, len(grams), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in (grams, m, code)], ["gram", "m", "code"])

    return counted.select("gram", "n", "m").repartition(parts(spark), end).mapInArrow(run, "gram long, m long, code double")


class Codes:
    """Code lengths by gram: two tables of places by hash; grams are given with the most frequent last, which keep their place."""

    BITS = 21

    def __init__(self, grams: np.ndarray, codes: np.ndarray):
        self.tables = []
        for turn in range(2):
            keys, values = np.zeros(1 << self.BITS, dtype=np.int64), np.zeros(1 << self.BITS)
            at = self.place(grams, turn)
            keys[at] = grams
            kept = keys[at] == grams
            values[at[kept]] = codes[kept]
            self.tables.append((keys, values))
            grams, codes = grams[~kept], codes[~kept]

    def place(self, grams: np.ndarray, turn: int) -> np.ndarray:
        odd = np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[turn])
        return ((grams.astype(np.uint64) * odd) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code lengths, 0 where there is none, and which grams have none."""
        out, rest = np.zeros(len(grams)), np.arange(len(grams))
        for turn, (keys, values) in enumerate(self.tables):
            asked = grams[rest]
            at = self.place(asked, turn)
            hit = keys[at] == asked
            out[rest[hit]] = values[at[hit]]
            rest = rest[~hit]
        return out, rest


def often(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, at most so many; their least count is from a histogram, so that only they reach the driver."""
    step = F.floor(4 * F.log2(F.col(count).cast("double"))).cast("int")
    left, least = most, None
    for r in sorted(df.where(F.col(count) > 0).groupBy(step.alias("step")).count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return df.where(F.lit(False) if least is None else (F.col(count) > 0) & (step >= least))


def score(docs: DataFrame, order: int = ORDER, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; contexts end at the word."""
    docs = id_text(docs).withColumn("held_out", held_out())
    counted = cut(count_words(docs))
    return summed(docs, cut(score_words(counted, order).repartition(parts(docs.sparkSession))), hot)


def score_stream(docs: DataFrame, order: int = ORDER, hot: int = HOT, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """As score, with contexts across words."""
    docs = id_text(docs).withColumn("held_out", held_out())
    words = cut(count_words(docs)).withColumn("code", F.lit(0.0))
    return summed(docs, words, hot, cut(code_grams(cut(count_grams(docs, order)), order)), order, hot_grams)


def summed(docs: DataFrame, words: DataFrame, hot: int, grams: DataFrame | None = None, order: int = ORDER, hot_grams: int = HOT_GRAMS) -> DataFrame:
    """Sums by text of its words' base model and code, and of its grams' code."""
    spark = docs.sparkSession
    train, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    offset = float(np.log10(train + kinds + 1))
    frequent = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"] > 0, float(np.log10(r["c"] + 1)), r["code"]) for r in often(words, "c", hot).collect()})  # hot words at most
    tables = None
    if grams is not None:
        rows = often(grams, "m", hot_grams).select("gram", "m", "code").toArrow()  # hot_grams at most
        at = np.argsort(np.array(rows.column("m"), dtype=np.int64))
        tables = spark.sparkContext.broadcast((np.array(rows.column("gram"), dtype=np.int64)[at], np.array(rows.column("code"), dtype=np.float64)[at]))

    def run(batches):
        known, row = frequent.value, TaskContext.get().partitionId() << 40
        codes = Codes(*tables.value) if tables is not None else None
        out: list[list] = [[] for _ in types]
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in steps(sizes):
                ids, texts, held_ = (batch.column(c).slice(a, b - a).to_pylist() for c in range(3))
                by_text = np.zeros(len(texts))
                for owner, found in gram_steps(texts, order) if codes else ():
                    code, rest = codes.get(found)
                    by_text += np.bincount(owner, weights=code, minlength=len(texts))
                    if len(rest):
                        at = rest[np.lexsort((found[rest], owner[rest]))]
                        first = np.flatnonzero(np.append(True, (found[at][1:] != found[at][:-1]) | (owner[at][1:] != owner[at][:-1])))
                        n, zero = np.diff(np.append(first, len(at))), np.zeros(len(first), dtype=np.int64)
                        yield batch_of([row + owner[at[first]], [None] * len(n), [None] * len(n), [None] * len(n), found[at[first]], n, zero, zero, zero * 0.0, zero * 0.0])
                for doc, text, held, code in zip(ids, texts, held_, by_text.tolist()):
                    n_tokens, n_known, base = 0, 0, 0.0
                    here = Counter(lowered(text))
                    here[END] = 1
                    for w, n in here.items():
                        n_tokens += n
                        found = known.get(w)
                        if found is None:
                            for c, x in zip(out, (row, None, None, w, None, n, 0, 0, 0.0, 0.0)):
                                c.append(x)
                        else:
                            n_known += n if found[0] else 0
                            base += n * found[1]
                            code += n * found[2]
                    for c, x in zip(out, (row, doc, held, None, None, 0, n_tokens, n_known, base, code)):
                        c.append(x)
                    row += 1
                    if len(out[0]) > 100_000:
                        yield batch_of(out)
                        out = [[] for _ in types]
        if out[0]:
            yield batch_of(out)

    types = ("row long", "doc_id long", "held_out boolean", "word binary", "gram long", "n long", "n_tokens long", "n_known long", "base double", "code double")

    def batch_of(columns):
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t.split()[1]]) for c, t in zip(columns, types)], [t.split()[0] for t in types])

    read = docs.select("doc_id", "text", "held_out").mapInArrow(run, ", ".join(types))
    # Rows without a word or gram are a text's sums; they are dealt out by their number and meet neither.
    read = read.select("row", "doc_id", "held_out", "n", "n_tokens", "n_known", "base", "code", F.when(F.col("word").isNotNull(), F.xxhash64("word")).when(F.col("gram").isNotNull(), F.xxhash64("gram")).otherwise(F.xxhash64("row", F.lit("sums"))).alias("word_id"))
    cold = words.select(F.xxhash64("word").alias("word_id"), F.col("c").alias("w_c"), F.col("code").alias("w_code"))
    if grams is not None:
        cold = cold.unionByName(grams.select(F.xxhash64("gram").alias("word_id"), F.lit(0).cast("long").alias("w_c"), F.col("code").alias("w_code")))
    joined = read.join(cold.hint("merge"), (read.word_id == cold.word_id) & (read.n > 0), "left")
    n_known = F.col("n_known") + F.when(F.col("w_c") > 0, F.col("n")).otherwise(0)
    base = F.col("base") + F.coalesce(F.col("n") * F.log10(F.col("w_c") + 1.0), F.lit(0.0))
    code = F.col("code") + F.coalesce(F.col("n") * F.col("w_code"), F.lit(0.0))
    sums = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(n_known).alias("n_known"), F.sum(base).alias("base"), F.sum(code).alias("score"))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * offset).alias("base_score"), "score")
