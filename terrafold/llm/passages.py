"""Repeated passages, removed by repeated-phrase automata.

A word is removed if a window of WINDOW consecutive words that covers it also starts anywhere else. Every window names
one of its PHRASE-word phrases, the one of the lowest hash, so equal windows name equal phrases, and about one phrase in
fourteen is ever named.

1. Confirm: named phrases are counted over the corpus. A phrase named once has no repeated window. If all places of a
   phrase are alike as far as any of its windows reaches, all its windows are repeated; else they are to be compared.
2. Compile and stream: documents are dealt out by their id, each with its recurring phrases. Each task, step by step,
   compiles the recurring phrases of the documents at hand into an Aho-Corasick automaton (a shard of all phrases, of
   bounded size) and streams every document through it, which locates every occurrence.
3. Compare: windows around located phrases that weren't settled by 1 are counted by their hash over the corpus.

Counts are combined before each shuffle and hot phrases are split by Spark's skew join, so a passage that a third of
all documents share isn't gathered anywhere. Equal hashes count as equal words: 64 bits for a phrase and 64 for what
surrounds it or for the window.

Null and empty texts have no words. Rows that share an id are documents of their own. A passage that repeats within
one document counts too. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, maybe_in, parts
from .hashing import Words, mix, text_steps

WINDOW, PHRASE = 35, 8


class Named:
    """Which phrase each window names."""

    def __init__(self, words: Words, window: int, phrase: int):
        n, span = len(words.hashes), window - phrase + 1
        docs = np.diff(words.first)
        left = np.repeat(words.first[1:], docs) - np.arange(n)  # words from here to the text's end
        self.start = np.flatnonzero(left >= window)
        if not len(self.start):
            self.at = self.h = self.context = np.zeros(0, dtype=np.int64)
            self.place = self.start
            return
        grams = words.runs(phrase)
        # The lowest hash's position, the first on a tie: high bits of the hash over the position.
        bits = np.uint64(max(1, int(n).bit_length()))
        low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width, have = 1, low
        while 2 * width <= span:
            have = np.minimum(have[: len(have) - width], have[width:])
            width *= 2
        have = np.minimum(have[self.start], have[self.start + span - width])
        position = (have & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        self.at, self.place = np.unique(position, return_inverse=True)  # named phrases; each window's
        doc = np.searchsorted(words.first, self.at, side="right") - 1
        a = np.maximum(self.at - (span - 1), words.first[doc])
        b = np.minimum(self.at + phrase + span - 1, words.first[doc + 1])
        self.h = grams[self.at].view(np.int64)
        around = mix((self.at - a).astype(np.uint64) * np.uint64(1 << 20) + (b - self.at).astype(np.uint64))
        sums = words.sums
        from .hashing import range_hashes

        self.context = (range_hashes(sums, a, b) ^ around).view(np.int64)
        self.doc = doc


def name_phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """doc_id, h, context of every place where a window names a phrase."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, _, words in text_steps(batch.column(1)):
                named = Named(words, window, phrase)
                if len(named.at):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + named.doc)), pa.array(named.h), pa.array(named.context)], ["key", "h", "context"])

    return docs.select("key", "text").mapInArrow(run, "key long, h long, context long")


def locate(words: Words, named: Named, wanted: list[dict[int, bool]], phrase: int):
    """By text: (window start, phrase's hash, settled) of every window whose phrase the shard's automaton finds there."""
    shard = ahocorasick.Automaton()
    texts: dict[int, tuple[str, np.ndarray]] = {}

    def joined(doc: int) -> tuple[str, np.ndarray]:
        if doc not in texts:
            some = [words.text(i, i + 1).decode() for i in range(words.first[doc], words.first[doc + 1])]
            texts[doc] = (" " + " ".join(some) + " ", np.concatenate([[0], np.cumsum([len(w) + 1 for w in some])]))
        return texts[doc]

    for i, doc in enumerate(named.doc.tolist()):
        settled = wanted[doc].get(int(named.h[i]))
        if settled is not None:
            text, at = joined(doc)
            k = int(named.at[i]) - int(words.first[doc])
            shard.add_word(text[at[k] : at[k + phrase] + 1], (int(named.h[i]), settled))
    if not len(shard):
        return {}
    shard.make_automaton()
    place_of = {int(p): i for i, p in enumerate(named.at)}
    windows = np.argsort(named.place, kind="stable")
    bounds = np.searchsorted(named.place[windows], np.arange(len(named.at) + 1))
    out: dict[int, list[tuple[int, int, bool]]] = {}
    for doc in range(len(words.first) - 1):
        if not wanted[doc]:
            continue  # it names no recurring phrase, so no window of it is repeated
        text, at = joined(doc)
        first = int(words.first[doc])
        for last, (h, settled) in shard.iter(text):
            k = int(np.searchsorted(at, last)) - phrase
            i = place_of.get(first + k)
            if i is not None:
                for w in windows[bounds[i] : bounds[i + 1]]:
                    out.setdefault(doc, []).append((int(named.start[w]) - first, h, settled))
    return out


def covered(n_words: int, starts, window: int) -> np.ndarray:
    marks = np.zeros(n_words + 1, dtype=np.int32)
    at = np.asarray(starts, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return np.cumsum(marks[:n_words]) > 0


def digest(words: Words, doc: int, gone: np.ndarray) -> tuple[int, int, str, str | None]:
    """n_words, n_removed, kept_sha256, kept_text (null if nothing is removed); runs of kept words, as they stand, on lines of their own."""
    first, n = int(words.first[doc]), len(gone)
    kept = hashlib.sha256(b" ".join(words.text(first + i, first + i + 1) for i in np.flatnonzero(~gone))).hexdigest()
    if not gone.any():
        return n, 0, kept, None
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    runs = [words.text(first + int(i), first + int(j)) for i, j in zip(edges[::2], edges[1::2])]
    return n, int(gone.sum()), kept, b"\n".join(runs).decode()


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
LOCATED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("text", pa.string()), ("settled", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("windows", pa.list_(pa.int64()))])


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document."""
    # Documents without an id are dealt by their text; a key that several share only makes their phrases' set larger.
    docs = id_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    named = name_phrases(docs, window, phrase)  # cheaper to find again than to keep
    often = named.groupBy("h").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("h", F.expr("a = b").alias("settled"))
    often = cut(often.repartition(parts(docs.sparkSession)))  # dealt anew, so that Spark can split a hot phrase in the join
    wanted = cut(named.select("key", "h").join(often.hint("merge"), "h").groupBy("key").agg(F.collect_set(F.struct("h", "settled")).alias("phrases")))
    # Documents that name no recurring phrase needn't meet the phrases.
    seen = maybe_in(docs, "key", wanted.select("key"))
    none = F.lit(None).cast("array<struct<h: bigint, settled: boolean>>")
    ready = seen.where("maybe").join(wanted.hint("merge"), "key", "left").select("doc_id", "text", "phrases").unionByName(seen.where("NOT maybe").select("doc_id", "text", none.alias("phrases")))

    def run(batches):
        for batch in batches:
            phrases = batch.column(2)
            for a, b, words in text_steps(batch.column(1)):
                wanted = [{x["h"]: x["settled"] for x in phrases[i].as_py() or ()} for i in range(a, b)]
                found = locate(words, Named(words, window, phrase), wanted, phrase) if any(wanted) else {}
                whole = words.runs(window).view(np.int64)
                rows = []
                for doc in range(b - a):
                    hits = found.get(doc, [])
                    n = int(words.first[doc + 1] - words.first[doc])
                    settled, open_ = [s for s, _, ok in hits if ok], [s for s, _, ok in hits if not ok]
                    row = {"doc_id": batch.column(0)[a + doc].as_py(), "settled": settled, "starts": open_, "windows": [int(whole[words.first[doc] + s]) for s in open_]}
                    if open_:
                        row["text"] = batch.column(1)[a + doc].as_py()
                    else:
                        row |= dict(zip(("n_words", "n_removed", "kept_sha256", "kept_text"), digest(words, doc, covered(n, settled, window))))
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=LOCATED)

    located = cut(ready.mapInArrow(run, RESULT + ", text string, settled array<int>, starts array<int>, windows array<long>").withColumn("row", F.monotonically_increasing_id()))
    opened = located.where("text IS NOT NULL")
    pairs = opened.select("row", F.explode(F.arrays_zip("starts", "windows")).alias("x")).select("row", "x.starts", "x.windows")
    again = pairs.groupBy("windows").agg(F.count("*").alias("n")).where("n > 1").select("windows").repartition(parts(docs.sparkSession))
    starts = pairs.join(again.hint("merge"), "windows").groupBy("row").agg(F.collect_list("starts").alias("more"))
    rest = opened.select("row", "doc_id", "text", "settled").join(starts.hint("merge"), "row", "left").select("doc_id", "text", "settled", F.coalesce("more", F.array().cast("array<int>")).alias("more"))

    def finish(batches):
        for batch in batches:
            for a, b, words in text_steps(batch.column(1)):
                rows = []
                for doc in range(b - a):
                    n = int(words.first[doc + 1] - words.first[doc])
                    starts = batch.column(2)[a + doc].as_py() + batch.column(3)[a + doc].as_py()
                    rows.append((batch.column(0)[a + doc].as_py(), *digest(words, doc, covered(n, starts, window))))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), LOCATED)], names=[f.name for f in LOCATED][:5])

    names = [x.split()[0] for x in RESULT.split(", ")]
    return located.where("text IS NULL").select(*names).unionByName(rest.mapInArrow(finish, RESULT))
