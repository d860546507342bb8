"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every item's postings carry BM25 weights divided by the item's own full score, so 1 is a perfect retrieval and one
threshold serves all items. Postings lie in blocks of items, each with the largest weight of each term. Documents are
cut into passages of two strides, a stride being the longest item, so every item that a document holds lies whole in a
passage. Each passage is a query: first the sum of its terms' block maxima rules out blocks (for all passages of a step
at once), then WAND scores the items of the blocks that remain. A retrieved item is verified: the words of its question
(the first three quarters) and of its answer (the rest) that lie in five-word runs which the passage also has.

The index is broadcast in blocks of at most MAX_ITEMS items; a larger benchmark takes more passes over the
documents. Document frequencies, the number of items, their mean length and the stride are those of the whole benchmark in
every pass.

Null, empty and word-less texts match nothing; items without words are no items, those shorter than five words are one
run. Equal items are separate. Rows that repeat are searched separately. Very long documents are many passages. Only the
ids and texts are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, steps
from .licenses import TO_WORDS

K1, B = 1.2, 0.75
BLOCK, MAX_ITEMS, RUN = 4, 1_000, 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float, whole: tuple[int, int, int, dict[bytes, int]] | None = None):
        """whole: number of items, their words, the longest's words and the items' document frequencies, where items are a part of the benchmark."""
        self.items = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
        self.threshold = threshold
        if whole is None:
            whole = (len(self.items), sum(len(w) for _, w in self.items), max([0, *(len(w) for _, w in self.items)]), Counter(t for _, w in self.items for t in set(w)))
        count, total_words, longest, df = whole
        self.stride = max(32, longest)
        mean = total_words / max(1, count)
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        self.blocks = -(-len(self.items) // BLOCK)
        self.postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.most = np.zeros((len(df), self.blocks), dtype=np.float32)
        for k, (_, w) in enumerate(self.items):
            weights = {t: np.log1p((count - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in Counter(w).items()}
            total = sum(weights.values())
            for t, x in weights.items():
                self.postings[self.terms[t]].append((k, x / total))
                self.most[self.terms[t], k // BLOCK] = max(self.most[self.terms[t], k // BLOCK], x / total + 1e-6)
        self.upper = self.most.max(axis=1) if self.blocks else np.zeros(0)

    def wand(self, terms: list[int], able: np.ndarray) -> list[tuple[int, float]]:
        """Items at or over the threshold, document at a time; able: the blocks that the block maxima leave."""
        lists = [[0, t] for t in terms if self.postings[t]]
        found = []
        while lists:
            lists.sort(key=lambda c: self.postings[c[1]][c[0]][0])
            bound, pivot = 0.0, None
            for c in lists:
                bound += float(self.upper[c[1]])
                if bound >= self.threshold:
                    pivot = self.postings[c[1]][c[0]][0]
                    break
            if pivot is None:
                break
            block = pivot // BLOCK
            if not able[block]:
                target = (block + 1) * BLOCK  # no item of this block can reach the threshold
            elif self.postings[lists[0][1]][lists[0][0]][0] == pivot:
                score = sum(self.postings[t][i][1] for i, t in lists if self.postings[t][i][0] == pivot)
                if score >= self.threshold:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in lists:
                plist = self.postings[c[1]]
                while c[0] < len(plist) and plist[c[0]][0] < target:
                    c[0] += 1
            lists = [c for c in lists if c[0] < len(self.postings[c[1]])]
        return found

    def verify(self, item: int, passage: list[bytes]) -> tuple[float, float]:
        """Shares of the question's and of the answer's words that lie in runs which the passage has."""
        words = self.items[item][1]
        n = min(RUN, len(words))
        have = set(zip(*(passage[i:] for i in range(n))))
        hit = np.zeros(len(words), dtype=bool)
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in have:
                hit[i : i + n] = True
        answer = max(1, len(words) // 4)
        question = hit[:-answer] if len(words) > answer else hit
        return float(question.mean()), float(hit[-answer:].mean())

    def search(self, texts: list[list[bytes]]) -> list[dict[int, tuple[float, float, float]]]:
        """By text: item -> (score, question overlap, answer overlap) of its best passage."""
        out: list[dict] = [{} for _ in texts]
        sizes = np.array([len(w) for w in texts], dtype=np.int64)
        if not self.items or not sizes.sum():
            return out
        terms = np.concatenate([np.fromiter(map(self.terms.get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in texts])
        n_strides = -(-sizes // self.stride)
        first_word, first_stride = np.cumsum(sizes) - sizes, np.cumsum(n_strides) - n_strides
        doc = np.repeat(np.arange(len(texts)), sizes)
        stride = first_stride[doc] + (np.arange(len(terms)) - first_word[doc]) // self.stride
        known = terms >= 0
        pairs = np.unique(stride[known] * len(self.terms) + terms[known])
        at, term = pairs // len(self.terms), pairs % len(self.terms)
        bound = np.zeros((int(n_strides.sum()) + 1, self.blocks), dtype=np.float32)
        if len(at):
            begins = np.flatnonzero(np.diff(at, prepend=-1))
            for b in range(0, self.blocks, 64):
                bound[at[begins], b : b + 64] = np.add.reduceat(self.most[term, b : b + 64], begins, axis=0)
        owner = np.append(np.repeat(np.arange(len(texts)), n_strides), -1)
        same = owner[1:] == owner[:-1]
        bound[:-1][same] += bound[1:][same]
        able = bound[:-1] >= self.threshold
        edges = np.searchsorted(at, np.arange(int(n_strides.sum()) + 1))
        for p in np.flatnonzero(able.any(axis=1)).tolist():
            d = int(owner[p])
            last = p + 2 if same[p] else p + 1
            hits = self.wand(sorted(set(term[edges[p] : edges[last]].tolist())), able[p])
            if hits:
                k = (p - int(first_stride[d])) * self.stride
                passage = texts[d][k : k + 2 * self.stride]
                for item, score in hits:
                    q, a = self.verify(item, passage)
                    out[d][item] = max(out[d].get(item, (0.0, 0.0, 0.0)), (score, q, a), key=lambda x: (min(x[1:]), x[0]))
        return out


def frequencies(items: DataFrame) -> DataFrame:
    """term, df (items that have it), longest: of all items; the null term's are their number and words."""

    def run(batches):
        for batch in batches:
            df, count, total, longest = Counter(), 0, 0, 0
            for text in batch.column(0).to_pylist():
                w = words_of(text)
                df.update(set(w))
                count, total, longest = count + bool(w), total + len(w), max(longest, len(w))
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], type=pa.binary()), pa.array([count, *df.values()], type=pa.int64()), pa.array([total] + [0] * len(df), type=pa.int64()), pa.array([longest] + [0] * len(df), type=pa.int64())], ["term", "df", "total", "longest"])

    return items.select("text").mapInArrow(run, "term binary, df long, total long, longest long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.max("longest").alias("longest"))


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.7, answer: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of the items that documents hold."""
    docs, items = id_text(docs), id_text(benchmark, "item_id").where("text IS NOT NULL")
    passes = max(1, -(-items.count() // MAX_ITEMS))
    found, told = None, None
    if passes > 1:
        told = cut(frequencies(items))
        all_ = told.where("term IS NULL").first()
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(passes)) == k)
        rows = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # at most about MAX_ITEMS
        whole = None
        if told is not None:
            here = frequencies(part).where("term IS NOT NULL").select("term")
            whole = (all_["df"], all_["total"], all_["longest"], {bytes(r["term"]): r["df"] for r in told.join(here, "term", "left_semi").select("term", "df").collect()})  # the part's terms
        index = docs.sparkSession.sparkContext.broadcast((rows, whole))

        def run(batches, index=index):
            own = Index(index.value[0], threshold, index.value[1])
            for batch in batches:
                sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
                for a, b in steps(sizes, 1 << 20):
                    texts = [words_of(x) for x in batch.column(1).slice(a, b - a).to_pylist()]
                    rows = defaultdict(list)
                    for i, hits in zip(batch.column(0).slice(a, b - a).to_pylist(), own.search(texts)):
                        for item, values in sorted(hits.items()):
                            if values[1] >= question and values[2] >= answer:
                                for name, x in zip(("doc_id", "item_id", "score", "question_overlap", "answer_overlap"), (i, own.items[item][0], *values)):
                                    rows[name].append(x)
                    if rows:
                        yield pa.RecordBatch.from_pydict(dict(rows), schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))]))

        rows = docs.mapInArrow(run, SCHEMA)
        found = rows if found is None else found.unionByName(rows)
    return found
