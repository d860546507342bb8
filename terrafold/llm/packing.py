"""Cost-balanced packing of documents into training sequences.

A document's attention cost is estimated as linear * n + quadratic * n * n. Documents longer than a sequence give whole
sequences first; what remains of each is packed in blocks of a partition's rows: a block's documents go, in descending
order, each to the sequence of the lowest cost that has room for it. A block has as many full sequences as its tokens
fill, and the rest goes to sequences of falling powers of two, so nothing is padded. A document that fits nowhere is cut:
its begin fills the roomiest sequence, its rest goes back among those that wait.

Nothing is shuffled: a block is a run of rows of one input partition, which is read alike again after a lost executor,
and memory is bounded by a block. Null and empty texts are documents of one token, the end id. Very long texts are cut
into full sequences. Equal rows are packed separately. Other columns are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, steps

#: Longer words aren't kept, and a worker keeps the words of its last two spells of so many (about 200 MB).
KEPT_CHARS, KEPT_WORDS = 64, 400_000
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
BLANK_ONLY = np.arange(256, dtype=np.uint8)
BLANK_ONLY[10] = 32
BLANK_LOWER = BLANK_ONLY.copy()
BLANK_LOWER[65:91] += 32


class WordIds:
    """Token ids of whole texts, word by word: the tokenizer never looks across a space or a newline, and lower-cases."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's ids. Words are told apart in Arrow, so only different ones are looked up, and their ids are gathered."""
        texts = column.fill_null("").cast(pa.large_utf8())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        plain = BLANK_LOWER[data]
        # Special tokens are told by their case, so texts that may hold one keep it.
        for i in np.flatnonzero(np.array(pa.compute.match_substring(texts, "<|"), dtype=bool)).tolist():
            plain[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]] = BLANK_ONLY[data[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]]]
        whole = pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain)])
        split = pa.compute.split_pattern(whole, " ")
        told = split.flatten().dictionary_encode()
        words = told.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if None in found:
            new = self.encode({w for w, x in zip(words, found) if x is None})
            found = [new[w] if x is None else x for w, x in zip(words, found)]
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        place = np.array(told.indices, dtype=np.int64)
        n = counts[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(counts) - counts)[place] - ends[:-1], n)]
        edges = ends[np.array(split.offsets, dtype=np.int64)].tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:])]

    def encode(self, words: set[bytes]) -> dict[bytes, bytes]:
        ids = {w: self.older[w] for w in words if w in self.older}
        todo = words - ids.keys()
        # A comma or full stop after an ASCII letter or digit is a token of its own.
        ends = {w for w in todo if len(w) > 1 and w[-1] in b".," and w[-2] in ALNUM and b"<|" not in w}
        rest = list({w[:-1] if w in ends else w for w in todo} | {w[-1:] for w in ends})
        got = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(rest, self.library.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False))}
        ids |= {w: got[w[:-1]] + got[w[-1:]] if w in ends else got[w] for w in todo}
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        self.known.update((w, x) for w, x in ids.items() if len(w) <= KEPT_CHARS)
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then the powers of two that make up what is left."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1]


def balance(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece."""
    room = np.array(capacities(sum(lengths), size), dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        k = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[k] < n:
            k = int(np.argmax(room))
            heapq.heappush(waiting, (-(n - int(room[k])), i, start + int(room[k])))
            n = int(room[k])
        pieces.append((i, start, n, k, int(used[k])))
        room[k] -= n
        used[k] += n
        cost[k] += linear * n + quadratic * n * n
    return pieces


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length")


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 4096, block: int = 4096) -> DataFrame:
    """A row for each piece of each document; size is a power of two, block the most documents packed together."""

    def run(batches):
        ids_of = word_ids(path)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, np.ndarray, int]] = []  # doc_id, start, ids, doc_tokens

        def whole(doc, start, ids, total, offset, seq, length):
            return (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, seq, offset, length)

        def packed():
            nonlocal sequence
            pieces = balance([len(x[2]) for x in held], size, linear, quadratic)
            ends: dict[int, int] = {}
            for _, _, n, k, at in pieces:
                ends[k] = max(ends.get(k, 0), at + n)
            for i, start, n, k, at in pieces:
                doc, before, ids, total = held[i]
                yield whole(doc, before + start, ids[start : start + n], total, at, sequence + k, ends[k])
            sequence += max(ends, default=-1) + 1
            held.clear()

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in zip(*rows)], list(COLUMNS))

        def tokenized(batch):
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_pylist()
            for a, b in steps(sizes):
                yield from zip(batch.column(0).slice(a, b - a).to_pylist(), ids_of(batch.column(1).slice(a, b - a)))

        rows = []
        for batch in batches:
            for doc, ids in tokenized(batch):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                full = len(ids) // size * size
                for start in range(0, full, size):
                    rows.append(whole(doc, start, ids[start : start + size], len(ids), 0, sequence, size))
                    sequence += 1
                if full < len(ids):
                    held.append((doc, full, ids[full:].copy(), len(ids)))
                if len(held) >= block:
                    rows += packed()
            if rows:
                yield flush(rows)
                rows = []
        rows += packed()
        if rows:
            yield flush(rows)

    return id_text(docs).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
