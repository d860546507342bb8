"""Alignment of two tokenizers, with corpus-wide pair counts indexed by minimal perfect hashing.

Tokenizer A encodes a space and the text, tokenizer B the text, to which it adds the space itself. Byte offsets where
tokens of both end cut them into groups; the last tokens of a group end together and are linked.

1. Align and count: each task counts its links' id pairs. The distinct pairs are dealt to shards by their hash.
2. Index: each shard's pairs get a minimal perfect hash function: levels of bit tables of twice the keys left; a key that
   shares its bit goes on to the next level, and a key's index is the number of bits set before its own. The keys are kept in that
   order, so that a lookup is verified.
3. Sum: each slice of the tasks fills dense count vectors, one a shard, by index; slices are summed as a tree, FAN at a time.
4. Look up: a second pass aligns the documents again and looks each link's pair up.

The second pass holds the pairs of at most MOST entries (16 bytes each and some bits, the bound of what is broadcast), the
most frequent ones where there are more; the other links' pairs are joined with their shards, and what is found is added by
row. The highest count of each B id is a vector of the size of B's vocabulary. Nothing else is broadcast.

Texts are cut before single spaces and newlines between other characters, where neither tokenizer joins what stands on
both sides (B's pieces are looked through for that; if one did, texts would stay whole), so what is found for a unit of text is
remembered: at most about KEPT units a worker, by units of at most LONG characters. New units are encoded together. Very long texts are
read whole, unit by unit.

Texts that are null, empty, or of other bytes in A's or B's tokens have no tokens: zeros and ''. Rows that share an id, and
equal rows, are aligned and counted separately. Ties for a B id's highest count are all best. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, steps
from .hashing import mix

KEPT, LONG, STEP, RUN = 400_000, 64, 2 << 20, 20_000
SHARD, MOST, SLICES, FAN = 1 << 16, 1 << 21, 8, 4
#: Rows that a shard is asked for in a task.
ASKED = 1 << 20
#: Each character of a byte-level token stands for a byte: printable ones for themselves, the others from 256 on.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _plain)}


#: Fixed value: how a byte-level tokenizer cuts texts before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str):
    """A byte-level tokenizer's bytes by id, and a function from texts to ids, as the library gives them for plain text.

    Where the file's merges are in the order of their ids, a faster library encodes alike.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    special = {t["id"] for t in told["added_tokens"]}
    vocabulary, merges = told["model"]["vocab"], told["model"]["merges"]
    in_bytes = lambda token: bytes(BYTE_OF[c] for c in token) if all(c in BYTE_OF for c in token) else token.encode()
    by_id = {i: in_bytes(token) for token, i in vocabulary.items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
    joined = lambda m: "".join(m) if isinstance(m, list) else m.replace(" ", "")
    plain = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and all(vocabulary[joined(m)] == 256 + i for i, m in enumerate(merges)):
        import tiktoken

        ranks = {x: i for i, x in by_id.items() if i not in special}
        return by_id, tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_padding()
    library.no_truncation()
    return by_id, lambda text: library.encode(text, add_special_tokens=False).ids


class Units(NamedTuple):
    """Units of text, aligned: token numbers and whether bytes are lost, by unit; links with their unit and id pair; the groups' texts, if asked for."""

    a: np.ndarray
    b: np.ndarray
    lost: np.ndarray
    owner: np.ndarray
    pairs: np.ndarray
    texts: list[bytes]


class Aligner:
    """Both tokenizers, and the units that a worker remembers."""

    def __init__(self, path_a: str, path_b: str, texts: bool = True):
        import sentencepiece

        self.texts = texts
        by_id, self.encode_a = byte_level(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in some], dtype=np.int64) for some in (self.a_bytes, self.b_bytes))
        self.cuts = not any("▁" in p.lstrip("▁") or "\n" in p or (p.startswith("▁▁") and p.strip("▁")) for p in pieces)
        self.prefix = len(self.b.encode("\n")) - 1
        ends = lambda n, end: np.array([b"%d%s" % (i, end) for i in range(n)], dtype=object)
        self.a_text, self.b_text = ([ends(len(x), b","), ends(len(x), end)] for x, end in ((self.a_bytes, b"|"), (self.b_bytes, b";")))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.found: list[Units] = []
        self.lost = np.zeros(0, dtype=bool)
        self.groups: list[bytes] = []

    #: A unit starts at a single space or newline after, and before, other characters; other blanks stay within.
    UNITS = re.compile(r"\s+\S+(?:(?:\s\s+|[^\S \n])\S+)*(?:\s+\Z)?|\s+\Z")

    def units(self, text: str) -> list[str]:
        return self.UNITS.findall(" " + text) if self.cuts else [" " + text]

    def encode_b(self, text: str) -> list[int]:
        """B's ids of a run of units, which starts with a space or a newline; B's own space before a newline is taken off."""
        return self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[self.prefix :]

    def encoded(self, units: list[str]) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers, each unit's number of them, and whether its bytes are lost.

        Units are encoded together, RUN characters at a time, and told apart by their bytes; a run that loses bytes is encoded unit by unit.
        """
        a_ids, b_ids, a_n, b_n, lost = [], [], [], [], []
        first, size = 0, 0
        for i, unit in enumerate(units):
            size += len(unit)
            ends = unit[-1].isspace() or not self.cuts  # blanks at its end would join what follows
            if size < RUN and not ends and i + 1 < len(units):
                continue
            some = units[first : i + 1]
            run = "".join(some)
            a, b, whole = self.encode_a(run), self.encode_b(run), run.encode()
            stops = np.cumsum([len(u.encode()) for u in some])
            x, y = (np.searchsorted(np.cumsum(size_of[ids]), stops) + 1 for size_of, ids in ((self.a_size, a), (self.b_size, b)))
            if b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole:
                a_ids += a
                b_ids += b
                a_n.append(np.diff(x, prepend=0))
                b_n.append(np.diff(y, prepend=0))
                lost.append(np.zeros(len(some), dtype=bool))
            elif len(some) == 1:
                a_n.append([0])
                b_n.append([0])
                lost.append([True])
            else:
                for unit in some:
                    for total, one in zip((a_ids, b_ids, a_n, b_n, lost), self.encoded([unit])):
                        total.append(one) if isinstance(one, np.ndarray) else total.extend(one)
            first, size = i + 1, 0
        counts = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a_n, b_n)]
        return a_ids, b_ids, *counts, np.concatenate(lost).astype(bool) if lost else np.zeros(0, dtype=bool)

    def align(self, units: list[str]) -> Units:
        a_ids, b_ids, a_n, b_n, lost = self.encoded(units)
        a_ids, b_ids = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        at = np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b_ends) - 1))
        a_last = b_ends[at] == a_ends if len(b_ends) else np.zeros(0, dtype=bool)
        i, j = np.flatnonzero(a_last), at[a_last]
        owner = np.repeat(np.arange(len(units)), a_n)[i]
        texts = self.group_texts(a_ids, b_ids, i, j, a_n + b_n) if self.texts else []
        return Units(a_n, b_n, lost, owner, a_ids[i] << 32 | b_ids[j], texts)

    def group_texts(self, a_ids: np.ndarray, b_ids: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Each unit's groups as a1,a2|b1;a3|b2; where i and j are the groups' last tokens."""
        pieces = np.empty(len(a_ids) + len(b_ids), dtype=object)
        for ids, last, other, text, later in ((a_ids, i, j, self.a_text, 0), (b_ids, j, i, self.b_text, 1)):
            ends = np.zeros(len(ids), dtype=np.int64)
            ends[last] = 1
            group = np.cumsum(ends) - ends
            before = np.concatenate([[0], other + 1])[group + later]  # the other side's tokens that stand before
            pieces[np.arange(len(ids)) + before] = np.where(ends == 1, text[1][ids], text[0][ids])
        every, stops = pieces.tolist(), np.cumsum(n).tolist()
        return [b"".join(every[a:b]) for a, b in zip([0, *stops], stops)]

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        """By text the numbers of its units; none if the text is empty or one of them is lost."""
        if self.full():
            self.forget()
        cut_up = [self.units(t) if t else [] for t in texts]
        new = list({u for units in cut_up for u in units} - self.number.keys())
        if new:
            first = len(self.lost)
            self.found.append(self.align(new))
            self.lost = np.concatenate([self.lost, self.found[-1].lost])
            self.groups += self.found[-1].texts
            self.number.update(zip(new, range(first, len(self.lost))))
        out = [np.fromiter(map(self.number.__getitem__, units), dtype=np.int64, count=len(units)) for units in cut_up]
        for u in new:
            if len(u) > LONG:
                del self.number[u]
        return [row[:0] if self.lost[row].any() else row for row in out]

    def full(self) -> bool:
        """Whether the next texts begin with nothing known; the units' numbers end there."""
        return len(self.lost) > KEPT


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, texts: bool) -> Aligner:
    return Aligner(path_a, path_b, texts)


def text_parts(batch: pa.RecordBatch):
    """Row ranges of a batch of about STEP bytes, with their texts; null is empty."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for a, b in steps(list(map(len, texts)), STEP):
        yield a, b, texts[a:b]


def hashed(pairs: np.ndarray) -> np.ndarray:
    return mix(pairs.view(np.uint64) + np.uint64(1)).view(np.int64)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, h, n, slice: each task's counts of linked id pairs; h: the pair's hash."""

    def run(batches):
        tool, own = aligner(path_a, path_b, False), TaskContext.get().partitionId() % SLICES
        counts = np.zeros(0, dtype=np.int64)

        def told():
            first = np.cumsum([0, *(len(u.a) for u in tool.found)])
            every = np.concatenate([np.zeros(0, dtype=np.int64), *(u.pairs for u in tool.found)])
            times = np.concatenate([np.zeros(0, dtype=np.int64), *(np.pad(counts, (0, max(0, first[-1] - len(counts))))[a + u.owner] for a, u in zip(first, tool.found))])
            pairs, at = np.unique(every[times > 0], return_inverse=True)
            n = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(n, at, times[times > 0])
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(hashed(pairs)), pa.array(n), pa.array(np.full(len(pairs), own, dtype=np.int32))], ["pair", "h", "n", "slice"])

        for batch in batches:
            for _, _, texts in text_parts(batch):
                if tool.full():
                    yield told()
                    counts = np.zeros(0, dtype=np.int64)
                rows = tool.numbered(texts)
                more = np.bincount(np.concatenate(rows), minlength=len(tool.lost))
                more[: len(counts)] += counts
                counts = more
        yield told()

    return docs.mapInArrow(run, "pair long, h long, n long, slice int")


class Index:
    """A minimal perfect hash function: each level's bits, packed; ranks are counted when it is made."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.before, rank = levels, [], 0
        for bits in levels:
            self.before.append(rank + np.concatenate([[0], np.cumsum(bits)]))
            rank += int(bits.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.view(np.uint64) ^ mix(np.full(1, 2 * level + 1, dtype=np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> Index:
        """keys: distinct."""
        levels, left = [], keys
        while len(left):
            size = -(-2 * len(left) // 8) * 8
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys that are in it; any index, or -1, for others."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, bits: bytes, sizes: list[int]) -> Index:
        out, at = [], 0
        for size in sizes:
            out.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8, count=size // 8, offset=at)).astype(bool))
            at += size // 8
        return cls(out)


def shard_bits(total: int) -> int:
    """So many high bits of a pair's hash name its shard that a shard has about SHARD pairs at most."""
    return max(0, -(-total // SHARD) - 1).bit_length()


def shard_of(h, bits: int):
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def indexed(keys: DataFrame) -> DataFrame:
    """shard, bits, sizes, keys (in index order) of distinct (shard, pair) rows."""

    def build(table: pa.Table) -> pa.Table:
        pairs = table.column("pair").to_numpy()
        index = Index.of(pairs)
        ordered = np.empty(len(pairs), dtype=np.int64)
        ordered[index.find(pairs)] = pairs
        bits, sizes = index.dump()
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], type=pa.int32()), "bits": pa.array([bits], type=pa.binary()), "sizes": pa.array([sizes], type=pa.list_(pa.int64())), "keys": pa.array([ordered.tobytes()], type=pa.binary())})

    return keys.select("shard", "pair").groupBy("shard").applyInArrow(build, "shard int, bits binary, sizes array<long>, keys binary")


def summed(partial: DataFrame, index: DataFrame) -> DataFrame:
    """shard, counts: dense vectors of the partial counts (shard, slice, pair, n), summed as a tree over the slices."""

    def fill(some: pa.Table, own: pa.Table) -> pa.Table:
        if not some.num_rows or not own.num_rows:
            return pa.table({"shard": pa.array([], type=pa.int32()), "slice": pa.array([], type=pa.int32()), "counts": pa.array([], type=pa.binary())})
        row = own.slice(0, 1).to_pylist()[0]
        at = Index.load(row["bits"], row["sizes"]).find(some.column("pair").to_numpy())
        counts = np.zeros(len(row["keys"]) // 8, dtype=np.int64)
        np.add.at(counts, at, some.column("n").to_numpy())
        return pa.table({"shard": pa.array([row["shard"]], type=pa.int32()), "slice": pa.array([row["slice"]], type=pa.int32()), "counts": pa.array([counts.tobytes()], type=pa.binary())})

    def add(some: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_buffer(), dtype=np.int64) for x in some.column("counts"))
        return pa.table({"shard": some.column("shard")[:1], "slice": some.column("slice")[:1], "counts": pa.array([counts.tobytes()], type=pa.binary())})

    each = index.select("shard", "bits", "sizes", "keys", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    # A slice's rows of a pair are added up first, so that a group has at most a shard's pairs.
    once = partial.repartition("shard", "slice").groupBy("shard", "slice", "pair").agg(F.sum("n").alias("n"))
    vectors = once.groupBy("shard", "slice").cogroup(each.groupBy("shard", "slice")).applyInArrow(fill, "shard int, slice int, counts binary")
    left = SLICES
    while left > 1:
        left = -(-left // FAN)
        vectors = vectors.select("shard", (F.col("slice") % left).cast("int").alias("slice"), "counts").groupBy("shard", "slice").applyInArrow(add, "shard int, slice int, counts binary")
    return vectors.select("shard", "counts")


def entries(index: DataFrame) -> DataFrame:
    """pair, h, n of every entry of an index with counts."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                pairs, n = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (keys, counts))
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(hashed(pairs)), pa.array(n)], ["pair", "h", "n"])

    return index.select("keys", "counts").mapInArrow(run, "pair long, h long, n long")


def highest(index: DataFrame) -> np.ndarray:
    """By B id the highest count of its pairs (0 where it has none)."""
    best = entries(index).groupBy(F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("n").alias("n")).collect()
    out = np.zeros(max((r["b"] for r in best), default=-1) + 1, dtype=np.int64)
    out[[r["b"] for r in best]] = [r["n"] for r in best]
    return out


def counted_index(partial: DataFrame) -> tuple[DataFrame, int]:
    """The shards' index with counts of partial (pair, h, n, slice), and the number of its entries."""
    keys = cut(partial.select("pair", "h").distinct())
    total = keys.count()
    bits = shard_bits(total)
    index = cut(indexed(keys.withColumn("shard", shard_of("h", bits))))
    counts = summed(partial.withColumn("shard", shard_of("h", bits)).select("shard", "slice", "pair", "n"), index)
    return cut(index.join(counts.hint("merge"), "shard")), total


def most_frequent(index: DataFrame, total: int, most: int) -> tuple[DataFrame, int]:
    """An index of at most `most` entries, and their number: all, or those of a count of at least a power of two."""
    if total <= most:
        return index, total
    sizes = entries(index).groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("m")).collect()  # 64 rows at most
    left, least = total, 0
    for power, m in sorted((r["power"], r["m"]) for r in sizes):
        if left > most:
            left, least = left - m, power + 1
    return counted_index(entries(index).where(F.col("n") >= F.lit(2.0) ** least).withColumn("slice", F.lit(0)))


class Frequent:
    """The broadcast entries as one table, and by B id the highest count."""

    def __init__(self, rows: list, total: int, best: np.ndarray):
        self.bits, self.best = shard_bits(total), best
        self.shards = {r["shard"]: (bytes(r["bits"]), list(r["sizes"]), bytes(r["keys"]), bytes(r["counts"])) for r in rows}
        self.loaded: dict[int, Index] = {}

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Each pair's count, -1 if it isn't held: the key that stands at its index tells."""
        out = np.full(len(pairs), -1, dtype=np.int64)
        shard = hashed(pairs).view(np.uint64) >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(pairs), dtype=np.uint64)
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        for name, here in zip(names.tolist(), np.split(order, first[1:])):
            if name not in self.shards:
                continue
            bits, sizes, keys, counts = self.shards[name]
            if name not in self.loaded:
                self.loaded[name] = Index.load(bits, sizes)
            at = self.loaded[name].find(pairs[here])
            hit = at >= 0
            hit[hit] = np.frombuffer(keys, dtype=np.int64)[at[hit]] == pairs[here[hit]]
            out[here[hit]] = np.frombuffer(counts, dtype=np.int64)[at[hit]]
        return out

    def __getstate__(self):
        return self.__dict__ | {"loaded": {}}


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(docs: DataFrame, path_a: str, path_b: str, frequent: Frequent) -> DataFrame:
    """RESULT, and rest: pairs that the broadcast entries don't hold, with their number in the document."""
    told = docs.sparkSession.sparkContext.broadcast(frequent)
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
    rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("h", pa.int64()), ("m", pa.int64())]))

    def sums_of(units: Units, known: Frequent) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Each unit's part of the sums, and the pairs of those units that have some which aren't held."""
        distinct, at = np.unique(units.pairs, return_inverse=True)
        counts = known.find(distinct)[at]
        held = counts >= 0
        links = np.bincount(units.owner, minlength=len(units.a))
        best, total = np.zeros((2, len(units.a)), dtype=np.int64)
        np.add.at(best, units.owner[held], counts[held] == known.best[units.pairs[held] & 0xFFFFFFFF])
        np.add.at(total, units.owner[held], counts[held])
        open_: dict[int, list[int]] = {}
        for i, pair in zip(units.owner[~held].tolist(), units.pairs[~held].tolist()):
            open_.setdefault(i, []).append(pair)
        return np.column_stack([units.a, units.b, links, links, best, total]), open_

    def run(batches):
        tool, known = aligner(path_a, path_b, True), told.value
        table, open_, done = [np.zeros((0, 6), dtype=np.int64)], {}, 0
        for batch in batches:
            for a, b, texts in text_parts(batch):
                if tool.full():
                    table, open_, done = [np.zeros((0, 6), dtype=np.int64)], {}, 0
                rows = tool.numbered(texts)
                first = sum(map(len, table))
                for units in tool.found[done:]:
                    more, some = sums_of(units, known)
                    open_ |= {first + i: pairs for i, pairs in some.items()}
                    table.append(more)
                    first += len(more)
                table, done = [np.concatenate(table)], len(tool.found)
                out, rest = [], []
                for doc_id, row in zip(batch.column(0)[a:b].to_pylist(), rows):
                    numbers = row.tolist()
                    digest = hashlib.sha256(b"".join(map(tool.groups.__getitem__, numbers))[:-1]).hexdigest() if numbers else ""
                    out.append((doc_id, *table[0][row].sum(axis=0).tolist(), digest))
                    asked = Counter(p for k in numbers if k in open_ for p in open_[k]) if open_ else {}
                    hashes = hashed(np.array(list(asked), dtype=np.int64)).tolist()
                    rest.append([{"pair": p, "h": h, "m": m} for (p, m), h in zip(asked.items(), hashes)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, type=t) for c, t in zip(zip(*out), types)), pa.array(rest, type=rest_type)], [*names, "rest"])

    return docs.mapInArrow(run, RESULT + ", rest array<struct<pair: long, h: long, m: long>>")


def answered(found: DataFrame, index: DataFrame, total: int, best: np.ndarray) -> DataFrame:
    """row, m, more: what found's rest adds to a row's n_best and count_sum, looked up in the whole index by shard."""
    limits = found.sparkSession.sparkContext.broadcast(best)

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return pa.table({c: pa.array([], type=pa.int64()) for c in ("row", "m", "more")})
        entry = own.to_pylist()[0]
        pairs, m = asked.column("pair").to_numpy(), asked.column("m").to_numpy()
        counts = np.frombuffer(entry["counts"], dtype=np.int64)[Index.load(entry["bits"], entry["sizes"]).find(pairs)]
        is_best = counts == limits.value[pairs & 0xFFFFFFFF]
        return pa.table({"row": asked.column("row"), "m": pa.array(np.where(is_best, m, 0)), "more": pa.array(m * counts)})

    rest = found.select("row", F.explode("rest").alias("x")).select("row", "x.pair", "x.h", "x.m")
    bits = shard_bits(total)
    deal = 1 + (found.agg(F.sum(F.size("rest"))).first()[0] or 0) // (ASKED << bits)  # tasks a shard
    rest = rest.select("row", "pair", "m", shard_of("h", bits).alias("shard"), F.pmod("row", F.lit(deal)).alias("part"))
    each = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
    asked = rest.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(answer, "row long, m long, more long")
    return asked.groupBy("row").agg(F.sum("m").alias("m"), F.sum("more").alias("more"))


def aligned(docs: DataFrame, path_a: str, path_b: str, most: int = MOST) -> DataFrame:
    """RESULT's columns of every document."""
    docs = id_text(docs)
    index, total = counted_index(cut(pair_counts(docs, path_a, path_b)))
    best = highest(index)
    held, number = most_frequent(index, total, most)
    found = looked_up(docs, path_a, path_b, Frequent(held.select("shard", "bits", "sizes", "keys", "counts").collect(), number, best))
    names = [x.split()[0] for x in RESULT.split(", ")]
    if number == total:
        return found.select(*names)
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    whole = found.join(answered(found, index, total, best).hint("merge"), "row", "left")
    return whole.withColumns({c: F.col(c) + F.coalesce(x, F.lit(0)) for c, x in (("n_best", "m"), ("count_sum", "more"))}).select(*names)
