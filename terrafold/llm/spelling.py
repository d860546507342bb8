"""Spelling variants, grouped by a frequency-vector trie.

Words are the maximal letter runs of the texts, lower-cased (A to Z only), of at least LEAST code points and TWICE
occurrences. Now and then (where EVERY divides a checksum of the document's id and the run) a run loses one code point:
planted misspellings, as the query's contract asks.

A word's path is its length and then, one level of the trie each, how often letters of each of the GROUPS stand in it.
One edit changes a path by a surplus of one in one group, a deficit of one in another, or both. The trie is dealt to tasks
by subtrees: nodes of more than a limit of words are split into their children, a full path of more words is dealt by
hash. A word goes to its own subtree and to those that its budget reaches; there a depth-first search, a block of words at
a time, goes down level by level, spending at most one surplus and one deficit. Of each two near words the one that is
shorter or has the lower path searches (the first difference must be a surplus of the other's), so each pair is found once. Words
that the leaves hold are verified if their first or last half is alike, which one edit always leaves.

Only the split nodes are known to all tasks: at most LEVELS * SPLITS of them, whatever the size of the vocabulary. Words are
distinct before they are dealt, so copies and hot sources weigh nothing; subtrees are bounded by the limit. A word's form is its
near word of the most occurrences, if those are RATIO times its own; roots are found by doubling, in as many rounds as
the largest count allows.

Null and empty texts have no words, a null id counts as the empty string in the checksum. Rows that share an id, and equal rows,
are counted as documents of their own. Very long texts and runs are taken whole. Ties go to the word that is first in
code-point order. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, parts
from .hashing import mix

LEAST, TWICE, EVERY, RATIO = 7, 2, 31, 10
#: Letter groups in the trie's order: frequent letters alone, rare ones together; all other letters are the last group.
GROUPS = ("e", "n", "i", "a", "t", "r", "s", "o", "l", "u", "d", "hc", "mg", "pbf", "vwkz", "jxyq")
LEVELS = len(GROUPS) + 2
#: Words of a subtree at most, while the vocabulary has fewer than SPLITS times as many; and words a task holds before it hands counts on.
SUBTREE, SPLITS, HELD = 20_000, 2_000, 250_000
#: Rows of a block of the search, bytes compared at a time, levels of the trie counted at a time.
BLOCK, COMPARED, DEEPER = 200_000, 1 << 24, 5
GROUP_OF = np.full(256, len(GROUPS), dtype=np.int64)
for _i, _letters in enumerate(GROUPS):
    GROUP_OF[[ord(c) for c in _letters]] = _i


def count_words(docs: DataFrame, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n (partial counts)."""
    letters = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                if not text.is_valid:
                    continue
                doc_id = batch.column(0)[i].as_py()
                seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(letters.findall(text.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], ["word", "n"])

    return docs.mapInArrow(run, "word string, n long")


def vectors(words: list[bytes]) -> np.ndarray:
    """How many letters of each group stand in each word (one byte a letter)."""
    size, width = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), len(GROUPS) + 1
    letters = GROUP_OF[np.frombuffer(b"".join(words), dtype=np.uint8)]
    return np.bincount(np.repeat(np.arange(len(words)), size) * width + letters, minlength=len(words) * width).reshape(len(words), width)


def paths(words: list[bytes]) -> list[bytes]:
    """Length and group counts, four bytes each."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.column_stack([size, vectors(words)]).astype(">u4").tobytes()
    return [raw[i : i + 4 * LEVELS] for i in range(0, len(raw), 4 * LEVELS)]


def with_paths(words: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths([w.encode("latin-1") for w in batch.column(0).to_pylist()]), type=pa.binary())], ["word", "n", "path"])

    return words.mapInArrow(run, "word string, n long, path binary")


def split_nodes(words: DataFrame, limit: int) -> dict[bytes, int]:
    """Nodes of more than limit words, with their number of words; there are at most LEVELS * words / limit."""
    split: dict[bytes, int] = {}
    for depth in range(0, LEVELS, DEEPER):
        levels = range(depth, min(depth + DEEPER, LEVELS))
        rest = words.select("path")
        if depth:
            above = [x for x in split if len(x) == 4 * depth]
            if not above:
                break
            rest = rest.join(F.broadcast(words.sparkSession.createDataFrame([(x,) for x in above], "above binary")), F.substring("path", 1, 4 * depth) == F.col("above"))
        nodes = rest.select(F.explode(F.array(*(F.substring("path", 1, 4 * d + 4) for d in levels))).alias("node"))
        split |= {bytes(r["node"]): r["m"] for r in nodes.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > limit).collect()}
    return split


class Routes:
    """Which subtrees a path's words are stored in and search."""

    def __init__(self, split: dict[bytes, int], limit: int):
        self.split, self.limit = split, limit
        self.depth = max([len(x) // 4 for x in split], default=0) + 1
        self.known: dict[bytes, tuple[list[int], list[int]]] = {}

    def subtrees(self, node: bytes) -> list[int]:
        """Ids of the subtrees that make up a node whose children don't matter any longer."""
        number = -(-self.split.get(node, 1) // self.limit)
        return [int.from_bytes(hashlib.blake2b(b"%d:" % k + node, digest_size=8).digest(), "big", signed=True) for k in range(number)]

    def reach(self, path: tuple[int, ...]):
        """Nodes without further split ones below that words of the path may meet: (level, node, surplus, deficit left)."""
        stack = [(1, path[0].to_bytes(4, "big"), 1, 1), (1, (path[0] + 1).to_bytes(4, "big"), 1, 0)]
        while stack:
            level, node, surplus, deficit = stack.pop()
            if node not in self.split or level == LEVELS:
                yield node
                continue
            count = path[level]
            stack.append((level + 1, node + count.to_bytes(4, "big"), surplus, deficit))
            if surplus:
                stack.append((level + 1, node + (count + 1).to_bytes(4, "big"), 0, deficit))
            elif deficit and count:
                stack.append((level + 1, node + (count - 1).to_bytes(4, "big"), 0, 0))

    def of(self, path: bytes) -> tuple[list[int], list[int]]:
        """The subtrees of the path's own words (one of them each), and the others that they search."""
        key = path[: 4 * self.depth]
        found = self.known.get(key)
        if found is None:
            own = next((path[: 4 * d] for d in range(1, LEVELS + 1) if path[: 4 * d] not in self.split), path)
            home = self.subtrees(own)
            numbers = tuple(int.from_bytes(path[i : i + 4], "big") for i in range(0, len(path), 4))
            # Below the deepest split level nothing is read of the path, so paths alike so far share their routes.
            others = sorted({x for node in self.reach(numbers) for x in self.subtrees(node)} - set(home))
            if len(self.known) > HELD:
                self.known.clear()
            found = self.known[key] = (home, others)
        return found


def dealt(words: DataFrame, split: dict[bytes, int], limit: int) -> DataFrame:
    """subtree, stored, word, n: a word's row in its own subtree, and a row for each other one that it searches."""
    told = words.sparkSession.sparkContext.broadcast(split)

    def run(batches):
        routes = Routes(told.value, limit)
        for batch in batches:
            subtree, stored, at = [], [], []
            for i, (word, path) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                home, others = routes.of(path)
                mine = zlib.crc32(word.encode()) % len(home)
                subtree += [home[mine], *home[:mine], *home[mine + 1 :], *others]
                stored += [True] + [False] * (len(home) - 1 + len(others))
                at += [i] * (len(home) + len(others))
            rows = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(subtree, type=pa.int64()), pa.array(stored, type=pa.bool_()), batch.column(0).take(rows), batch.column(1).take(rows)], ["subtree", "stored", "word", "n"])

    return words.mapInArrow(run, "subtree long, stored boolean, word string, n long")


class Trie:
    """The vectors of words of one length, sorted; on each level the nodes' keys: parent and count."""

    def __init__(self, vecs: np.ndarray):
        self.order = np.lexsort(vecs.T[::-1])
        self.wide = int(vecs.max(initial=0)) + 3
        self.keys, node = [], np.zeros(len(vecs), dtype=np.int64)
        for counts in vecs[self.order].T:
            keys, node = np.unique(node * self.wide + counts + 1, return_inverse=True)
            self.keys.append(keys)
        self.leaf = np.empty(len(vecs), dtype=np.int64)
        self.leaf[self.order] = node

    def search(self, vecs: np.ndarray, deficits: bool):
        """(query, leaf, surplus spent) blocks, depth first; a deficit may only follow a surplus."""
        everyone = np.arange(len(vecs))
        stack = [(0, everyone[a : a + BLOCK], np.zeros(len(everyone[a : a + BLOCK]), dtype=np.int64), np.zeros((2, len(everyone[a : a + BLOCK])), dtype=bool)) for a in range(0, len(everyone), BLOCK)]
        while stack:
            level, query, node, spent = stack.pop()
            if level == len(self.keys):
                yield query, node, spent[0]
                continue
            keys, found = self.keys[level], []
            for step in (0, 1, -1) if deficits else (0, 1):
                may = slice(None) if step == 0 else ~spent[0] if step == 1 else spent[0] & ~spent[1]
                q, after = query[may], spent[:, may]
                want = node[may] * self.wide + np.minimum(vecs[q, level] + step, self.wide - 2) + 1
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = keys[at] == want
                hit &= vecs[q, level] + step < self.wide - 1
                after = after[:, hit]
                if step:
                    after[0 if step == 1 else 1] = True
                found.append((q[hit], at[hit], after))
            q, at, after = (np.concatenate([x[k] for x in found], axis=-1) for k in range(3))
            stack += [(level + 1, q[a : a + BLOCK], at[a : a + BLOCK], after[:, a : a + BLOCK]) for a in range(0, len(q), BLOCK)]


def half_keys(letters: np.ndarray, half: int, tail: bool) -> np.ndarray:
    """Hashes of the first or last half letters of each row."""
    part = letters[:, letters.shape[1] - half :] if tail else letters[:, :half]
    key = np.zeros(len(part), dtype=np.uint64)
    for column in part.T:
        key = mix(key + column + np.uint64(1))
    return key


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows differ by exactly one replaced (same width) or one inserted letter."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    width = short.shape[1]
    same, shifted = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
    lead = np.where(same.all(axis=1), width, same.argmin(axis=1))
    trail = np.where(shifted.all(axis=1), width, shifted.argmin(axis=1))
    return lead + trail >= width


def near_in(queries: np.ndarray, query_vecs: np.ndarray, stored: np.ndarray, trie: Trie):
    """(query, stored) index pairs of words one edit apart; of equally long words, the query has the lower path or word."""
    same = queries.shape[1] == stored.shape[1]
    half = queries.shape[1] // 2
    step = max(1, COMPARED // max(1, stored.shape[1]))
    sides = []
    for tail in (False, True):
        keys = mix(half_keys(stored, half, tail) ^ mix(trie.leaf.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        sides.append((half_keys(queries, half, tail), keys[order], order))
    for query, leaf, surplus in trie.search(query_vecs, same):
        for tail, (own, keys, order) in enumerate(sides):
            want = mix(own[query] ^ mix(leaf.astype(np.uint64)))
            lo, hi = np.searchsorted(keys, want), np.searchsorted(keys, want, side="right")
            ends = np.cumsum(hi - lo)
            a = 0
            while a < len(query):  # so many queries at a time that their words fit; one query's words may be more
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, side="right")))
                many = (hi - lo)[a:b]
                q, free = np.repeat(query[a:b], many), np.repeat(surplus[a:b], many)
                s = order[np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[a:b], many)]
                for c in range(0, len(q), step):
                    x, y, z = q[c : c + step], s[c : c + step], free[c : c + step]
                    short, long = queries[x], stored[y]
                    near = one_edit(short, long)
                    if tail:  # where the first halves are alike too, the pair is known
                        near &= (short[:, :half] != long[:, :half]).any(axis=1)
                    if same:
                        at = (short != long).argmax(axis=1)
                        near &= z | (short[np.arange(len(x)), at] < long[np.arange(len(x)), at])
                    yield x[near], y[near]
                a = b


def near_pairs(table: pa.Table, least: int) -> pa.Table:
    """word, near, near_n, both ways, of a subtree's stored words and those that search it."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    kept = table.column("stored").to_numpy()
    out = []
    matrix = lambda rows: np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8).reshape(len(rows), -1)
    for n in np.unique(size[kept]).tolist():
        here = np.flatnonzero(kept & (size == n))
        letters, trie = matrix(here), Trie(vectors([words[i] for i in here]))
        for m in (n, n - 1):
            asks = np.flatnonzero(size == m)
            if m >= least and len(asks):
                out += [(asks[x], here[y]) for x, y in near_in(matrix(asks), vectors([words[i] for i in asks]), letters, trie)]
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, dtype=np.int64)
    b = np.concatenate([y for _, y in out]) if out else a
    one, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    return pa.table({"word": table.column("word").take(one), "near": table.column("word").take(other), "near_n": table.column("n").take(other)})


def spelling_forms(docs: DataFrame, least: int = LEAST, subtree: int = SUBTREE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    docs = id_text(docs)
    spark = docs.sparkSession
    words = count_words(docs, least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)
    words = cut(with_paths(words))
    total, most = words.agg(F.count("*"), F.max("n")).first()
    limit = max(1, min(subtree, -(-total // (2 * parts(spark)))), total // SPLITS)
    pairs = dealt(words, split_nodes(words, limit), limit).groupBy("subtree").applyInArrow(lambda t: near_pairs(t, least), "word string, near string, near_n long")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.select("word", "n").join(best.hint("merge"), "word", "left")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    known = cut(known.select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots, steps = known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while TWICE * RATIO ** (steps + 1) <= (most or 0):  # a way of one step more than known could still be
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        roots, steps = cut(roots.join(up.hint("merge"), "root", "left").select("word", F.coalesce("above", "root").alias("root"))), 2 * steps
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
