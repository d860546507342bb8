"""Set similarity join by PartEnum signatures, and its connected components.

A document's set is its distinct word shingles. Sizes fall into bands; a pair of Jaccard similarity t or more lies in
one band or in two neighbours, and its symmetric difference is at most k = (1 - t) / (1 + t) * 2 * (the upper band's
largest size). Each band has a PartEnum instance of two levels. The feature domain is partitioned into n1 parts and each
of them into n2 smaller ones. With n1 = k / (k2 + 1) + 1 + e (rounded down), at least 1 + e parts of a pair have at most
k2 differences, so n2 - k2 of their smaller parts are alike. A signature is a part and a choice of n2 - k2 of its smaller
parts, with all that the set has in them. A document emits all signatures of its band, and of the next one if a partner
can be there. Signatures without a feature say nothing; while at most e parts have such, they are left out. n2 and k2 are
chosen by cost: the number of signatures, and the meetings by chance of sets that are alike in part.

Exact copies are one class, and one of them, its node, emits: a bit table of fixed size holds most others back; those
that pass it are only more nodes. Within a task one node leads each signature and is shuffled by it, the others follow
it dealt out at random, so a signature of very many documents is nowhere gathered. The smallest node of a signature
is its leader, and a leader with all that share its signatures is a group. First each node is compared with the leader
that it shares most signatures with. Where a group then still holds several components, its largest one and the rest are
dealt into blocks, and a block of the rest is compared with each other block: first by sketches (how many features
fall in each of as many buckets, so the sums of smaller counts bound what two sets share), then exactly for the sets of
which a sketch allows it. So no link that could join two is left out, and no pair is a row. Links and components never
leave Spark's tables.

Null and empty texts have no shingles and are linked with nothing. Fewer words than a shingle are one shingle. Very long
texts have more signatures, no other treatment; a set's features must fit a task. Equal similarities and sizes need no
order: a component is named by its smallest id. Rows that share an id count as one document. A null id has no component.
An empty table gives no rows. Only the id and text are read. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, maybe_in, parts, release
from .hashing import Words, mix, range_hashes, text_steps

#: Sets, and features, to a block where the members of a group are compared (a block of features: 4 MB).
BLOCK, BLOCK_FEATURES = 1024, 500_000
#: Features at a time of which two blocks count what their sets share (16 MB).
COLUMNS = 2048
#: What the choice of parts reckons with: so many sets that have a share of their features in common with a set by chance.
RIVALS, SHARED = 60, 0.4


@lru_cache(maxsize=8)
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Each band's smallest and largest size; a band spans one similarity ratio."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], low[-1] * den // num))
        low.append(high[-1] + 1)
    return np.array(low[:-1]), np.array(high)


def spare(k: int, n2: int, k2: int, smallest: int) -> int:
    """e: parts beyond those that the differences need, so that a set of the smallest size hardly ever has more that lack features (their mean and three deviations)."""
    e = 0
    for _ in range(20):
        n1 = k // (k2 + 1) + 1 + e
        full = 1 - np.exp(-smallest / (n1 * n2))  # the chance that a smaller part has a feature
        lacking = n1 * sum(comb(n2, i) * full**i * (1 - full) ** (n2 - i) for i in range(k2 + 1))
        e = max(e, int(np.ceil(lacking + 3 * lacking**0.5 - 0.05)))
    return e


@lru_cache(maxsize=4096)
def instance(band: int, num: int, den: int) -> tuple[int, int, int, int]:
    """n1, n2, k2, e of a band, of the lowest cost."""
    low, high = (int(x[band]) for x in bands(num, den))
    k, smallest = 2 * high * (den - num) // (den + num), max(1, -(-num * low // den))
    if not k:
        return 1, 1, 0, 0
    best = None
    for k2 in range(min(k, 8) + 1):
        for n2 in range(k2 + 1, k2 + 7):
            e = spare(k, n2, k2, smallest) if k2 < k else 0
            n1 = k // (k2 + 1) + 1 + e
            features = smallest * (n2 - k2) / (n1 * n2)
            cost = n1 * comb(n2, k2) * (1 + RIVALS * SHARED**features)
            if best is None or cost < best[0]:
                best = cost, (n1, n2, k2, e)
    return best[1]


@lru_cache(maxsize=64)
def choices(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)))


def plans(sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of every instance that the sets take part in."""
    low = bands(num, den)[0]
    own = np.searchsorted(low, sizes, side="right") - 1
    some = np.flatnonzero(sizes > 0)
    upper = some[sizes[some] * den >= num * low[own[some] + 1]]
    return np.concatenate([some, upper]), np.concatenate([own[some], own[upper] + 1])


def signatures(features: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of sets given one after the other."""
    which, band = plans(sizes, num, den)
    if not len(which):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    n1, n2, k2, e = np.array([instance(b, num, den) for b in band.tolist()]).T
    cells = n1 * n2
    first_cell, first_feature = np.cumsum(cells) - cells, np.cumsum(sizes) - sizes
    n = sizes[which]
    of = np.repeat(np.arange(len(which)), n)  # each feature's instance
    f = features[np.arange(len(of)) + np.repeat(first_feature[which] - (np.cumsum(n) - n), n)]
    at = first_cell[of] + ((mix(f ^ (band[of] + 1).astype(np.uint64)) >> np.uint64(33)) % cells[of].astype(np.uint64)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    at = at[order]
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    sums, has = np.zeros(int(cells.sum()), dtype=np.uint64), np.zeros(int(cells.sum()), dtype=bool)
    sums[at[begins]] = np.add.reduceat(mix(f[order] + np.uint64(7)), begins)
    has[at[begins]] = True
    out_sig, out_set = [], []
    for a, b in sorted({*zip(n2.tolist(), k2.tolist())}):
        mine = np.flatnonzero((n2 == a) & (k2 == b))
        owner = np.repeat(mine, n1[mine])
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n1[mine]) - n1[mine], n1[mine])
        cell = (first_cell[owner] + part * a)[:, None] + np.arange(a)
        chosen = choices(a, b)
        smaller = mix(np.arange(1, a + 1, dtype=np.uint64))
        tags = (sums[cell] + smaller)[:, chosen].sum(axis=2, dtype=np.uint64)
        bare = ~has[cell][:, chosen].any(axis=2)
        lacking = np.bincount(owner, weights=bare.any(axis=1), minlength=len(which))
        keep = ~(bare & (lacking <= e)[owner][:, None])
        tags = mix(tags + mix((part + 1).astype(np.uint64) + (band[owner].astype(np.uint64) << np.uint64(40)))[:, None])
        out_sig.append(tags[keep])
        out_set.append(np.broadcast_to(which[owner][:, None], keep.shape)[keep])
    return np.concatenate(out_sig), np.concatenate(out_set)


def sets(words: Words, n: int):
    """By text: the sorted distinct shingle hashes."""
    grams = words.runs(n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield range_hashes(words.sums, np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, dtype=np.uint64)


def step_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' features one after the other, and their numbers."""
    found = list(sets(words, n))
    return np.concatenate(found), np.array([len(s) for s in found], dtype=np.int64)


def class_of(features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the sets."""
    some, out = np.flatnonzero(sizes), []
    begins = (np.cumsum(sizes) - sizes)[some]
    for turn in (0, 0x5555555555555555):
        h = np.zeros(len(sizes), dtype=np.uint64)
        if len(some):
            h[some] = np.add.reduceat(mix(features ^ np.uint64(turn)), begins)
        out.append(h.view(np.int64))
    return out[0], out[1]


def classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, c1, c2 (the set's 128-bit hash), n_shingles."""

    def run(batches):
        for batch in batches:
            for a, b, words in text_steps(batch.column(1), lower=True):
                features, sizes = step_sets(words, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, class_of(features, sizes)), pa.array(sizes)], ["doc_id", "c1", "c2", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, c1 long, c2 long, n_shingles long")


def candidates(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """sig, node, lead of the signatures that two or more nodes have; lead: the signature's smallest node, null where that isn't known yet."""

    def emit(batches):
        for batch in batches:
            for a, b, words in text_steps(batch.column(1), lower=True):
                sig, of = signatures(*step_sets(words, n), num, den)
                sig, node = sig.view(np.int64), np.array(batch.column(0).slice(a, b - a), dtype=np.int64)[of]
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                lead = np.ones(len(sig), dtype=bool)
                lead[1:] = sig[1:] != sig[:-1]
                # Leaders meet by signature; the others already know that theirs is shared.
                key = np.where(lead, sig, mix((sig ^ node).view(np.uint64)).view(np.int64))
                several = np.append(~lead[1:], False)[: len(lead)] & lead
                # tag: null for a leader, 0 for one that has followers, the signature for a follower.
                tag = pa.array(np.where(lead, 0, np.where(sig == 0, 1, sig)), mask=lead & ~several)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), tag], ["key", "node", "tag"])

    def meet(batches):
        held = None  # the run of one signature that is open: (signature, its leader, whether the leader is told)
        for batch in batches:
            sig, node, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            follows, several = tag != 0, batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            out = [(tag[follows], node[follows], np.zeros(int(follows.sum()), dtype=np.int64), follows[follows])]
            sig, node, several = sig[~follows], node[~follows], several[~follows]
            if len(sig):
                begin = np.ones(len(sig), dtype=bool)
                begin[1:] = sig[1:] != sig[:-1]
                run, first = np.cumsum(begin) - 1, np.flatnonzero(begin)
                lead = node[first]
                told = (np.maximum.reduceat(node, first) != lead) | np.logical_or.reduceat(several, first)
                if held is not None and held[0] == sig[0]:
                    told[0] |= held[2] or node[0] != held[1]
                    lead[0] = held[1]
                    if told[0] and not held[2]:
                        out.append((sig[:1], lead[:1], lead[:1], np.zeros(1, dtype=bool)))
                keep = told[run]
                if held is not None and held[0] == sig[0]:
                    keep &= ~((run == 0) & (node == held[1]))
                out.append((sig[keep], node[keep], lead[run][keep], np.zeros(int(keep.sum()), dtype=bool)))
                held = (sig[-1], lead[-1], bool(told[-1]))
            sig, node, lead, unknown = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(lead, mask=unknown)], ["sig", "node", "lead"])

    emitted = docs.mapInArrow(emit, "key long, node long, tag long")
    return emitted.repartition(parts(docs.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(meet, "sig long, node long, lead long")


def alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def compare(pairs: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b whose sets are similar enough; features: node, features."""

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3))
            kept = [alike(*(np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in row), num, den) for row in rows]
            yield batch.select([0, 1]).filter(pa.array(kept, type=pa.bool_()))

    left = features.select(F.col("node").alias("a"), F.col("features").alias("fa"))
    right = features.select(F.col("node").alias("b"), F.col("features").alias("fb"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long")


def sketch(features: np.ndarray) -> np.ndarray:
    """How many features fall in each of as many buckets, the next power of two; a count beyond a byte lets every partner through."""
    counts = np.bincount((features >> np.uint64(20) & np.uint64((1 << max(6, int(len(features) - 1).bit_length())) - 1)).astype(np.int64), minlength=1 << max(6, int(len(features) - 1).bit_length()))
    return (counts if counts.max() < 256 else np.full(len(counts), 255)).astype(np.uint8)


def sift(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one or two blocks' sets, those that have a partner of another component whose sketch allows a link."""
    component, own = table.column("component").to_numpy(), table.column("block").to_numpy()
    size = table.column("n").to_numpy()
    sketches = [np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in table.column("sketch")]
    buckets = np.array([len(x) for x in sketches])
    found, two = np.zeros(len(size), dtype=bool), len(np.unique(own)) > 1
    for b in np.unique(buckets).tolist():
        at = np.flatnonzero((buckets == b) | (buckets == 2 * b))  # sizes near each other differ by one doubling at most
        folded = np.stack([sketches[i] if buckets[i] == b else np.minimum(sketches[i].reshape(2, b).sum(axis=0, dtype=np.int64), 255).astype(np.uint8) for i in at.tolist()])
        for k in np.flatnonzero(buckets[at] == b).tolist():
            i = at[k]
            near = (component[at] != component[i]) & (den * np.minimum(size[at], size[i]) >= num * np.maximum(size[at], size[i]))
            if two:
                near &= own[at] != own[i]
            near = np.flatnonzero(near)
            if len(near):
                most = np.minimum(folded[near], folded[k]).sum(axis=1, dtype=np.int64)
                saturated = (folded[near] == 255).any(axis=1) | (folded[k] == 255).any()
                near = near[saturated | (den * most >= num * (size[at[near]] + size[i] - most))]
                found[i] |= len(near) > 0
                found[at[near]] = True
    return table.select(["lead", "lo", "hi", "node", "component", "block"]).filter(pa.array(found))


def link_block(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links that join the components of one or two blocks' sets (a spanning forest of them)."""
    nodes, component = table.column("node").to_pylist(), table.column("component").to_numpy()
    own = table.column("block").to_numpy()
    all_ = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("features")]
    size = np.array([len(x) for x in all_])
    owner = np.repeat(np.arange(len(all_)), size)
    shingle, at = np.unique(np.concatenate(all_), return_inverse=True)
    both = np.zeros((len(all_), len(all_)))
    for c in range(0, len(shingle), COLUMNS):
        here = (at >= c) & (at < c + COLUMNS)
        has = np.zeros((len(all_), min(COLUMNS, len(shingle) - c)), dtype=np.float32)
        has[owner[here], at[here] - c] = 1
        both += has @ has.T
    near = den * both >= num * (size[:, None] + size[None, :] - both)
    near &= component[:, None] != component[None, :]
    if len(np.unique(own)) > 1:
        near &= own[:, None] != own[None, :]
    root = {c: c for c in component.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in np.argwhere(np.triu(near)).tolist():
        x, y = find(int(component[i])), find(int(component[j]))
        if x != y:
            root[y] = x
            out.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in out], type=pa.int64()), "b": pa.array([y for _, y in out], type=pa.int64())})


def within_groups(members: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of the groups; members: lead, node, component, n (the set's size).

    A group's largest component is dealt into blocks of about BLOCK sets or BLOCK_FEATURES features, and so is the rest; a
    block of the rest meets itself, the other blocks of the rest and those of the largest component, each pair in a small
    task of its own.
    """
    spark = members.sparkSession
    by_component = members.groupBy("lead", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    main = F.max_by(F.struct("component", "m", "n"), F.struct("m", "component"))
    sizes = by_component.groupBy("lead").agg(main.alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n")).where("m > main.m")
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK), F.ceil(n / BLOCK_FEATURES)).cast("int")
    sizes = sizes.select("lead", F.col("main.component").alias("main"), blocks(F.col("main.m"), F.col("main.n")).alias("mains"), blocks(F.col("m") - F.col("main.m"), F.col("n") - F.col("main.n")).alias("rests")).repartition(parts(spark))
    dealt = members.join(sizes.hint("merge"), "lead").withColumn("is_main", F.expr("component = main"))
    # Blocks of the rest count up from 0, those of the largest component down from -1.
    dealt = dealt.withColumn("block", F.expr("if(is_main, -1 - pmod(xxhash64(node), mains), pmod(xxhash64(node), rests))").cast("int"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    with_main = F.transform(F.sequence(F.lit(1), F.col("mains")), lambda o: F.struct((-o).alias("lo"), F.col("block").alias("hi")))
    dealt = cut(dealt.select("lead", "node", "component", "block", F.explode(F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_rest, with_main))).alias("x")).select("lead", "node", "component", "block", "x.lo", "x.hi").repartition(parts(spark)))

    def emit_sketches(batches):
        for batch in batches:
            all_ = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in all_], type=pa.int64()), pa.array([sketch(x).tobytes() for x in all_], type=pa.binary())], ["node", "n", "sketch"])

    sketches = features.select("node", "features").mapInArrow(emit_sketches, "node long, n long, sketch binary")
    allowed = dealt.join(sketches.hint("merge"), "node").groupBy("lead", "lo", "hi").applyInArrow(lambda t: sift(t, num, den), "lead long, lo int, hi int, node long, component long, block int")
    allowed = cut(allowed.repartition(parts(spark)))
    release(spark)
    return allowed.join(features.hint("merge"), "node").groupBy("lead", "lo", "hi").applyInArrow(lambda t: link_block(t, num, den), "a long, b long")


def jumped(parent: DataFrame, times: int) -> DataFrame:
    """node, p with p led on by the parents' own parents, each time doubling the way; nodes without a row are their own."""
    for _ in range(times):
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("own"))
        parent = parent.join(up.hint("merge"), "p", "left").select("node", F.coalesce("own", "p").alias("p"))
    return parent


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of the linked nodes.

    Each round hooks every node to its smallest neighbour, follows the hooks, and goes on with the links between what is
    left as one; so few rounds do, and the rounds' hooks compose to the result.
    """
    pairs = links.where("a <> b")
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds = []
    while not rounds or edges.limit(1).count():
        parent = cut(jumped(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p")), 2))
        rounds.append(parent)
        to = lambda c: parent.select(F.col("node").alias(c), F.col("p").alias(f"p{c}")).hint("merge")  # noqa: B023, E731
        edges = cut(edges.join(to("a"), "a").join(to("b"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    label = rounds[0]
    for after in rounds[1:]:
        up = after.select(F.col("node").alias("p"), F.col("p").alias("own"))
        label = label.join(up.hint("merge"), "p", "left").select("node", F.coalesce("own", "p").alias("p"))
    return label.withColumnRenamed("p", "component")


def join_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; documents link at a Jaccard similarity of num / den or more."""
    docs = id_text(docs)
    spark = docs.sparkSession
    counted = cut(classes(docs, n))
    found = counted.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("node"))
    found = cut(found.repartition(parts(spark)))
    likely = maybe_in(docs.where("doc_id IS NOT NULL"), "doc_id", found.select("node")).where("maybe").select("doc_id", "text")
    release(spark)
    shared = cut(candidates(likely, n, num, den))
    release(spark)
    known = shared.where("lead IS NOT NULL")
    late = shared.where("lead IS NULL").select("sig", "node").repartition(parts(spark)).join(known.where("node = lead").select("sig", "lead").hint("merge"), "sig")
    # How many signatures a node shares with each leader; a leader belongs to its own group.
    groups = cut(known.select("lead", "node").unionByName(late.select("lead", "node")).groupBy("lead", "node").agg(F.count("*").alias("m")).repartition(parts(spark)))
    nodes = cut(groups.select("node").distinct())

    def emit_sets(batches):
        for batch in batches:
            rows = [s.tobytes() for _, _, words in text_steps(batch.column(1), lower=True) for s in sets(words, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.binary())], ["node", "features"])

    some = maybe_in(docs, "doc_id", nodes).where("maybe").select("doc_id", "text")
    some = some.join(nodes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi")
    features = cut(some.mapInArrow(emit_sets, "node long, features binary"))
    release(spark)

    first = groups.where("lead <> node").groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("m", -F.col("lead"))).alias("a"))
    links = cut(compare(first.repartition(parts(spark)), features, num, den).repartition(parts(spark)))
    release(spark)
    # Three jumps join most of what the leaders hold together; what they leave apart is only compared again.
    labels = cut(jumped(links.select(F.col("b").alias("node"), F.col("a").alias("p")), 3)).withColumnRenamed("p", "component")
    told = features.select("node", F.expr("length(features) div 8").alias("n")).join(labels.hint("merge"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    members = groups.select("lead", "node").join(told.hint("merge"), "node").select("lead", "node", "component", "n")
    more = cut(within_groups(cut(members.repartition(parts(spark))), features, num, den).repartition(parts(spark)))
    release(spark)
    labels = components(links.unionByName(more))

    found = found.join(labels.hint("merge"), "node", "left").select("c1", "c2", F.col("n_shingles").alias("n"), F.coalesce("component", "node").alias("component"))
    found = found.repartition(parts(spark)).hint("merge")
    # Documents without words are linked with nothing and needn't meet the rest.
    some = counted.where("n_shingles > 0")
    joined = some.join(found, (some.c1 == found.c1) & (some.c2 == found.c2) & (some.n_shingles == found.n), "left").select("doc_id", "n_shingles", "component")
    joined = joined.unionByName(counted.where("n_shingles = 0").select("doc_id", "n_shingles"), allowMissingColumns=True)
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))
