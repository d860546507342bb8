"""Tokenizer alignment against whole texts encoded and linked token by token; perfect hashing against a dictionary."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from tokenizers import Tokenizer

from terrafold.llm import alignment
from terrafold.llm.alignment import Aligner, Frequent, Index, aligned, hashed, shard_bits
from terrafold.llm.queries import tokenizer

from .corpus import frame, texts

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
ODD = [
    " ", "  ", "\n", "\n\n", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\t b", "\ta", "a\n", "\na", "a \n", "x▁y", "▁", "a ▁ b", "<|endoftext|>", "a<|endoftext|> b", "<s> </s> <unk> <0x41>", "\x00a", "a\x1cb \x1d c", "a\xa0b", "a \xa0 b",
    "it's we'll 're 'S", "1234567 12 3", "...!!! --- ###", "ééé ñandú Straße", "日本語 テキスト", "🙂🙂 👩‍👩‍👧", "éa ﬁ ²", "a\r\nb\r c;\r", "line one\nline two\n\nline four", "x" * 3000, ("word " * 900 + "\n") * 3, "a" + " " * 200 + "b", " a  b　c ​ d",
]


def brute(rows):
    tool, library = Aligner(A, B), Tokenizer.from_file(A)
    library.encode_special_tokens = True
    docs, counts = [], Counter()
    for _, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tool.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(tool.a_bytes[i] for i in a) != whole or b"".join(tool.b_bytes[i] for i in b) != whole:
            a, b = [], []
        a_ends, b_ends = list(accumulate(len(tool.a_bytes[i]) for i in a)), list(accumulate(len(tool.b_bytes[i]) for i in b))
        both = sorted(set(a_ends) & set(b_ends))
        groups, links, before = [], [], 0
        for end in both:
            x, y = [i for i, e in zip(a, a_ends) if before < e <= end], [i for i, e in zip(b, b_ends) if before < e <= end]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            before = end
        for i, e in zip(a, a_ends):
            if e in both:
                links.append((i, b[b_ends.index(e)]))
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(r[0], a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for r, (a, b, g, k) in zip(rows, docs)], counts


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows():
    r = random.Random(4)
    some = [(i, t) for i, t in enumerate(t if t is None or len(t) < 5000 else t[:5000] for t in texts())] + [(1000 + i, t) for i, t in enumerate(ODD)]
    some += [(2000 + i, "".join(r.choice("ab é.\n'1\t") for _ in range(r.randint(0, 60)))) for i in range(150)]
    return some + [(None, "no id"), (7, "twice"), (7, "twice")]


@pytest.mark.parametrize("most", [1 << 21, 100, 0])
def test_columns(spark, most, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD", 50)
    monkeypatch.setattr(alignment, "ASKED", 100)
    some = rows()
    want, counts = brute(some)
    assert len(counts) > 200
    assert as_tuples(aligned(frame(spark, some), A, B, most)) == sorted(want, key=str)


def test_units_forgotten(spark, monkeypatch):
    some = [(i, t) for i, t in rows() if t and len(t) < 400][:120]
    tool = Aligner(A, B)
    for _, t in some:
        assert "".join(tool.units(t)) == " " + t
    monkeypatch.setattr(alignment, "KEPT", 40)
    want, _ = brute(some)
    first = tool.numbered([some[0][1]])[0]
    assert len(first) and tool.cuts
    for _, t in some[1:]:
        tool.numbered([t])
    assert len(tool.lost) <= 40 + 400
    assert as_tuples(aligned(frame(spark, some), A, B)) == sorted(want, key=str)


def test_empty(spark):
    got = aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 and got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert as_tuples(aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_index_is_minimal_and_perfect():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 48, 5000))
    index = Index.of(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    again = Index.load(*index.dump())
    assert (again.find(keys) == index.find(keys)).all()
    assert len(Index.of(keys[:0]).find(keys)) == len(keys) and (Index.of(keys[:0]).find(keys) == -1).all()


def test_other_keys_are_refused(monkeypatch):
    keys = np.arange(0, 4000, 2)
    monkeypatch.setattr(alignment, "SHARD", 500)
    bits = shard_bits(len(keys))
    shards = []
    for k in range(1 << bits):
        own = keys[(hashed(keys).view(np.uint64) >> np.uint64(64 - bits)) == k]
        index = Index.of(own)
        ordered = np.empty(len(own), dtype=np.int64)
        ordered[index.find(own)] = own
        dumped, sizes = index.dump()
        shards.append({"shard": k, "bits": dumped, "sizes": sizes, "keys": ordered.tobytes(), "counts": (ordered * 3).tobytes()})
    held = Frequent(shards, len(keys), np.zeros(1, dtype=np.int64))
    asked = np.arange(4000)
    assert (held.find(asked) == np.where(asked % 2 == 0, asked * 3, -1)).all()
