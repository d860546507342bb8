"""Spelling variants against every pair compared by a plain edit distance."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrafold.llm import spelling
from terrafold.llm.spelling import Routes, Trie, near_in, paths, spelling_forms, vectors

from .corpus import lower


def brute(rows, least=7):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                total[word] += 1
    words = {w: n for w, n in total.items() if n >= 2}
    deleted = {}
    for w in words:
        for i in range(len(w)):
            deleted.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= deleted[w[:i], w[i + 1 :]]
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
        near[w].discard(w)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def corpus(seed=5):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéñrstÿ") for _ in range(r.randint(6, 11))) for _ in range(120)]
    rows = []
    for i in range(160):
        text = []
        for _ in range(r.randint(0, 150)):
            w = r.choice(base[: 1 + int(len(base) * r.random() ** 3)])
            if r.random() < 0.06:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", w[at] + r.choice("abé"), r.choice("zxe")]) + w[at + 1 :]
            text.append(r.choice([w, w.upper(), w.capitalize()]) + r.choice(["", "", ".", "1", "_x", "ß"]))
        rows.append((i, " ".join(text)))
    rows += [(None, "abacadae " * 3), (None, None), (7, ""), (7, "ÀÉÎÕÜÀÉ àéîõüàé ×÷×÷×÷×"), (8, "q" * 5000 + " " + "q" * 5000 + " " + "q" * 4999 + "w " + "q" * 4999 + "w"), (9, "abcdefg abcdefg abcdefh abcdefh"), (9, "abcdefg abcdefg abcdefh abcdefh")]
    # anagrams of one path, and a chain of forms: 2, 20, 400
    rows += [(1000 + i, " ".join(["rosetan"] * 2 + ["nosetar"] * 2 + ["tosenar"] * 3)) for i in range(3)]
    rows += [(2000, "chaining " * 400 + "chainings " * 20 + "chainingsx " * 2)]
    return rows


def spread(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, n long, word string, path binary").repartition(5)


@pytest.mark.parametrize("subtree", [20_000, 12, 1])
def test_forms_and_roots(spark, subtree):
    rows = corpus()
    want = brute(rows)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_forms(spread(spark, rows), subtree=subtree).collect()}
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and sum(v[3] > 1 for v in want.values()) > 20


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    monkeypatch.setattr(spelling, "COMPARED", 64)
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(8)) for _ in range(400)})
    longer = sorted({"".join(r.choice("abc") for _ in range(9)) for _ in range(400)})
    as_rows = lambda some: np.frombuffer("".join(some).encode(), dtype=np.uint8).reshape(len(some), -1)
    vec = lambda some: vectors([w.encode() for w in some])
    same = {(words[x], words[y]) for a, b in near_in(as_rows(words), vec(words), as_rows(words), Trie(vec(words))) for x, y in zip(a, b)}
    assert {frozenset(p) for p in same} == {frozenset((a, b)) for a in words for b in words if sum(x != y for x, y in zip(a, b)) == 1} and len(same) == len({frozenset(p) for p in same})
    found = [(words[x], longer[y]) for a, b in near_in(as_rows(words), vec(words), as_rows(longer), Trie(vec(longer))) for x, y in zip(a, b)]
    assert set(found) == {(a, b) for a in words for b in longer if any(b[:i] + b[i + 1 :] == a for i in range(9))} and len(found) == len(set(found))


def test_routes_share_prefixes():
    words = [b"aeeeee", b"aeeees", b"nnnnnn"]
    some = paths(words)
    split = {some[0][:4]: 3, some[0][:8]: 2}
    routes = Routes(split, 1)
    assert routes.of(some[0])[0] != routes.of(some[2])[0]
    assert set(routes.of(some[1])[0]) & set(routes.of(some[1])[0] + routes.of(some[1])[1])


def test_empty(spark):
    got = spelling_forms(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0
    assert spelling_forms(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).count() == 0
