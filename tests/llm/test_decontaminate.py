import random
from collections import Counter
from math import log1p

import terrafold.llm.decontaminate as D
from terrafold.llm.decontaminate import contaminated, words_of

from .corpus import frame

R = random.Random(9)
VOCABULARY = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 5))) for _ in range(400)]


def make(k):
    return [R.choice(VOCABULARY) for _ in range(k)]


def scores(items, passage):
    df = Counter(t for w in items for t in set(w))
    mean = sum(map(len, items)) / len(items)
    out = []
    for w in items:
        x = {t: log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in Counter(w).items()}
        out.append(sum(v for t, v in x.items() if t in passage) / sum(x.values()))
    return out


def data(spark):
    items = [make(R.randint(8, 60)) for _ in range(30)] + [["lone", "Pair"]]
    docs, want = [], set()
    for i in range(40):
        w = make(R.randint(0, 400))
        if i % 2:
            k = R.randrange(31)
            w[R.randint(0, len(w)) : 0] = []
            at = R.randint(0, len(w))
            w = w[:at] + items[k] + w[at:]
            want.add((i, k))
        docs.append((i, " ".join(w) if i != 12 else None))
    bench = spark.createDataFrame([(k, ", ".join(w).title(), 1) for k, w in enumerate(items)] + [(98, None, 1), (99, "", 1)], "item_id long, text string, doc_id long")
    return items, frame(spark, docs), bench, want


def test_planted_items_and_no_other(spark, monkeypatch):
    _, docs, bench, want = data(spark)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == want
    monkeypatch.setattr(D, "MAX_ITEMS", 10)  # several passes give the same
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == want
    assert contaminated(frame(spark, []), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_wand_finds_all_above_the_threshold():
    items = [make(R.randint(3, 30)) for _ in range(50)]
    index = D.Index([(i, " ".join(w)) for i, w in enumerate(items)], 0.35)
    for _ in range(200):
        passage = make(R.randint(1, 60))
        terms = sorted({index.terms[t] for t in passage if t in index.terms})
        able = index.most[terms].sum(axis=0) >= 0.35
        got = dict(index.wand(terms, able))
        want = {i: x for i, x in enumerate(scores([words_of(" ".join(w)) for w in items], set(passage))) if x >= 0.35}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_passes_score_alike(spark, monkeypatch):
    _, docs, bench, _ = data(spark)
    found = lambda: {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench, threshold=0.3, question=0.0, answer=0.0).collect()}
    want = found()
    monkeypatch.setattr(D, "MAX_ITEMS", 10)
    got = found()
    assert got.keys() == want.keys() and len(got) > 20
    assert all(abs(got[k][c] - want[k][c]) < 1e-9 for k in got for c in ("score", "question_overlap", "answer_overlap"))
