import random

from terrafold.llm.jaccard import join_components

from .corpus import collected, frame, lower, split, texts


def shingles(text, n):
    w = split(lower(text)) if text else []
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets_ = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets_):
        for j, b in sets_[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets_}


def near_copies(seed=5):
    r = random.Random(seed)
    rows = list(texts(seed))
    for size in (4, 5, 7, 9, 12, 15, 20, 26, 35, 50, 80, 130, 300):
        base = [f"q{r.randrange(10_000)}" for _ in range(size)]
        for _ in range(6):
            words = list(base)
            for _ in range(r.choice((0, 1, 1, 2, max(1, size // 30), max(1, size // 20)))):
                words[r.choice((0, len(words) - 1, r.randrange(len(words))))] = f"q{r.randrange(10_000)}"
            rows.append(" ".join(words).title() if r.random() < 0.3 else " ".join(words))
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = near_copies()
    for n, num in ((4, 85), (5, 80)):
        got, want = collected(join_components(frame(spark, rows), n, num, 100)), brute(rows, n, num, 100)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert len({c for _, c in want.values()}) < len(want) - 20


def test_empty_and_null_ids(spark):
    assert join_components(frame(spark, [])).count() == 0
    rows = join_components(frame(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (3, "A b c d"), (5, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (3, 3), (4, 3), (4, 3), (5, 5)]
