import hashlib
from collections import Counter

from terrafold.llm.passages import remove_repeats

from .corpus import collected, frame, split, texts


def brute(rows, window=35):
    split_ = [split(t) for t in rows]
    often = Counter(tuple(w[i : i + window]) for w in split_ for i in range(len(w) - window + 1))
    out = []
    for w in split_:
        gone = set()
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def test_against_brute_force(spark):
    got, want = collected(remove_repeats(frame(spark))), brute(texts())
    assert len(got) == len(want)
    for i, (n, gone, digest, kept) in enumerate(want):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, digest), i
        assert (r["kept_text"] is None) == (gone == 0)
        if gone:
            assert split(r["kept_text"]) == kept
    assert sum(g > 0 for _, g, _, _ in want) > 10


def test_repeated_ids_nulls_and_empty(spark):
    a, b = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = remove_repeats(frame(spark, [(1, a), (1, a), (1, b), (None, b), (2, None)])).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in rows) == [(False, 0, 0), (False, 50, 50), (False, 50, 50), (False, 50, 50), (True, 50, 50)]
    assert remove_repeats(frame(spark, [])).count() == 0
