import math
import zlib
from collections import Counter, defaultdict

from terrafold.llm import ppm
from terrafold.llm.ppm import score, score_stream

from .corpus import frame, lower, split, texts


def brute(rows, order):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*(w.encode() for w in split(lower(t or ""))), b"\n"] for i, t in rows}
    counts = Counter(w for i, _ in rows if not held[i] for w in tokens[i])
    n_all = sum(counts.values())
    seen = defaultdict(Counter)

    def symbols(word):
        s = b" " + word + (b"" if word == b"\n" else b" ")
        return [(s[max(0, k - order) : k], s[k]) for k in range(1, len(s))]

    for w, c in counts.items():
        for context, b in symbols(w):
            for j in range(len(context) + 1):
                seen[context[j:]][b] += c

    def code(word):
        total = 0.0
        for context, b in symbols(word):
            out = {}
            for j in range(len(context) + 1):
                node = seen.get(context[j:])
                if node is None:
                    continue
                left = {s: n for s, n in node.items() if s not in out}
                if b in node:
                    total += math.log10(node[b] / (sum(left.values()) + len(left)))
                    break
                if left:
                    total += math.log10(len(left) / (sum(left.values()) + len(left)))
                out = node
            else:
                total -= math.log10(256 - len(out))
        return total

    codes = {w: code(w) for i, _ in rows for w in tokens[i]}
    base = {w: math.log10((counts[w] + 1) / (n_all + len(counts) + 1)) for w in codes}
    return {i: (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n_all, sum(base[w] for w in tokens[i]), sum(codes[w] for w in tokens[i])) for i, _ in rows}


def test_against_brute_force(spark):
    rows = list(enumerate(texts() + ["\x00odd ÄÖ", "zzz qqq zzzz"]))
    want = brute(rows, 5)
    for hot in (50, 100_000):
        got = {r["doc_id"]: r for r in score(frame(spark, rows), order=5, hot=hot).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert math.isclose(r["base_score"], w[4], rel_tol=1e-9) and math.isclose(r["score"], w[5], rel_tol=1e-9), (i, r["score"], w[5])


def test_empty_and_repeated(spark):
    assert score(frame(spark, [])).count() == 0
    rows = score(frame(spark, [(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 3, 3] and {r["train_tokens"] for r in rows} == {7 if zlib.crc32(b"1") % 7 != 2 else 1}


def brute_stream(rows, order):
    """Scores with contexts across words."""
    streams = {i: b" ".join([b"", *(w.encode() for w in split(lower(t or ""))), b"\n"]) for i, t in rows}
    seen = defaultdict(Counter)
    for i, s in streams.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(1, len(s)):
                for j in range(max(0, k - order), k + 1):
                    seen[s[j:k]][s[k]] += 1

    def code(context, b):
        total, out = 0.0, {}
        for j in range(len(context) + 1):
            node = seen.get(context[j:])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in out}
            if b in node:
                return total + math.log10(node[b] / (sum(left.values()) + len(left)))
            if left:
                total += math.log10(len(left) / (sum(left.values()) + len(left)))
            out = node
        return total - math.log10(256 - len(out))

    return {i: sum(code(s[max(0, k - order) : k], s[k]) for k in range(1, len(s))) for i, s in streams.items()}


def test_contexts_cross_words(spark):
    rows = list(enumerate(texts() + ["\x00odd ÄÖ", "zzz qqq zzzz"]))
    want, old = brute_stream(rows, 5), brute(rows, 5)
    for hot in (50, 100_000):
        got = {r["doc_id"]: r for r in score_stream(frame(spark, rows), hot=hot, hot_grams=hot).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == old[i][:4] and math.isclose(r["base_score"], old[i][4], rel_tol=1e-9)
            assert math.isclose(r["score"], w, rel_tol=1e-9), (i, r["score"], w)


def test_grams_of_cut_texts_are_the_same():
    whole, pieces = ([(int(o), int(g)) for step in ppm.gram_steps(texts(), 5, limit) for o, g in zip(*step)] for limit in (4 << 20, 7))
    assert whole == pieces


def test_word_order_counts(spark):
    from terrafold.llm import queries

    rows = [(0, "one two three four"), (1, "four two three one"), (2, None), (3, "")] + [(i, "one two three four") for i in range(4, 30)]
    got = {r["doc_id"]: r["score"] for r in score_stream(frame(spark, rows)).collect()}
    assert got[0] > got[1] + 1 and got[2] == got[3]
    assert "score_stream" in queries.op5_ppm.__code__.co_names
    assert score_stream(frame(spark, [])).count() == 0
