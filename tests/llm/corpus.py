"""Small texts with copies, near copies, shared passages and odd cases, and brute-force helpers."""

import random

WORD = "[^\\x20\\x09-\\x0D]+"


def split(text):
    return [w.decode() for w in text.encode().split()] if text else []


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(300)]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    out = [" ".join(make(r.randint(0, 200))) for _ in range(n)]
    base = make(150)
    passage = make(60)
    out += [" ".join(base)] * 3
    for i in range(6):  # near copies
        words = list(base)
        for _ in range(i + 1):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    for _ in range(5):  # a shared passage between other words
        out.append(" ".join(make(r.randint(0, 40)) + passage + make(r.randint(0, 40))))
    out += ["\n".join([" ".join(passage)] * 2), "x " * 80, " ".join(passage[:36]), " ".join(passage[:35]), " ".join(passage[:34]), None, "", "  \n", "one", "a b c\x1cd", "Ünï <|endoftext|> code", " ".join(make(3000))]
    return out


def frame(spark, rows=None, shuffled=True):
    """documents, with other columns whose names clash with the operators' own."""
    rows = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(i, t, ["en", None, "de"][(i or 0) % 3], ["s0", "s1", None][(i or 0) % 2], len(t or ""), "k", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, h long").repartition(5)


def collected(df):
    return {r["doc_id"]: r for r in df.collect()}
