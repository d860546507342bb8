"""Toxicity scores: held-out accuracy on invented documents, features by hand, odd cases."""

import random
import zlib

import pytest

from terrafold.llm.toxicity import FEATURES, WordSigns, features, score_toxicity

#: Invented stems that only toxic documents have, as beginnings of words.
STEMS = ["grumf", "blorq", "snarve"]


def corpus(n=900, seed=8):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(500)] + ["you", "your", "tu"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 300))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(2 + len(words) // 20):
                words.insert(r.randrange(len(words) + 1), r.choice(STEMS) + r.choice(["", "ab", "en", "isch", "u!"]))
        docs.append((i, " ".join(words), ["en", None][i % 2], "s", 1.0, 2))
        if i % 4:
            labels.append((i, 1, int(toxic), "s"))
    truth = {i: any(s in t for s in STEMS) for i, t, *_ in docs}
    return docs, labels, truth


DOCS = "doc_id long, text string, lang string, source string, score double, fold int"
LABELS = "doc_id long, quality int, toxic int, source string"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels, truth = corpus()
    docs = docs + [(None, None, None, None, None, None), (5000, "", "en", "s", 0.0, 0), (5001, " ".join(["Grumfen you"] * 40_000), "en", "s", 0.0, 0), (5002, "calm " * 60_000, "en", "s", 0.0, 0), docs[3], docs[3]]
    labels = labels + [(None, 1, 1, "s"), (7, None, None, "s"), (labels[0][0], 1, labels[0][2], "s")]
    rows = score_toxicity(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    return docs, truth, rows


def test_held_out(scored):
    docs, truth, rows = scored
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_odd_rows(scored):
    docs, _, rows = scored
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[5001][0]["predicted"] == 1 and by_id[5002][0]["predicted"] == 0
    assert by_id[None][0]["score"] == by_id[5000][0]["score"] < 0.7
    assert len(by_id[docs[3][0]]) == 3 and len({r["score"] for r in by_id[docs[3][0]]}) == 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "you idiot, you idiot", None, None, None, 1), (2, "a calm day", None, None, None, 1)], DOCS)
    for labels in ([], [(1, 1, 1, "s"), (2, 1, 0, "s")], [(1, None, None, None)]):
        got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, spark.createDataFrame(labels, LABELS)).collect()}
        assert got == {1: 1, 2: 0}
    assert score_toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_features_by_hand():
    signs = WordSigns({"grum*": 3.0, "meanie": 2.0})
    got = dict(zip(FEATURES, features("You are an 1d10t! Grumfen, MEANIE?? f o o l", signs)))
    assert got["written_density"] == 0 and got["learned_density"] == 2 / 10 and got["hidden_density"] == 1 / 10
    assert got["strongest"] == 3.0 and got["mean_weight"] == 5.0 / 10 and got["capital_words"] == 1 / 10
    assert got["near_second_person"] == 3 / 10 and got["distinct_density"] == 3 / 10 and got["spelled_out"] == 2 / 10
    assert got["exclamation_rate"] == 1 / 43 and got["question_rate"] == 2 / 43 and got["repeated_marks"] == 1 / 10
    assert features(None, signs) == features("", signs) and len(features("", signs)) == len(FEATURES)
    text = "Straße IDIOT Élan x"
    assert dict(zip(FEATURES, features(text, signs)))["capital_share"] == sum(c.isupper() for c in text) / len(text)
