"""Document classes: which runs of words are tried, and what lines meet."""

import random
import re

from pyspark.sql import functions as F

from terrafold.functions.text import fold
from terrafold.operators import classify as C


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def alike(rule, run):
    want, least = C.WANTED[rule]
    return 1 - edits(run, want) / max(len(run), len(want)) >= least


def spoiled(rng, phrase):
    letters = list(phrase)
    for _ in range(rng.choice((0, 1, 2, 4, 9))):
        at = rng.randrange(len(letters))
        letters[at : at + rng.randrange(2)] = rng.choice(("", "a", "z", " ", "ł", "\U0001f600"))
    return " ".join("".join(letters).split()) or "x"


def test_no_run_that_is_similar_enough_is_left_out(monkeypatch):
    rng = random.Random(7)
    pick = lambda: spoiled(rng, rng.choice(C.WANTED)[0]) if rng.random() < 0.6 else rng.choice(("ala", "ska", "planu wypi", "e" * 300))
    lines = [" ".join(pick() for _ in range(rng.choice((1, 1, 2, 5)))) for _ in range(120)] + ["", "x"]
    want = set()
    for row, line in enumerate(lines):
        words = line.split(" ")
        for rule, (phrase, _) in enumerate(C.WANTED):
            n = phrase.count(" ") + 1
            runs = [(0, line)] if len(words) < n else [(k + 1, " ".join(words[k : k + n])) for k in range(len(words) - n + 1)]
            want |= {(row, rule, at) for at, run in runs if alike(rule, run)} | ({(row, rule, -1)} if phrase in line else set())
    got = list(C.could_meet(lines))
    assert {(row, rule, at) for row, rule, at, run in got if alike(rule, run)} == want
    assert len(got) < 0.1 * sum(len(line.split(" ")) for line in lines) * len(C.WANTED)


def test_evidence_does_not_grow_with_words_that_are_no_phrase(spark):
    """One long line: its runs can't be rows (some 30 million before); a phrase at its end is found."""
    line = "ererer thndth onon " * 400_000 + "wypis i wyrsy"
    got = C.evidence(spark.createDataFrame([(1, 1, 0, line), (2, 1, 0, None), (3, 1, 0, " ")], "doc_id long, page int, line_no int, line string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and sorted((r["label"], r["phrase"], r["score"]) for r in got.collect()) == [("MPZP_OGOLNY", "wypis/wyrys", -180), ("MPZP_WYPIS_WYRYS", "wypis i wyrys", 127)]


def test_fold(spark):
    df = spark.createDataFrame([("  ŻÓŁW  1mpzp\t§ 4ä5 ",)], "t string")
    assert df.select(fold(F.col("t"))).first()[0] == "zołw impzp § aas"


def test_mapped_lines_close_and_far(spark):
    """A close line wins over farther ones, a far one counts where none is close, less than half alike is none; edits are counted in bands."""
    lines = [(1, 1, 0, "abcdefghij"), (1, 1, 1, " abcdefghiX "), (1, 1, 2, "abcdeXXXXX"), (1, 1, 3, "abcdefghXX"), (2, 1, 0, "abcdeYYYYY"), (2, 1, 1, "abcdefZZZZ"), (2, 1, 2, "abcdefVVVV"), (2, 1, 3, None), (2, 1, 4, " "), (3, 1, 0, "abcdWWWWWW")]
    keys = [(1, "abcdefghik"), (2, "abcdefghik"), (3, "abcdefghik"), (1, None), (1, " ")]
    out = C.mapped_lines(spark.createDataFrame(keys, "doc_id long, key_line string"), spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string"))
    assert sorted((r["doc_id"], r["line"], r["score"]) for r in out.collect()) == [(1, "abcdefghij", 90), (2, "abcdefZZZZ", 60)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein(folded" in plan and not re.search(r"levenshtein\(folded#\d+, want#\d+, None\)", plan)


def test_intake_deals_a_batch_to_all_cores(spark, monkeypatch, tmp_path):
    from terrafold.streaming import intake as I

    parts = []
    fields = I.fields
    monkeypatch.setattr(I, "fields", lambda pages: parts.append(pages.rdd.getNumPartitions()) or fields(pages))
    rows = [(k, f"p{k}.pdf", "application/pdf", 9, "PLAN", 1, "decyzja o warunkach zabudowy") for k in range(40)]
    uploads = spark.createDataFrame(rows, "doc_id long, name string, media_type string, size long, document_type string, page int, text string").withColumn("uploaded_at", F.timestamp_seconds("doc_id")).coalesce(1)
    I.take_in(str(tmp_path))(uploads, 0)
    assert parts == [spark.sparkContext.defaultParallelism] and sorted(r["version"] for r in I.outcomes(spark, str(tmp_path)).collect()) == list(range(1, 41))
