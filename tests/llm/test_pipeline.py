import corpus_pipeline as P
from terrafold.llm.quality import measures

from . import test_jaccard, test_passages
from .corpus import frame, split, texts


def test_stages_against_brute_force(spark, tmp_path):
    bench = " ".join(f"item{i}" for i in range(40))
    rows = list(enumerate(texts() + [f"before it {bench} and after it all the rest of the words", "$% #" * 200, "good " + " ".join(f"word{i}" for i in range(60)), "Of Which " + " ".join(f"x{i}" for i in range(30))]))
    spark.createDataFrame([(7, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, rows)
    got = docs
    texts_of = {i: t for i, t in rows}
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in got.collect()}
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in got.collect()}
        if name == "quality":
            for i, t in before.items():
                n, _, _, _, repeat, _, _ = measures(t)
                if n < 10 or 100 * repeat > 20 * n:
                    assert i not in after
            assert len(texts()) + 2 in after and len(texts()) + 3 in after and len(texts()) + 1 not in after
        elif name == "near_duplicates":
            want = test_jaccard.brute(sorted(before.items()), 5, 80, 100)
            assert after.keys() == {i for i, (_, c) in want.items() if c == i}
        elif name == "repeated_passages":
            want = test_passages.brute([before[i] for i in sorted(before)])
            assert {i: split(after[i]) for i in sorted(after)} == {i: w[3] for i, w in zip(sorted(before), want)}
        elif name == "decontamination":
            assert before.keys() - after.keys() == {len(texts())}
    last = P.packing(spark, got, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == after.keys() and texts_of


def test_repeated_ids_and_nulls(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{i}" for i in range(60))
    got = frame(spark, [(1, text), (1, text), (2, text), (None, " ".join(f"v{i}" for i in range(60))), (4, None)])
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1]
    empty = frame(spark, [])
    for _, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
