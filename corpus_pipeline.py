"""From documents to training sequences, in five stages of the training-data operators.

quality: documents that the adaptive quality rules reject go. near_duplicates: of each group of documents linked by a
Jaccard similarity of 0.8 over five-word shingles the one of the smallest id stays. repeated_passages: words of passages
that repeat are cut out. decontamination: documents that hold a benchmark item go. packing: the rest becomes sequences.

Null ids: such documents are judged and packed, but neither deduplicated nor cut, and go together if one of them is to
go. An id that repeats goes if one of its rows is rejected; near_duplicates leaves one row of it. Empty tables, texts and
extra columns pass through. Each stage's decisions are joined by id; a bit table of fixed size keeps the documents that no
decision concerns out of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import cut, maybe_in, table
from terrafold.llm.decontaminate import contaminated
from terrafold.llm.jaccard import join_components
from terrafold.llm.packing import pack
from terrafold.llm.passages import remove_repeats
from terrafold.llm.quality import judged
from terrafold.llm.queries import tokenizer


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those of the ids (one column, doc_id)."""
    gone = cut(ids.select(F.col("doc_id").alias("gone_")).distinct())
    seen = maybe_in(docs, "doc_id", gone)
    sure = seen.where("maybe").join(gone.hint("merge"), F.expr("doc_id <=> gone_"), "left_anti")
    return seen.where("NOT maybe").unionByName(sure).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, judged(docs).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = cut(join_components(docs, n=5, num=80, den=100))
    stay = without(docs, linked.where("component_id <> doc_id"))
    twice = linked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    seen = maybe_in(stay, "doc_id", twice)
    again = seen.where("maybe AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return seen.where("NOT maybe OR doc_id IS NULL").unionByName(again).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = cut(remove_repeats(docs).where("kept_text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("changed_"), "kept_text"))
    seen = maybe_in(docs, "doc_id", changed)
    new = seen.where("maybe").join(changed.hint("merge"), F.expr("doc_id = changed_"), "left").withColumn("text", F.coalesce("kept_text", "text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return seen.where("NOT maybe").select(docs.columns).unionByName(new.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

#: The stages' shingles, windows and tokenizer can't be put in SQL at the tables' size; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
