"""Documents to training sequences: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmask.llm import near_duplicates, packing, quality, toxicity
from sparkmask.llm.common import Scratch, bounded, fresh, importable, table

#: SQL can express none of the four stages whole (a trained model, minwise trees, a tokenizer); tests use brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the training rows of `labels`, doesn't predict toxic."""
    importable(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training())
    score = fresh(docs, "score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    importable(spark)
    key = fresh(docs, "key")
    bad = quality.judged(docs).where("not kept").select(F.col("key").alias(key)).distinct()
    bad = Scratch(spark, "sound").write(bad, "rejected")
    return quality.with_key(docs, key).join(bounded(bad), key, "left_anti").select(*docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; of repeated rows, one."""
    importable(spark)
    scratch = Scratch(spark, "single")
    found = near_duplicates.near_duplicates(docs)
    a, b = fresh(docs, "gone"), fresh(docs, "again")
    gone = scratch.write(found.where("not kept").select(F.col("doc_id").alias(a)).distinct(), "gone")
    again = scratch.write(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias(b)), "again")
    kept = docs.join(bounded(gone), F.col("doc_id") == F.col(a), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(bounded(again), F.col("doc_id") == F.col(b), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(bounded(again), F.col("doc_id") == F.col(b), "left_anti").unionByName(once)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences of at most 2048 tokens."""
    importable(spark)
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("quality_rules", sound), ("near_dedup", single), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(importable(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
