"""A corpus pipeline: toxicity, near-deduplication, decontamination, mixing, sharding.

Each stage is a function of (spark, docs, sf_dir) that gives a DataFrame with the columns of documents, the last with the
shard besides. run() writes what each stage keeps as Parquet in the shared folder and gives it to the next.

Of every stage: texts of any length are taken whole; null texts are like empty ones; further columns pass, whatever their names;
equal rows are treated alike, so ties can't arise between them; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from codeloom.llm.shared import docs_table, written
from codeloom.session import attach


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language; null and empty texts score low and stay.

    A null language has the threshold of all; a null doc_id is never an example.
    """
    model = toxicity.fit(docs, docs_table(attach(spark), sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies: five-word shingles, a similarity of 0.8.

    Rows with a null doc_id and documents without words stay; rows of the kept doc_id that are equal all stay.
    """
    attach(spark)
    return near_dedup.kept_rows(docs, near_dedup.STAGE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, at a similarity of 0.8 of five-word shingles; doc_ids don't matter."""
    return decontaminate.clean(docs, docs_table(attach(spark), sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a document goes on as many times as the mix takes it (0, 1 or 2).

    A null source is one; rows that share a doc_id within a source go on alike.
    """
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, by doc_id; null doc_ids share one. A column named shard is replaced."""
    return sharding.shard(docs, shards=64, slots=16381)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the random rounding have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
