"""The corpus pipeline: each stage calls one operator of larder.llm on all that its predecessor kept.

Nulls in any column, empty and very long texts, repeated rows and empty tables are answered as each operator states.
Columns beside those of ``documents`` pass through every stage, but for names the last stage adds itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import decontam, mixing, neardup, sharding, toxicity
from larder.llm.common import table, written

#: SQL trains no dictionary; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def _carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns an operator reads beside the whole row, which it can neither see nor overwrite."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *read)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, does not call toxic."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more; a pair at 0.8 is missed with a chance of 1.4e-4."""
    return neardup.keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hit = decontam.contamination(_carried(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["row"])
    return hit.where(F.col("n_hit") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, sources as even as they get before one is read more than twice."""
    return mixing.mix(_carried(docs, "doc_id", "text", "source"), max_repeat=2.0, keep=["row"]).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of equal byte size."""
    return sharding.byte_shards(docs, 40)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
