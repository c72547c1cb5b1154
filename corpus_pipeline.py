"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

Null, empty and very long texts, null doc_ids, repeated rows and different texts under one doc_id go through as each stage states;
an empty table stays empty. Other columns are carried along whatever their names; only the last stage's shard and slot replace
columns so called. Intermediate tables are removed once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import decontam, minhash, mixing, sharding, toxicity
from driftspark.llm.common import Saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels that op10 learns from, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.not_toxic(docs, toxicity.train(docs, labels.where(~toxicity.held_out("doc_id"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; documents without an id stay."""
    return minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, their shard and their slot in it."""
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return sharding.shard(docs).select(*own, "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = Saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return docs


#: A learned model and hashed permutations are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None
