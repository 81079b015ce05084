"""From raw documents to shards: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes the documents that the one before has kept and returns them (the last with the shard of each);
between stages they are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.llm._shared import materialize, new_path, read, ship
from evidora.llm.decontamination import build_shards, without_contaminated
from evidora.llm.language_id import keep_known, learn
from evidora.llm.ngram_join import one_of_each
from evidora.llm.sharding import ShardStore, free_name, shard_in_order
from evidora.llm.source_mixing import in_mixed_order


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    ship(spark)
    return keep_known(docs, learn(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: the one with the least id."""
    ship(spark)
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    return without_contaminated(docs, build_shards(read(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows in the order of the mix."""
    ship(spark)
    return in_mixed_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the shard that holds them in the committed version, its tier and its place.

    They arrive in the order of their files and are compacted by size as they do; shards by place, and the rows in each, keep that order.
    """
    ship(spark)
    out = shard_in_order(ShardStore(spark, new_path(spark, "corpus"), in_order=True), docs)
    if out is None:
        none = {"shard": F.lit(""), "tier": F.lit(0), "place": F.lit(0).cast("long")}
        return docs.withColumns({free_name(n, docs.columns): c for n, c in none.items()}).limit(0)
    return out


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
