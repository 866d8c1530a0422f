"""The corpus pipeline: documents pass five stages, each written as Parquet and read again.

quality          documents that the classifier rejects go
near_duplicates  one document of each group of near-duplicates stays (five words, 80 percent)
decontamination  documents with a twentieth of their words in benchmark windows go
mixing           sources repeat, or lose, documents until they have their shares of all words
sharding         every row left gets its shard and place; the rows are the corpus's manifest

A stage keeps repeated rows, nulls and further columns as its operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import decontamination, mixing, near_dedup, quality, sharding
from gazette.llm.common import free, mark, materialize


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more, learnt from labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    return near_dedup.deduplicate(docs, 5, 80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of each row."""
    return sharding.shard(docs, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [("quality", good), ("near_duplicates", unique), ("decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Scores, registers and the slots' hash can't be had in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage wrote on its way, and what it read, goes when its rows are written."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        free(begun, 1)
    return docs
