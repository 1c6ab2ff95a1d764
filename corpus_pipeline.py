"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents; each judges every row its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from quirelake.llm.util import shared_dir, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Word shingles of the near-duplicate stages, and how often a source may be repeated by mixing.
SHINGLE, PERCENT, REPETITION_LIMIT = 5, 80, 1.5


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; the others stay."""
    return toxicity.without_toxic(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the smallest doc_id's, nulls last, whatever ids repeat."""
    rows = staged(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    labels = staged(near_dedup.near_dedup(rows.select(F.col("_row").alias("doc_id"), "text"), SHINGLE, PERCENT).select(F.col("doc_id").alias("_row"), "component_id"), "labels")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("sig"), "_row")
    firsts = rows.select("_row", place.alias("place")).join(labels, "_row").groupBy("component_id").agg(F.min("place").alias("place")).select("place._row")
    dropped = staged(labels.select("_row").join(firsts, "_row", "left_anti"), "dropped")
    return rows.join(dropped, "_row", "left_anti").select(COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), SHINGLE, PERCENT / 100)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to the limit; every row stays at least once."""
    return mixing.mix(docs.select(COLUMNS), repetition_limit=REPETITION_LIMIT).select(COLUMNS)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 40)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: Trained models, components and minimax cuts have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/quirelake/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
