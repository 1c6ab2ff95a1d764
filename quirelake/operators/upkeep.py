"""Upkeep of an index at the cost of what has changed: builds that go on where they stopped, and statistics merged by differences."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import accent_key
from . import retrieval
from .components import staged
from .incremental import drifted, resume_at
from .retrieval import Index, coded, counted, postings


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def build_in_steps(passages: DataFrame, path: str, plan: dict, steps: int = 16, most: int | None = None) -> tuple[Index | None, int]:
    """An index under path, made in steps of which each is kept; how many passages this call has read comes with it.

    plan: embedder, backend, total and version of what is indexed. A build that was stopped goes on behind its last whole step if its
    plan was this one, and begins anew if only another version or total is asked for; one of another embedder has to be removed
    first. most: steps that this call does at most; the index is None while some are left.
    """
    spark = passages.sparkSession
    plans = [json.loads(r["value"]) for r in spark.read.text(f"{path}/plan").collect()] if _exists(spark, f"{path}/plan") else []
    now = plan | {"steps": steps}
    #: The last plan tells which attempt the kept steps belong to.
    last = max(plans, key=lambda p: p["attempt"], default=None)
    kept = [k for k in range(steps) if last and _exists(spark, f"{path}/attempt-{last['attempt']}/step-{k}/done")]
    saved = dict(last, offset=len(kept)) if last else None
    at = resume_at(saved, now, len(kept)) if saved and saved["steps"] == steps else None
    if saved and at is None and kept:
        raise ValueError("what is kept there was made by another embedder or in other steps")
    if not saved or not at:
        last = now | {"attempt": (last or {"attempt": 0})["attempt"] + 1}
        kept = []
        spark.createDataFrame([(json.dumps(last),)], "value string").coalesce(1).write.mode("append").text(f"{path}/plan")
    here, read = f"{path}/attempt-{last['attempt']}", 0
    own = passages.withColumn("_step", F.pmod(F.xxhash64("id"), F.lit(steps)))
    todo = [k for k in range(steps) if k not in kept]
    for k in todo[:most]:
        part = own.filter(F.col("_step") == k).drop("_step")
        counted(part).write.mode("overwrite").parquet(f"{here}/step-{k}/counted")
        read += spark.read.parquet(f"{here}/step-{k}/counted").count()
        spark.range(1).write.mode("overwrite").parquet(f"{here}/step-{k}/done")
    if most is not None and len(todo) > most:
        return None, read
    retrieval.write_from(reduce(DataFrame.unionByName, [spark.read.parquet(f"{here}/step-{k}/counted") for k in range(steps)]), path)
    return Index(spark, path), read


def merged_terms(index: Index, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """(term, df, cf, folded) after the changed passages(id, text) have replaced their old ones and the gone ids are out.

    Only the postings of these passages are counted: what they had is taken off, what they have now is added.
    """
    out = staged(changed.select("id").union(gone.select("id")).distinct(), "out")
    new = postings(changed.join(gone.select("id"), "id", "left_anti")).select("term", F.lit(1).alias("sign"), "tf")
    old = index.read("postings").join(out, "id", "left_semi").select("term", F.lit(-1).alias("sign"), "tf")
    delta = new.unionByName(old).groupBy("term").agg(F.sum("sign").alias("df"), F.sum(F.col("sign") * F.col("tf")).alias("cf"))
    both = index.read("terms").select("term", "df", "cf").unionByName(delta).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return both.filter("df > 0").withColumn("folded", accent_key(F.col("term")))


def refresh_vectors(index: Index, path: str, changed: DataFrame, gone: DataFrame) -> tuple[Index, int]:
    """A new index of vectors under path with the changed ones(id, vector) replaced and the gone ids out, and how many codes were made.

    Codes stand by the mean they were made with, as long as the number of vectors has moved by no more than DRIFT since; past that
    the mean, all codes and the pool's share are made anew, as by a fresh build.
    """
    spark, out = index.spark, staged(changed.select("id").union(gone.select("id")).distinct(), "out")
    stay = index.read("vectors").join(out, "id", "left_anti")
    new = changed.join(gone.select("id"), "id", "left_anti").select("id", "vector")
    pool = index.read("pool").first()
    was = index.read("derived").first()["n"] if _exists(spark, f"{index.path}/derived") else pool["n"]
    now = stay.count() + new.count()
    if drifted(was, now):
        retrieval.build_vectors(stay.select("id", "vector").unionByName(new), path)
        spark.range(1).select(F.lit(now).alias("n")).write.parquet(f"{path}/derived")
        return Index(spark, path), now
    index.read("mean").write.parquet(f"{path}/mean")
    mean = np.array([r["mean"] for r in index.read("mean").orderBy("pos").collect()])  # one number a dimension
    fresh = staged(coded(new, mean), "coded")
    stay.select("id", "vector", "code").unionByName(fresh.select("id", "vector", "code")).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
    spark.range(1).select(F.lit(float(pool["share"])).alias("share"), F.lit(now).alias("n")).write.parquet(f"{path}/pool")
    spark.range(1).select(F.lit(was).alias("n")).write.parquet(f"{path}/derived")
    return Index(spark, path), fresh.count()
