"""Connected components by label propagation, and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the edges of one node are dealt to when they are joined with its root.
SALTS = 16
#: Rounds are about the logarithm of the longest chain, so this many never run out on real graphs.
MAX_ROUNDS = 60
#: Rows that one task takes where a table is dealt to tasks.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-quirelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quirelake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(table: DataFrame) -> int:
    """How many tasks a table is dealt to: as many as a shuffle has, more where a task would have over TASK_ROWS. Its rows are counted."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // TASK_ROWS)


def components(pairs: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(id, root) of every id in pairs(a, b), root being the smallest id reachable.

    Every round takes the smallest root among neighbours, combined before the shuffle, then the root's own
    root, so the number of rounds is about the logarithm of the longest chain. A node's edges are dealt to
    SALTS parts by their other end, and its root goes to the parts that have some, so a node with very many
    edges doesn't meet in one task.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    edges = staged(both.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), "edges")
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("salt"))).alias("seen")
    parts = edges.groupBy(F.col("b").alias("id")).agg(seen, F.min("a").alias("near"))
    roots = staged(parts.select("id", "seen", F.least("id", "near").alias("root")), "roots")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col("seen"), k) == 1)
    for _ in range(max_rounds):
        dealt = roots.select(F.col("id").alias("b"), "root", F.explode(salts).alias("salt"))
        near = edges.join(dealt, ["b", "salt"]).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = staged(roots.join(near, "id").select("id", "seen", F.col("root").alias("was"), F.least("root", "near").alias("root")), "low")
        up = low.select(F.col("id").alias("root"), F.col("root").alias("up"))
        new = staged(low.join(up, "root").select("id", "seen", "was", F.least("root", "up").alias("root")), "roots")
        roots = new.select("id", "seen", "root")
        if new.filter("was <> root").isEmpty():
            return roots.drop("seen")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
