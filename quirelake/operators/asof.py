"""As-of join: for each row the last one of another table at or before its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import staged

#: Rows of a range that one task orders.
RANGE_ROWS = 500_000


def last_before(rows: DataFrame, marks: DataFrame, key: str, at: str, within: float | None = None) -> DataFrame:
    """rows with mark (the whole row of marks) at the largest place at or before theirs, under the same key; null if there is none, or none within so much.

    rows and marks have columns key and at. Both are put in one order and cut into ranges; a range finds its own marks, and the last
    one of the ranges before is carried over the border as one small row for each key and range. So a key with very many rows is not one
    task. Of marks at one place the one whose row sorts last counts. A null key or place has no mark.
    """
    both = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), F.lit(None).cast(marks.schema).alias("_mark"))
    own = marks.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema).alias("_row"), F.struct(*[F.col(c) for c in marks.columns]).alias("_mark"))
    both = staged(both.unionByName(own).withColumn("_tie", F.monotonically_increasing_id()), "both")
    parts = max(both.sparkSession.sparkContext.defaultParallelism, both.count() // RANGE_ROWS)
    ranged = staged(both.repartitionByRange(parts, "_key", "_at", "_kind", "_tie").withColumn("_part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("_key", "_part").orderBy("_at", "_kind", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    local = F.last("_mark", ignorenulls=True).over(here)
    ends = ranged.groupBy("_key", "_part").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_mark"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), before["_mark"].alias("_carried"))
    found = ranged.withColumn("_own", local).filter("_kind = 1").join(carried, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    mark = F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_own", "_carried"))
    near = mark if within is None else F.when(F.col("_at") - mark[at] <= within, mark)
    return found.select("_row.*", near.alias("mark"))
