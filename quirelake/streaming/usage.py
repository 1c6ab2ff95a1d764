"""The daily usage rollup over a stream of events."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import RETAIN_DAYS, daily


def _timed(events: DataFrame) -> DataFrame:
    """A watermark wants a timestamp with a zone; plain ones are read in the session's, UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_rollup(events: DataFrame, raw_path: str, daily_path: str, checkpoint: str, days: int = RETAIN_DAYS) -> StreamingQuery:
    """Append each batch to the raw log, then make every day that the batch touches anew from that day's log.

    The log is partitioned by day and batch: a repeated batch overwrites its own folders, and only the touched days
    are read. A day's rollup is overwritten whole, so a repeated batch leaves the same rows. Late events count as
    long as the log keeps their day; days more than `days` before the newest are dropped from it, not from the
    rollup, and events of such days are left out. events: event_id, ts, kind, name, user_id, ok, ms.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = batch.withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(batch_id))
        touched = [r["day"] for r in stamped.select("day").distinct().collect() if r["day"]]  # one row a day
        if not touched:
            return
        newest = max(touched + _days(spark, raw_path))
        since = newest - datetime.timedelta(days=days)
        touched = [d for d in touched if d >= since]
        stamped.filter(F.col("day") >= F.lit(since)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(raw_path)
        log = spark.read.parquet(raw_path).filter(F.col("day").isin(touched)).dropDuplicates(["event_id"])
        daily(log.drop("day", "batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(daily_path)
        _expire(spark, raw_path, since)

    return _timed(events).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, path: str) -> dict:
    """The day folders under a path, by day."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    return {datetime.date.fromisoformat(f.getPath().getName()[4:]): f.getPath() for f in found if f.getPath().getName().startswith("day=2") or f.getPath().getName().startswith("day=1")}


def _days(spark: SparkSession, path: str) -> list[datetime.date]:
    return list(_folders(spark, path))


def _expire(spark: SparkSession, path: str, since: datetime.date) -> None:
    """Drop the days before since."""
    for day, folder in _folders(spark, path).items():
        if day < since:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def windows(events: DataFrame, width: str, slide: str | None = None, late: str = "30 days") -> DataFrame:
    """Calls and errors by name over tumbling or sliding windows (an extension)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(events).withWatermark("ts", late).groupBy(w, "name").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"))


def first_copies(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Events without those delivered again within the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
