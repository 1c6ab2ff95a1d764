"""The daily usage rollup as keyed state: one small state for each day, kind, name and user, with timers for retention.

A group's state has its counts and sums, how often each latency came (so that percentiles are exact), and the ids it
has counted, so that an event delivered again, in this batch or after a restart, counts once. Late events change their day's row as
long as its timer has not run out; then the state goes, and events of such days are left out. States are in the state store,
not in memory, and a group is read only when it has new events.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.usage import RETAIN_DAYS

KEY = ["day", "kind", "name", "user_id"]
KEY_TYPE = "day date, kind string, name string, user_id long"
SCHEMA = "key string, calls long, errors long, ms_sum double, ms_p50 double, ms_p95 double, ms_max double"
DAY_MS = 86_400_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def nearest(counts: list[tuple[float, int]], share: float) -> float | None:
    """The nearest-rank percentile of values with their counts, in order."""
    left = max(1, math.ceil(round(share * sum(n for _, n in counts), 9)))
    for value, n in counts:
        left -= n
        if left <= 0:
            return value
    return None


class DailyGroup(StatefulProcessor):
    """The state of one group; rows have event_id, ok, ms."""

    def __init__(self, days: int = RETAIN_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "event_id long", "one boolean")
        self.times = handle.getMapState("times", "ms double", "n long")
        self.sums = handle.getValueState("sums", "calls long, errors long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).drop_duplicates("event_id")
        fresh = fresh[[pd.isna(i) or not self.seen.containsKey((int(i),)) for i in fresh["event_id"]]]
        if not len(fresh):
            return
        calls, errors = self.sums.get() or (0, 0)
        self.sums.update((calls + len(fresh), errors + int((~fresh["ok"].astype(bool)).sum())))
        for i in fresh["event_id"].dropna():
            self.seen.updateValue((int(i),), (True,))
        for value, n in fresh["ms"].dropna().value_counts().items():
            held = self.times.getValue((float(value),)) if self.times.containsKey((float(value),)) else (0,)
            self.times.updateValue((float(value),), (held[0] + int(n),))
        day = json.loads(key[0]).get("day")
        if day:
            self.handle.registerTimer(int(pd.Timestamp(day).timestamp() * 1000) + (self.days + 1) * DAY_MS)
        yield self.row(key)

    def row(self, key: tuple) -> pd.DataFrame:
        calls, errors = self.sums.get()
        counts = sorted((v[0], n[0]) for v, n in self.times.iterator())
        total = round(math.fsum(v * n for v, n in counts), 4) if counts else None
        values = (*key, calls, errors, total, nearest(counts, 0.5), nearest(counts, 0.95), counts[-1][0] if counts else None)
        return pd.DataFrame([values], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.seen, self.times, self.sums):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rollup(events: DataFrame, days: int = RETAIN_DAYS) -> DataFrame:
    """A stream of the rows of groups that have changed; the last row of a group is the one that counts. events: event_id, ts, kind, name, user_id, ok, ms.

    The watermark stands as far back as days are kept, so nothing that is kept comes too late.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{days} days")
    #: The group as one text, in which null differs from any value.
    key = F.to_json(F.struct(F.to_date("ts").alias("day"), "kind", "name", F.col("user_id").cast("long").alias("user_id")))
    rows = timed.select(key.alias("key"), "event_id", "ok", F.col("ms").cast("double").alias("ms"), "ts")
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=DailyGroup(days), outputStructType=SCHEMA, outputMode="Update", timeMode="EventTime")
    return out.withColumn("key", F.from_json("key", KEY_TYPE)).select("key.*", *[c.split()[0] for c in SCHEMA.split(", ")[1:]])


def into(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changed rows of every batch under path, in a folder of its own that a repeated batch writes anew."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows that into() has written the last one of every group."""
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*KEY, "batch")]), "batch").alias("r")).select(*KEY, "r.*")
