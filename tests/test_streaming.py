"""The streamed rollup equals the batch one, and a second run changes nothing."""

from quirelake.operators import usage
from quirelake.session import table
from quirelake.streaming.usage import daily_rollup


def test_daily_rollup(spark, sf_dir, tmp_path):
    events = usage.from_event_table(table(spark, sf_dir, "events")).drop("shape")
    source = str(tmp_path / "source")
    events.repartition(3).write.parquet(source)
    paths = [str(tmp_path / x) for x in ("raw", "daily", "checkpoint")]
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        daily_rollup(stream, *paths).awaitTermination()
        out = spark.read.parquet(paths[1])
        want = usage.daily(events).select(out.columns)
        assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty()


def test_retention(spark, sf_dir, tmp_path):
    events = usage.from_event_table(table(spark, sf_dir, "events")).drop("shape")
    source = str(tmp_path / "source")
    events.orderBy("ts").coalesce(1).write.parquet(source)
    paths = [str(tmp_path / x) for x in ("raw", "daily", "checkpoint")]
    daily_rollup(spark.readStream.schema(events.schema).parquet(source), *paths, days=3).awaitTermination()
    days = sorted(r["day"] for r in spark.read.parquet(paths[0]).select("day").distinct().collect())
    assert len(days) == 4 and spark.read.parquet(paths[1]).select("day").distinct().count() == 4


def test_keyed_state(spark, tmp_path):
    """After a restart, with events that come twice and late ones, the last rows of the groups are the batch query's."""
    from pyspark.sql import functions as F

    from quirelake.streaming import state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        day = lambda d: f"2024-01-{d:02d}"
        rows = [(k, f"{day(1 + k % 3)} 10:00:0{k % 10}", "tool", f"n{k % 2}", None if k % 5 == 0 else k % 4, k % 3 > 0, float(k * 7 % 11)) for k in range(60)]
        schema = "event_id long, ts string, kind string, name string, user_id long, ok boolean, ms double"
        make = lambda x: spark.createDataFrame(x, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        source, path, checkpoint = (str(tmp_path / x) for x in ("source", "rows", "checkpoint"))
        for part in (rows[:30] + rows[:5], rows[20:], [(900, f"{day(1)} 12:00:00", "tool", "n0", 1, True, 99.0)]):
            make(part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(make(rows).schema).parquet(source)
            state.into(state.rollup(stream), path, checkpoint).awaitTermination()
        out = state.latest(spark.read.parquet(path))
        want = usage.daily(make([*rows, (900, f"{day(1)} 12:00:00", "tool", "n0", 1, True, 99.0)])).select(out.columns)
        assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_keyed_state_is_dropped(spark, tmp_path):
    """Events of days whose state's timer has run out change nothing."""
    from pyspark.sql import functions as F

    from quirelake.streaming import state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        schema = "event_id long, ts string, kind string, name string, user_id long, ok boolean, ms double"
        make = lambda i, ts: spark.createDataFrame([(i, ts, "tool", "n", 1, True, 5.0)], schema).withColumn("ts", F.col("ts").cast("timestamp"))
        source, path, checkpoint = (str(tmp_path / x) for x in ("source", "rows", "checkpoint"))
        for i, ts in enumerate(["2024-01-01 10:00:00", "2024-01-20 10:00:00", "2024-01-20 11:00:00", "2024-01-01 11:00:00", "2024-01-19 11:00:00"]):
            part = make(i, ts)
            part.coalesce(1).write.mode("append").parquet(source)
            state.into(state.rollup(spark.readStream.schema(part.schema).parquet(source), days=2), path, checkpoint).awaitTermination()
        assert {str(r["day"]): r["calls"] for r in state.latest(spark.read.parquet(path)).collect()} == {"2024-01-01": 1, "2024-01-19": 1, "2024-01-20": 2}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
