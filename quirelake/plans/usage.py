"""Usage queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import items, usage
from ..session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.from_event_table(table(spark, sf_dir, "events"))


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_day(usage_daily(spark, sf_dir))


def usage_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_key(usage_daily(spark, sf_dir), "name")


def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_key(usage_daily(spark, sf_dir), "user_id")


def usage_rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(usage_daily(spark, sf_dir))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.histogram(_events(spark, sf_dir)).withColumn("le", F.coalesce(F.col("le").cast("string"), F.lit("+Inf")))


def usage_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days and rows that are retained, counted back from the last event."""
    e = _events(spark, sf_dir)
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return usage.retained(e, now).select("event_id", "ts", "name")


def usage_shape_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("shape", "$.k").cast("int")
    return _events(spark, sf_dir).groupBy("name").agg(F.count(k).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def usage_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(usage.pseudonym(F.col("user_id"), "salt").alias("who")).agg(F.count("*").alias("calls"))


def activity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user what began, and what went on, since 20 January."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("who"), F.col("ts").alias("dateModified"), F.date_sub(F.to_date("ts"), F.pmod("event_id", F.lit(14)).cast("int")).cast("timestamp").alias("dateAdded"))
    return items.activity(e, F.lit("2024-01-20").cast("timestamp"))


QUERIES = {f.__name__: f for f in (usage_daily, usage_by_day, usage_by_name, usage_by_user, usage_rollup_totals, latency_histogram, usage_retention, usage_shape_json, usage_pseudonyms, activity_window)}

_DAILY = """SELECT strftime(ts, '%Y-%m-%d') AS day, 'tool' AS kind, event_type AS name, user_id, count(*) AS calls,
    count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS ms_sum, quantile_disc(value, 0.5) AS ms_p50,
    quantile_disc(value, 0.95) AS ms_p95, max(value) AS ms_max FROM events GROUP BY ALL"""
_KEY = f"""WITH d AS ({_DAILY}) SELECT {{key}}, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, max(ms_p95) AS ms_p95,
    count(DISTINCT day) AS days FROM d GROUP BY {{key}} ORDER BY calls DESC, {{key}} LIMIT 15"""

ORACLE = {
    "usage_daily": _DAILY,
    "usage_by_day": f"""WITH d AS ({_DAILY}) SELECT day, count(DISTINCT user_id) AS users, sum(calls)::BIGINT AS calls,
        sum(errors)::BIGINT AS errors, round(sum(ms_sum) / sum(calls), 7) AS ms_mean FROM d GROUP BY day""",
    "usage_by_name": _KEY.format(key="name"),
    "usage_by_user": _KEY.format(key="user_id"),
    "usage_rollup_totals": f"""WITH d AS ({_DAILY}) SELECT day, name, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors
        FROM d GROUP BY ROLLUP (day, name)""",
    "latency_histogram": """WITH b(le) AS (VALUES (5), (25), (100), (500), (2000), (10000), (NULL)),
        t AS (SELECT event_type AS name, round(sum(value), 4) AS ms_sum FROM events GROUP BY 1)
        SELECT t.name, t.ms_sum, coalesce(b.le::VARCHAR, '+Inf') AS le, (SELECT count(*) FROM events e WHERE e.event_type = t.name AND (b.le IS NULL OR e.value <= b.le)) AS n FROM t, b""",
    "usage_retention": """WITH r AS (SELECT event_id, ts, event_type AS name FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY)
        SELECT * FROM r ORDER BY event_id DESC LIMIT 500000""",
    "usage_shape_json": """SELECT event_type AS name, count(k) AS n, sum(k)::BIGINT AS k_sum, max(k) AS k_max
        FROM (SELECT event_type, (props::JSON ->> '$.k')::INTEGER AS k FROM events) GROUP BY 1""",
    "usage_pseudonyms": """SELECT ('0x' || substr(sha256('salt:' || user_id), 1, 12))::BIGINT AS who, count(*) AS calls FROM events GROUP BY 1""",
    "activity_window": """WITH e AS (SELECT user_id AS who, ts AS m, (ts::DATE - (event_id % 14)::INTEGER)::TIMESTAMP AS a FROM events)
        SELECT who, count(*) FILTER (a >= TIMESTAMP '2024-01-20') AS added, count(*) FILTER (a < TIMESTAMP '2024-01-20') AS modified
        FROM e WHERE m >= TIMESTAMP '2024-01-20' GROUP BY who""",
}
