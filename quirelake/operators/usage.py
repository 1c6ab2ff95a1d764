"""Usage analytics over an event log: events(ts timestamp, kind, name, user_id, ok boolean, ms)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import staged

#: Upper bounds of the latency buckets, in ms.
BUCKETS = [5, 25, 100, 500, 2000, 10000]
RETAIN_DAYS, RETAIN_ROWS = 30, 500_000


def from_event_table(events: DataFrame) -> DataFrame:
    """The usage shape of the driver's events table."""
    return events.select("event_id", "ts", F.lit("tool").alias("kind"), F.col("event_type").alias("name"), "user_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), F.col("props").alias("shape"))


#: Groups of more rows find their percentiles by distributed selection: parts of a value range in a round, and parts that a group's rows are dealt to.
GROUP_ROWS, PARTS, SALTS = 100_000, 256, 16
#: Ranges to be searched are broadcast up to this number.
BROADCAST_RANGES = 100_000


def same(keys: list[str]) -> Column:
    """Whether the keys agree with those of the other side, called _key0, _key1, ...; null agrees with null."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)])


def as_other(keys: list[str]) -> list[Column]:
    return [F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share: the smallest value that has so large a share of the group's values at or below it.

    Every group and share has a range of values and a rank in it. In a round the range is cut into PARTS equal ones, their rows are
    counted before the shuffle, and the part that holds the rank is the next range, from its least to its greatest value, until both are one.
    So a group's rows never meet, however many it has. Nulls don't count; a group of nulls has nulls.
    """
    rows = staged(rows.select(*keys, F.col(value).cast("double").alias("_v"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("_salt")), "values")
    whole = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("_share"), F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.col("_n"), 9))).cast("long").alias("_rank")) for n, p in shares.items()]))
    open_, done = staged(whole.select("*", asked.alias("x")).select(*keys, "x._share", "_lo", "_hi", "x._rank"), "ranges"), []
    while True:
        done.append(open_.filter("_lo is null or _lo = _hi").select(*keys, "_share", "_lo"))
        open_ = open_.filter("_lo < _hi")
        n = open_.count()
        if not n:
            break
        ranges = open_.select(*as_other(keys), "_share", "_lo", "_hi", "_rank", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("_s"))
        ranges = F.broadcast(ranges) if n * SALTS <= BROADCAST_RANGES else ranges
        #: Halves first, so that a range from the least to the greatest double has a width.
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * PARTS)).cast("int")
        met = rows.join(ranges, same(keys) & (F.col("_salt") == F.col("_s")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = met.groupBy(*keys, "_share", "_rank", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_share").orderBy("_part"))
        held = counts.withColumn("_upto", upto).filter("_rank > _upto - _c and _rank <= _upto")
        open_ = staged(held.select(*keys, "_share", "_lo", "_hi", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank")), "ranges")
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_share") == n, F.col("_lo"))).alias(n) for n in shares])


def daily(events: DataFrame) -> DataFrame:
    """By UTC day, kind, name and user: calls, errors, sum, nearest-rank p50 and p95, max. A null user is a group.

    Groups of up to GROUP_ROWS rows have their percentiles from one aggregate, larger ones from nearest_rank().
    """
    keys, shares = ["day", "kind", "name", "user_id"], {"ms_p50": 0.5, "ms_p95": 0.95}
    rows = events.withColumn("day", F.to_date("ts"))
    plain = [F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.sum("ms"), 4).alias("ms_sum")]
    disc = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)").alias(n) for n, p in shares.items()]
    large = staged(rows.groupBy(*keys).count().filter(F.col("count") > GROUP_ROWS).select(*as_other(keys)), "large")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(*plain, *disc, F.max("ms").alias("ms_max"))
    small = rows.join(large, same(keys), "left_anti").groupBy(*keys).agg(*plain, *disc, F.max("ms").alias("ms_max"))
    hot = rows.join(large, same(keys), "left_semi")
    ranks = nearest_rank(hot, keys, "ms", shares).select(*as_other(keys), *shares)
    sums = hot.groupBy(*keys).agg(*plain, F.max("ms").alias("ms_max"))
    return small.unionByName(sums.join(ranks, same(keys)).select(*keys, "calls", "errors", "ms_sum", *shares, "ms_max"))


def by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(F.countDistinct("user_id").alias("users"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.round(F.sum("ms_sum") / F.sum("calls"), 7).alias("ms_mean"))


def by_key(rows: DataFrame, key: str, top: int = 15) -> DataFrame:
    """The most called names (or users) with their worst daily p95 and active days."""
    out = rows.groupBy(key).agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("ms_p95").alias("ms_p95"), F.countDistinct("day").alias("days"))
    return out.orderBy(F.desc("calls"), key).limit(top)


def totals(rows: DataFrame) -> DataFrame:
    """Calls and errors by day and name, with the day's and the grand total (null keys)."""
    return rows.rollup("day", "name").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))


def histogram(events: DataFrame, buckets: list[int] = BUCKETS) -> DataFrame:
    """Cumulative latency buckets of every name, one row a bucket; le is null for +Inf."""
    counts = events.groupBy("name").agg(*[F.count_if(F.col("ms") <= b).alias(f"b{b}") for b in buckets], F.count("ms").alias("inf"), F.round(F.sum("ms"), 4).alias("ms_sum"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in buckets], F.struct(F.lit(None).cast("int").alias("le"), F.col("inf").alias("n")))
    return counts.select("name", "ms_sum", F.inline(rows))


def exposition(hist: DataFrame, metric: str = "tool_ms") -> DataFrame:
    """The histogram as lines of the text exposition format: buckets, sum and count of every name."""
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    buckets = hist.select(F.format_string(metric + '_bucket{name="%s",le="%s"} %d', "name", le, "n").alias("line"))
    ends = hist.filter("le is null").select(F.explode(F.array(F.format_string(metric + '_sum{name="%s"} %.4f', "name", "ms_sum"), F.format_string(metric + '_count{name="%s"} %d', "name", "n"))).alias("line"))
    return buckets.union(ends)


def refreshed(held: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Daily rows up to date: those before yesterday as they are held, the others made anew from the events."""
    since = F.date_sub(F.to_date(now), 1)
    return held.filter(F.col("day") < since).unionByName(daily(events.filter(F.col("ts") >= since.cast("timestamp"))))


def shape(args: Column) -> Column:
    """What a call's arguments were like, never what they were: a map of JSON values as a map of kinds and sizes."""
    def kind(v: Column) -> Column:
        sized = lambda name, n: F.concat(F.lit(f"{name}("), n.cast("string"), F.lit(")"))
        return (
            F.when(v.isin("true", "false"), v).when(v.rlike(r"^-?[0-9][0-9.eE+-]*$"), "number").when(v.startswith("["), sized("array", F.size(F.from_json(v, "array<string>"))))
            .when(v.startswith("{"), sized("object", F.size(F.from_json(v, "map<string,string>")))).otherwise(sized("string", F.length(v)))
        )

    return F.transform_values(F.map_filter(args, lambda k, v: v.isNotNull()), lambda k, v: kind(v))


def retained(events: DataFrame, now: Column, days: int = RETAIN_DAYS, most: int = RETAIN_ROWS) -> DataFrame:
    """Events of the last days; of more than `most` the ones with the highest ids stay.

    The cut id comes from counts by id range, so no task sorts all rows.
    """
    recent = events.filter(F.col("ts") >= now - F.make_interval(days=F.lit(days)))
    total, low, high = recent.agg(F.count("*"), F.min("event_id"), F.max("event_id")).first()
    while total > most and low < high:
        step = max(1, (high - low + 1) // 1024)
        counts = recent.filter(F.col("event_id").between(low, high)).groupBy(F.floor((F.col("event_id") - low) / step).alias("b")).count().orderBy(F.desc("b")).collect()
        above = recent.filter(F.col("event_id") > high).count()
        for b, n in counts:
            if above + n > most:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            above += n
        if step == 1:
            low = high + 1
    return recent if total <= most else recent.filter(F.col("event_id") >= low)


def error_class(status: Column, name: Column, code: Column) -> Column:
    """A stable name of few values for why a call failed: by HTTP status, else by the error's name or code."""
    c = F.lower(code)
    return (
        F.when(status.isNotNull(), F.concat(F.lit("http_"), F.floor(status / 100).cast("string"), F.lit("xx"))).when(name == "ValidationError", "validation")
        .when(c.startswith("err_sqlite"), "storage").when(c.rlike("abort|timeout|etimedout"), "timeout").when(c.isNotNull(), c).when(name.isNotNull() & (name != "Error"), name).otherwise("error")
    )


def pseudonym(user: Column, salt: str) -> Column:
    """The first 48 bits of a salted SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), user.cast("string")), 256), 1, 12), 16, 10).cast("long")


def token_ledger(texts: DataFrame, limit: int) -> DataFrame:
    """texts(caller, day, ord, text): estimated tokens, the caller's running sum of the day, and whether it is within the limit."""
    from pyspark.sql import Window

    t = texts.select("caller", "day", "ord", F.ceil(F.length("text") / 4).alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy("caller", "day").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("spent", run).withColumn("within", F.col("spent") <= limit)
