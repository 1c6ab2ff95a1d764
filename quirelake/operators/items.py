"""Structured search over items, tag and hierarchy operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_any(parameter: str | list[str] | None, has, annotation: Column | None = None) -> Column:
    """The filter language: "a || b" is either, a leading "-" negates (true if any alternative is missing, and
    never for an annotation), "\\-" is a plain hyphen, several parameters and "a && b" must all hold."""
    given = [parameter] if isinstance(parameter, str) else list(parameter or [])
    parts = [p for raw in given for p in split_conjunction(raw)]
    out = F.lit(True)
    for raw in parts:
        negate = raw.startswith("-")
        s = raw[1:] if negate else raw
        s = s[1:] if s.startswith("\\-") else s
        options = [has(v.strip()) for v in s.split("||")]
        if negate:
            one = reduce(lambda a, b: a | b, [~o for o in options])
            one = one & ~annotation if annotation is not None else one
        else:
            one = reduce(lambda a, b: a | b, options)
        out = out & F.coalesce(one, F.lit(negate))
    return out


def split_conjunction(raw: str) -> list[str]:
    return [p for p in (x.strip() for x in raw.split("&&")) if p]


#: What a search for words reads: title, creators and year, or these with every other text column.
NARROW, WIDE = ["title", "creators", "date"], ["title", "creators", "date", "abstractNote", "text", "publicationTitle"]


def search(items: DataFrame, tag: str | list[str] | None = None, item_type: str | list[str] | None = None, text: str | None = None, top: bool = False, since: int | None = None, trashed: bool = False, keys: list | None = None, everything: bool = False) -> DataFrame:
    """Items(key, itemType, tags, title, ...) that meet every filter; columns that a filter doesn't need may be missing.

    text: a part of title, creators or date; with everything each of its words is a part of any text column. keys: only these items.
    Trashed items are left out unless they are asked for.
    """
    note = F.col("itemType") == "annotation"
    where = has_any(tag, lambda v: F.array_contains("tags", v), note) & has_any(item_type, lambda v: F.col("itemType") == v, note)
    if text:
        fields = F.lower(F.concat_ws("\n", *[F.col(c) for c in (WIDE if everything else NARROW) if c in items.columns]))
        where &= fields.contains(text.lower()) if not everything else reduce(Column.__and__, [fields.contains(w) for w in text.lower().split()])
    if keys is not None:
        where &= F.col("key").isin(keys)
    if top:
        where &= F.col("parentItem").isNull()
    if since is not None:
        where &= F.col("version") > since
    if "deleted" in items.columns and not trashed:
        where &= ~F.coalesce("deleted", F.lit(False))
    return items.filter(where)


def page(df: DataFrame, *order, start: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(limit)


def quick_search(items: DataFrame, text: str, narrow: list[str], wide: list[str]) -> DataFrame:
    """A search in few fields, repeated once over more of them if nothing is found."""
    hit = lambda cols: reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(text.lower()), F.lit(False)) for c in cols])
    first = items.filter(hit(narrow))
    return items.filter(hit(wide)) if first.isEmpty() else first


def tag_counts(items: DataFrame) -> DataFrame:
    """(tag, items) from items(key, tags)."""
    return items.select("key", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("items"))


def tag_listing(items: DataFrame, part: str | None = None, limit: int | None = None) -> DataFrame:
    """(tag, items, automatic, total) from items(key, tags, auto_tags), by name: tags that have the part, case aside, how many items carry each,
    whether none was given by a reader, and how many such tags there are."""
    given = items.select("key", F.explode(F.array_distinct("tags")).alias("tag"), F.lit(False).alias("automatic"))
    auto = items.select("key", F.explode(F.array_distinct("auto_tags")).alias("tag"), F.lit(True).alias("automatic"))
    found = given.unionByName(auto).groupBy("tag").agg(F.count_distinct("key").alias("items"), F.bool_and("automatic").alias("automatic"))
    found = found.filter(F.lower("tag").contains(part.lower())) if part else found
    total = found.agg(F.count("*").alias("total"))
    out = found.orderBy("tag")
    return (out.limit(limit) if limit else out).join(F.broadcast(total))  # total is one row


def off_vocabulary(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags that the vocabulary(tag, tier) doesn't have."""
    return counts.join(vocabulary.select("tag"), "tag", "left_anti")


def missing_tiers(items: DataFrame, vocabulary: DataFrame, required: list[str]) -> DataFrame:
    """(key, tier) of required tiers from which an item has no tag; one pass over items, no cross join."""
    named = items.select("key", F.explode_outer("tags").alias("tag")).join(vocabulary, "tag", "left")
    have = named.groupBy("key").agg(*[F.bool_or(F.coalesce(F.col("tier") == t, F.lit(False))).alias(f"t{k}") for k, t in enumerate(required)])
    tiers = F.array(*[F.when(~F.col(f"t{k}"), F.lit(t)) for k, t in enumerate(required)])
    return have.select("key", F.explode(F.array_compact(tiers)).alias("tier"))


def retag(tags: Column, add: Column, remove: Column) -> Column:
    return F.array_except(F.array_union(tags, add), remove)


def symmetric(links: DataFrame) -> DataFrame:
    """(a, b) with both directions of every link."""
    return links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()


def to_top(child: DataFrame, parents: DataFrame, hops: int = 3) -> DataFrame:
    """child(key, parentItem) with its top-level ancestor; parents: the same table or a superset.

    A row that has come to its top has nothing more to look for; these are spread by their own keys, so they don't meet in one task.
    """
    out = child.withColumn("top", F.coalesce("parentItem", "key")).withColumn("_up", F.col("parentItem"))
    up = parents.filter("parentItem is not null").select(F.col("key").alias("_k"), F.col("parentItem").alias("_p"), (F.xxhash64("key") % 1).alias("_z"))
    for _ in range(hops - 1):
        out = out.withColumn("_done", F.when(F.col("_up").isNull(), F.xxhash64("key").bitwiseOR(1)).otherwise(0))
        out = out.join(up, (F.col("_up") == F.col("_k")) & (F.col("_done") == F.col("_z")), "left").withColumn("_up", F.col("_p")).withColumn("top", F.coalesce("_up", "top")).drop("_k", "_p", "_z", "_done")
    return out.drop("_up")


def text_budget(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """rows(key, ..., text) cut so that no key has over `most` characters; rows past that go."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.withColumn("_before", before).filter(F.col("_before") < most)
    return cut.withColumn("text", F.substr("text", F.lit(1), (most - F.col("_before")).cast("int"))).drop("_before")


def page_offsets(pages: DataFrame, key: str, order: str, gap: int = 2) -> DataFrame:
    """Start and end of each page's text in its document, pages joined by a separator of gap characters."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(w), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


#: A heading counts for so many lines.
HEADING_LINES = 200


def last_heading(lines: DataFrame, key: str, order: str, heading: Column, within: int = HEADING_LINES) -> DataFrame:
    """lines with the last heading at or before each, no more than so many lines before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(heading, F.struct(F.col(order).alias("at"), F.col("text").alias("text"))), ignorenulls=True).over(w)
    return lines.withColumn("section", F.when(F.col(order) - last["at"] <= within, last["text"]))


def activity(items: DataFrame, since: Column) -> DataFrame:
    """(who, added, modified) of items(who, dateAdded, dateModified) changed since then."""
    recent = items.filter(F.col("dateModified") >= since)
    return recent.groupBy("who").agg(F.count_if(F.col("dateAdded") >= since).alias("added"), F.count_if(F.col("dateAdded") < since).alias("modified"))
