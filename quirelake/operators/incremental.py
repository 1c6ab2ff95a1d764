"""Incremental upkeep of an index: change feeds, upserts, deletion diffs, reuse of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A derived table is made anew when the passages' number has moved by more than this share.
DRIFT = 0.1


def changed(objects: DataFrame, since: int, version: str = "version") -> DataFrame:
    """Keys and versions newer than a cursor; both come from the scan alone."""
    return objects.filter(F.col(version) > since).select("key", version)


def deleted(held: DataFrame, live: DataFrame) -> DataFrame:
    """Keys held that are no longer live. An empty live table against a held one is a failed read: nothing is deleted."""
    some = live.select(F.lit(True).alias("_live")).limit(1)
    gone = held.select("key").join(live.select("key"), "key", "left_anti")
    return gone.join(F.broadcast(some)).drop("_live")


def latest(rows: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Of rows with equal keys the newest; of equal versions one."""
    best = F.max_by(F.struct(*rows.columns), version).alias("_r")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("_r.*")


def first_copy(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first by order, as shifting pages may deliver one twice."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(index: DataFrame, delta: DataFrame, gone: DataFrame) -> DataFrame:
    """The index with every key of the delta replaced whole and the gone keys left out.

    index, delta: key and passage columns. Two anti-joins and a union; the index itself is never collected.
    """
    out = delta.select("key").union(gone.select("key")).distinct()
    return index.join(out, "key", "left_anti").unionByName(delta.join(gone.select("key"), "key", "left_anti"))


def next_cursor(cursor: int, seen: int, complete: bool) -> int:
    """The cursor moves only after a complete batch, and never back."""
    return max(cursor, seen) if complete else cursor


def own_words_changed(held: DataFrame, live: DataFrame, since: int) -> DataFrame:
    """Items to index again. held, live: item, child, and in live version: a held child is gone, has a newer version, or a
    live one that isn't held does (every such one where nothing is held)."""
    any_held = not held.isEmpty()
    both = held.select("item", "child", F.lit(True).alias("h")).join(live.select(F.col("item").alias("i2"), "child", "version"), "child", "full_outer")
    stale = F.col("version").isNull() | (F.col("version") > since)
    if not any_held:
        stale = stale | F.col("h").isNull()
    return both.filter(stale).select(F.coalesce("item", "i2").alias("item")).distinct()


def without_vector(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    return passages.join(vectors.select("id"), "id", "left_anti")


def reused_vectors(passages: DataFrame, old: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, vector) for passages whose id and text are as before; texts meet as digests."""
    sha = F.sha2("text", 256).alias("_sha")
    same = passages.select("id", sha).join(old.select("id", sha), ["id", "_sha"])
    return same.select("id").join(vectors, "id")


def full_text_targets(objects: DataFrame, indexed: DataFrame, refreshed: DataFrame, since: int) -> DataFrame:
    """Indexed keys whose text is newer than its own cursor and that the delta hasn't refreshed already."""
    new = objects.filter(F.col("textVersion") > since).select("key")
    return new.join(indexed.select("key"), "key", "left_semi").join(refreshed.select("key"), "key", "left_anti")


def resume_at(saved: dict | None, now: dict, rows: int) -> int | None:
    """Where a build goes on: the saved offset if backend, total and version are as they were, else 0; null if the
    checkpoint can't be used, as the index is empty or was made by another embedder."""
    if not saved or not rows or saved.get("embedder") != now.get("embedder"):
        return None
    return saved.get("offset", 0) if all(saved.get(k) == now.get(k) for k in ("backend", "total", "version")) else 0


def drifted(was: int, now: int) -> bool:
    return abs(now - was) > DRIFT * max(was, 1)


def sync_report(objects: DataFrame, tombstones: DataFrame, since: int) -> DataFrame:
    """(type, change, n) of objects(type, key, version) and tombstones(type, key, version) since a cursor."""
    new = objects.filter(F.col("version") > since).select("type", F.lit("changed").alias("change"))
    return new.union(tombstones.filter(F.col("version") > since).select("type", F.lit("deleted"))).groupBy("type", "change").agg(F.count("*").alias("n"))
