"""Exact deduplication of a batch against an immutable snapshot, and within the batch.

A snapshot's distinct digests are split into buckets; each bucket has one static 3-wise binary-fuse
filter (8-bit fingerprints, false-positive rate 1/256), built once and kept beside the digests
(write_snapshot). Incoming digests are first pre-aggregated, so a text with any number of copies is one
row, and probe the filter of their bucket. Positives join the exact digests of the snapshot, which
removes false positives, and the bytes of all their texts are compared; what is new is grouped within
the batch.

Texts are equal when identical after deleting \x20 and \x09-\x0D. Their digest is the SHA-256 of the
normalised bytes with their length and a second 64-bit hash. If texts of a positive differ in spite of
equal digests, the operator stops with an error rather than call them equal.

Rows go back to their groups by digest and salt, each group to the salts that its rows have, so the
copies of one text don't meet in one task.

Cases: a null text counts as empty, and all empty texts are equal. Of equal texts the row with the
most code points in the original text stays, then the smallest doc_id (null ids last). A repeated row
counts once more in group_size; rows equal in doc_id and text are both kept or both dropped. Empty
tables give no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import fits, possible
from .kernels import U, mix
from .util import SALTS, salted, salts_seen, shared_dir, staged

GROUP, VALUES = ["sha", "bytes", "check"], ["n", "salts", "points", "keep_id"]
#: Digests for one filter, and for one task that probes it.
BUCKET_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def first_hash(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def second_hash(norm: Column) -> Column:
    return F.xxhash64(norm)


def with_digest(rows: DataFrame) -> DataFrame:
    """rows with the digest of their column norm."""
    return rows.withColumns({"sha": first_hash(F.col("norm")), "bytes": F.octet_length("norm"), "check": second_hash(F.col("norm"))})


def digests(docs: DataFrame) -> DataFrame:
    """Narrow rows; to be staged, as the salt is dealt row by row."""
    norm = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"), normalised(F.col("text")).alias("norm"))
    return with_digest(norm).select("doc_id", "points", *GROUP, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))


def rank(points: Column, doc_id: Column) -> Column:
    """What the row that stays has the most of."""
    return F.struct(points, doc_id.isNotNull(), F.coalesce(F.bitwise_not(doc_id), F.lit(0)))


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each distinct text: its copies, their salts and the best of them; combined before the shuffle."""
    best = F.max(F.struct(rank(F.col("points"), F.col("doc_id")).alias("rank"), "points", "doc_id")).alias("best")
    groups = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), salts_seen(F.col("salt")).alias("salts"), best)
    return groups.select(*GROUP, "n", "salts", F.col("best.points").alias("points"), F.col("best.doc_id").alias("keep_id"))


class FuseFilter:
    """A static 3-wise binary-fuse filter of 64-bit keys with 8-bit fingerprints."""

    def __init__(self, keys: np.ndarray | None = None, table: bytes | None = None, seed: int = 0, segment: int = 0):
        if keys is None:
            self.table, self.seed, self.segment = np.frombuffer(table, dtype=np.uint8), seed, segment
            return
        keys, self.seed, factor = np.unique(keys), 0, 1.0
        while True:
            n = max(len(keys), 2)
            self.segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
            size = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)) * n * factor
            self.table = np.zeros(max(3, int(np.ceil(size / self.segment)) + 2) * self.segment, dtype=np.uint8)
            if self._fill(keys):
                return
            self.seed, factor = self.seed + 1, factor * 1.02

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + U((self.seed * 0x9E3779B97F4A7C15) % (1 << 64)))
        first = ((h >> U(32)) * U(len(self.table) // self.segment - 2) >> U(32)).astype(np.int64) * self.segment
        inside = [((h >> U(s)) & U(self.segment - 1)).astype(np.int64) for s in (0, 18, 36)]
        return np.stack([first + k * self.segment + x for k, x in enumerate(inside)]), (mix(h) & U(255)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel slots that one key has, wave by wave, then assign fingerprints in reverse order."""
        slots, prints = self._slots(keys)
        count, owner = np.zeros(len(self.table), dtype=np.int64), np.zeros(len(self.table), dtype=np.int64)
        for row in slots:
            np.add.at(count, row, 1)
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        left, waves = len(keys), []
        alone = np.flatnonzero(count == 1)
        while len(alone):
            key, where = np.unique(owner[alone], return_index=True)
            waves.append((key, alone[where]))
            left -= len(key)
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(slots[:, key])
            alone = touched[count[touched] == 1]
        if left:
            return False
        for key, slot in reversed(waves):
            self.table[slot] = 0
            a, b, c = self.table[slots[0, key]], self.table[slots[1, key]], self.table[slots[2, key]]
            self.table[slot] = prints[key] ^ a ^ b ^ c
        return True

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(keys)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == prints


def _words(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in col.to_pylist()), dtype=np.uint64)


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("sha"), F.lit(n_buckets)).alias("bucket")


def build_filters(groups: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, n_buckets, seed, segment, fuse) rows, one for each non-empty bucket of the digests."""

    def build(keys: pa.Table) -> pa.Table:
        f = FuseFilter(_words(keys.column("sha")))
        values = {"n_buckets": (n_buckets, pa.int64()), "seed": (f.seed, pa.int64()), "segment": (f.segment, pa.int64()), "fuse": (f.table.tobytes(), pa.binary())}
        return pa.table({"bucket": keys.column("bucket")[:1].cast(pa.int64())} | {k: pa.array([v], kind) for k, (v, kind) in values.items()})

    return groups.select("sha", _bucket(n_buckets)).groupBy("bucket").applyInArrow(build, "bucket long, n_buckets long, seed long, segment long, fuse binary")


def write_snapshot(docs: DataFrame, path: str) -> None:
    """Keep a snapshot's row digests, distinct digests and filters under path; it must not exist, and is never changed."""
    spark = docs.sparkSession
    digests(docs).write.parquet(f"{path}/rows")
    grouped(spark.read.parquet(f"{path}/rows")).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    build_filters(groups, max(16, groups.count() // BUCKET_ROWS)).write.parquet(f"{path}/filters")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """incoming (one row a digest) with column possible: whether the snapshot's filter may hold it.

    A bucket's digests are dealt to as many parts as keep one near BUCKET_ROWS, each with the bucket's filter.
    """

    def probe(new: pa.Table, fuse: pa.Table) -> pa.Table:
        hit = np.zeros(new.num_rows, dtype=bool)
        if fuse.num_rows and new.num_rows:
            row = fuse.to_pylist()[0]
            hit = FuseFilter(table=row["fuse"], seed=row["seed"], segment=row["segment"]).may_have(_words(new.column("sha")))
        return new.select(names).append_column("possible", pa.array(hit, pa.bool_()))

    names, first = incoming.columns, filters.select("n_buckets").first()
    n_buckets = first["n_buckets"] if first else 1
    parts = max(1, incoming.count() // (n_buckets * BUCKET_ROWS))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in incoming.dtypes)}, possible boolean"
    dealt = incoming.withColumns({"bucket": _bucket(n_buckets), "part": F.pmod(F.xxhash64("check", "bytes"), F.lit(parts))})
    each = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("long"))
    return dealt.groupBy("bucket", "part").cogroup(each.groupBy("bucket", "part")).applyInArrow(probe, schema)


def compare_bytes(positives: DataFrame, *sides: DataFrame) -> None:
    """Stop if texts of the sides that share a positive's digest differ in a byte.

    A Bloom filter of second hashes leaves the texts of positives (where it is small enough to be broadcast), and
    of a task's equal digests the least and the greatest text go on, so copies are combined before the shuffle.
    """
    n = positives.count()
    if not n:
        return
    texts = sides[0].select("text").union(sides[1].select("text")).select(normalised(F.col("text")).alias("norm"))
    if fits(n):
        keys = positives.select(F.col("check").cast("string").alias("key"))
        texts = possible(texts.select("norm", second_hash(F.col("norm")).cast("string").alias("key")), keys, n)
    ends = with_digest(texts).groupBy(*GROUP).agg(F.min("norm").alias("least"), F.max("norm").alias("most")).filter("least <> most")
    differing = ends.join(positives.select(GROUP), GROUP, "left_semi").select(F.hex("sha").alias("sha")).first()
    if differing:
        raise ValueError(f"different texts share the digest {differing['sha']}, their length and their second hash")


def exact_dedup(incoming: DataFrame, snapshot: DataFrame | None = None, kept: str | None = None) -> DataFrame:
    """Every row of snapshot and incoming: doc_id, keep_id, group_size, kept, text_sha256.

    kept: the path that write_snapshot() gave the snapshot's digests and filters; without it they are made here.
    """
    spark = incoming.sparkSession
    rows = staged(digests(incoming), "digests")
    groups = grouped(rows)
    if snapshot is not None:
        if kept is None:
            kept = f"{shared_dir(spark)}/quirelake/snapshot-{uuid.uuid4().hex}"
            write_snapshot(snapshot, kept)
        old = spark.read.parquet(f"{kept}/groups")
        tested = staged(screen(staged(groups, "groups"), spark.read.parquet(f"{kept}/filters")), "tested")
        #: Positives meet the snapshot's exact digests; the join tells true from false ones.
        known = tested.filter("possible").select(*GROUP, *[F.col(c).alias(f"new_{c}") for c in VALUES])
        compare_bytes(staged(known.join(old.select(GROUP), GROUP, "left_semi").select(GROUP), "positives"), snapshot, incoming)
        met = old.join(known, GROUP, "full_outer")
        new_is_better = F.col("n").isNull() | (F.col("new_n").isNotNull() & (rank(F.col("new_points"), F.col("new_keep_id")) > rank(F.col("points"), F.col("keep_id"))))
        both = [(F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("n"), F.coalesce("salts", F.lit(0)).bitwiseOR(F.coalesce("new_salts", F.lit(0))).alias("salts")]
        met = met.select(*GROUP, *both, *[F.when(new_is_better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in VALUES[2:]])
        groups = met.union(tested.filter("not possible").select(*GROUP, *VALUES))
        rows = rows.union(spark.read.parquet(f"{kept}/rows"))
    out = rows.join(salted(groups.withColumnRenamed("points", "keep_points"), "salts"), [*GROUP, "salt"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
