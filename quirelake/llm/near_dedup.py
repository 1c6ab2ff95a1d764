"""MinHash near-deduplication with odd sketches, confirmed on full shingle sets.

1. An Arrow function turns each text into the digest of its shingle set, BANDS band keys of ROWS
   MinHash samples each, and an odd sketch: the samples folded into a parity bitmap. Rows with equal
   sets collapse to one representative (the smallest doc_id), combined before the shuffle.
2. Representatives that share a band key meet at the key's smallest member, the hub. The population
   count of the xor of two odd sketches estimates their similarity; pairs whose estimate is far below
   the threshold go, the others are confirmed on the full sets, streamed past the hub's set.
3. Confirmed links are joined to components. Where a key still has members in different components,
   those outside its largest one are tested against all members of other components by a finer odd
   sketch, the parity bitmap of the whole set, whose xor counts the two sets' differences nearly exactly.
   A pair is tested in the first key it shares only (all 64 bits of the keys are compared), and what is left is
   confirmed as before; inside one component no pair is ever needed. So no link between components is left out, without all pairs of a group of copies. Keys with over
   KEY_MEMBERS members are compared in blocks, dealt to tasks by block pair.

Two sets with similarity 0.8 share no band with probability (1 - 0.8**ROWS)**BANDS = 2e-9, the first odd
sketch rejects such a pair about 6 standard deviations off and the second DEVIATIONS off. Set members are
64-bit hashes of word sequences, sets are told apart by 128 bits and their size, band keys by 64 bits.

Words are what [^\\x20\\x09-\\x0D]+ matches after lower-casing A-Z. Cases: with fewer words than a
shingle the whole sequence is one shingle; without words or with a null text the set is empty, the
row is linked with nothing and its component is its own doc_id. Repeated rows each get a row and
share a component, and where doc_ids repeat or are null, rows are linked by a number of their own: a
component's id is then the smallest doc_id in it (null if all are), and every row that has it is kept, so
dropping repeated rows is left to the caller. Empty tables give no rows. Only doc_id and text are read, so
other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import fits, possible
from .kernels import U, chunks, mix, shingles
from .util import components, staged

BANDS, ROWS, SKETCH_WORDS = 50, 5, 8
SAMPLES = BANDS * ROWS
#: Estimated similarity below which a pair is not confirmed.
LEAST_ESTIMATE = 0.6
#: Members of a hub that one task confirms in a row; more are dealt over further tasks.
HUB_MEMBERS = 2000
#: Bits of the finer sketch, members of a key that are compared in one block, and how far off a pair is rejected.
FINE_BITS, KEY_MEMBERS, DEVIATIONS = 4096, 2048, 5
FEATURES = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch array<long>, fine binary"
OPEN = ["key", "u", "v", "band", "block", "doc_id", "label", "hub", "n_shingles", "keys", "fine"]
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U(2) + U(1)
ROW_FACTORS = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * U(2) + U(1)
SALTS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)


def most_bits(estimate: float) -> int:
    """Population count that a pair's sketches are expected to have in xor at this similarity."""
    n = 64 * SKETCH_WORDS
    return round(n / 2 * (1 - (1 - 2 / n) ** (2 * SAMPLES * (1 - estimate))))


def samples(values: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, U((1 << 64) - 1))
    for at in range(0, len(values), 512):
        np.minimum(low, np.multiply.outer(FACTORS, values[at : at + 512]).min(axis=1), out=low)
    return low


def parity(values: np.ndarray) -> bytes:
    """The set folded into a parity bitmap of FINE_BITS."""
    bit = (mix(values ^ SALTS[1]) & U(FINE_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=FINE_BITS) & 1).astype(np.uint8)).tobytes()


def within_reach(both_sizes: np.ndarray, percent: int) -> np.ndarray:
    """Largest xor count of two parity bitmaps whose sets, of so many members together, can reach the threshold."""
    n, d = FINE_BITS, both_sizes * ((100 - percent) / (100 + percent))
    mean = n / 2 * (1 - (1 - 2 / n) ** d)
    var = n / 4 * (1 - (1 - 4 / n) ** d) + n * n / 4 * ((1 - 4 / n) ** d - (1 - 2 / n) ** (2 * d))
    return mean + DEVIATIONS * np.sqrt(np.maximum(var, 0)) + 1


def across(open_rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that the finer sketch leaves. open_rows: OPEN, all rows of a key's block pair."""

    def pairs(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        doc, label, size, hub, band, block = (part.column(c).to_numpy() for c in ("doc_id", "label", "n_shingles", "hub", "band", "block"))
        kinds, at, n = np.unique(label, return_inverse=True, return_counts=True)
        rest = at != n.argmax()
        if len(kinds) < 2:
            return doc[:0], doc[:0]
        bits = np.frombuffer(b"".join(part.column("fine").to_pylist()), dtype=np.uint64).reshape(len(doc), -1)
        keys = part.column("keys").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        apart = part.column("u")[0] != part.column("v")[0]
        a, b = [], []
        for i in np.flatnonzero(rest & (doc != hub)):
            far = (label != label[i]) & (doc != hub) & (~rest | (doc > doc[i]))
            far &= (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent)
            if apart:
                far &= block != block[i]
            other = np.flatnonzero(far)
            other = other[np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1) <= within_reach(size[other] + size[i], percent)]
            #: Only in the first key that the two share.
            other = other[~(keys[other, : band[i]] == keys[i, : band[i]]).any(axis=1)]
            a.append(np.minimum(doc[other], doc[i]))
            b.append(np.maximum(doc[other], doc[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (doc[:0], doc[:0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs(pa.Table.from_batches(held))], names=["a", "b"])

        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "u", "v")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and tuple(ids[x]) != at:
                    yield flush()
                    held = []
                at = tuple(ids[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield flush()

    return open_rows.select(OPEN).repartition("key", "u", "v").sortWithinPartitions("key", "u", "v").mapInArrow(run, "a long, b long")


def features(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            sets = list(shingles(raw, n))
            sig = np.stack([samples(s) for s in sets])
            keys = (sig.reshape(-1, BANDS, ROWS) * ROW_FACTORS).sum(axis=2, dtype=np.uint64)
            keys = mix(keys + SALTS[:BANDS]).view(np.int64)
            bit = (mix(sig + SALTS) & U(64 * SKETCH_WORDS - 1)).astype(np.int64)
            odd = np.zeros((len(raw), 64 * SKETCH_WORDS), dtype=np.uint8)
            np.bitwise_xor.at(odd, (np.arange(len(raw))[:, None], bit), 1)
            sketch = np.packbits(odd, axis=1).view(np.int64)
            size = np.array([len(s) for s in sets], dtype=np.int64)
            d = [np.array([f(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64) for f in (mix, lambda s: mix(s ^ SALTS[0]))]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * w), pa.array(x.ravel())) for x, w in ((keys, BANDS), (sketch, SKETCH_WORDS))]
            fine = pa.array([parity(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), *map(pa.array, d), *lists, fine], names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch", "fine"])

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def _alike(a: str, b: str) -> Column:
    """Whether the odd sketches and set sizes of two rows leave the threshold within reach."""
    return F.expr(" + ".join(f"bit_count({a}.sketch[{w}] ^ {b}.sketch[{w}])" for w in range(SKETCH_WORDS)) + f" <= {most_bits(LEAST_ESTIMATE)}")


def _sizes(a: str, b: str, percent: int) -> Column:
    least, most = F.least(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")), F.greatest(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    return least * 100 >= most * percent


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets.

    Each b's set is sent once for each of its hubs a, in portions of HUB_MEMBERS that each get a's set too.
    Where the asked ids' Bloom filter is small enough, only texts that it may hold are shuffled.
    """
    dealt = staged(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("m") / HUB_MEMBERS)))).select("a", "b", "salt"), "pairs")
    asked = dealt.select(F.col("b").alias("doc_id"), "a", "salt").union(dealt.select(F.col("a"), "a", "salt").distinct())

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            held = pa.array([s.tobytes() for s in shingles(raw, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("salt"), part.column("doc_id"), held], names=["a", "salt", "doc_id", "held"])

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub = None, None
        for batch in batches:
            a, b = [], []
            for x, salt, y, held in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "doc_id", "held")), strict=True):
                own = np.frombuffer(held, dtype=np.uint64)
                if at != (x, salt):
                    at, hub = (x, salt), own
                    continue
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if both * 100 >= percent * (len(hub) + len(own) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    texts, n_asked = docs.select("doc_id", "text"), 2 * dealt.count()
    if fits(n_asked):
        key = F.col("doc_id").cast("string").alias("key")
        texts = possible(texts.filter("doc_id is not null").select("doc_id", "text", key), asked.select(key), n_asked).select("doc_id", "text")
    texts = asked.join(texts, "doc_id").select("a", "salt", "doc_id", "text").mapInArrow(sets, "a long, salt long, doc_id long, held binary")
    near = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", (F.col("doc_id") != F.col("a")), "doc_id")
    return staged(near.mapInArrow(links, "a long, b long"), "links")


def near_dedup(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row of docs."""
    rows = staged(features(docs, shingle), "features")
    n, distinct = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == distinct:
        return linked(rows, docs, shingle, percent)
    numbered = staged(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    own = numbered.select(F.col("row").alias("doc_id"), "text")
    parts = linked(staged(features(own, shingle), "features"), own, shingle, percent).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    parts = staged(numbered.select("doc_id", "row").join(parts, "row"), "parts")
    least = parts.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = parts.join(least, "component_id")
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def linked(rows: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """near_dedup of docs whose ids are distinct and not null; rows: their features."""
    sets = rows.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    sets = staged(sets, "sets")
    reps = staged(rows.join(sets.select(F.col("rep").alias("doc_id")), "doc_id").select("doc_id", "n_shingles", "sketch", "keys", "fine"), "reps")
    bands = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    met = staged(bands.join(hubs, "key"), "met")

    small = reps.select("doc_id", "n_shingles", "sketch")

    def tested(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sketches and sizes leave."""
        p = pairs.alias("p").join(small.alias("x"), F.col("p.a") == F.col("x.doc_id")).join(small.alias("y"), F.col("p.b") == F.col("y.doc_id"))
        return p.filter(_sizes("x", "y", percent) & _alike("x", "y")).select("p.a", "p.b")

    def counted(pairs: DataFrame) -> DataFrame:
        """m: how many b each a has."""
        held = staged(pairs, "candidates")
        return held.join(held.groupBy("a").agg(F.count("*").alias("m")), "a")

    stars = met.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = confirmed(counted(tested(stars)), docs, shingle, percent)
    labels = components(found)
    #: Keys whose members are still in different components.
    named = met.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", "hub", "m", F.coalesce("label", "doc_id").alias("label"))
    split = named.filter("doc_id <> hub").groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    blocks = F.ceil(F.col("m") / KEY_MEMBERS).cast("int")
    dealt = named.join(split, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    whole = dealt.filter("blocks = 1").withColumn("other", F.lit(0))
    parts = dealt.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = whole.unionByName(parts).select("key", "band", "doc_id", "label", "hub", "block", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"))
    own = reps.select("doc_id", "n_shingles", "keys", "fine")
    more = confirmed(counted(across(units.join(own, "doc_id"), percent)), docs, shingle, percent)
    labels = components(found.union(more))
    out = rows.join(sets, ["d1", "d2", "n_shingles"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
