"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact confirmation.

An Arrow function scans whole texts against the benchmark's items. A window as long as an item can
reach the threshold only if that share of its shingles is among those of items of its length, so every window of which
that is true is taken, and no other. Each window's 64-bit SimHash (from running sums of its shingles' signs) is
looked up in a multi-index of BLOCKS blocks: two fingerprints within RADIUS bits agree to within
RADIUS // BLOCKS bits in one block at least, and the index lists an item under every value that near,
so all items within the radius are found. Candidates within the radius are confirmed by their exact
weighted-shingle similarity: the sum of smaller over the sum of larger shingle counts.

At similarity 0.8 the expected distance is 10 bits of 64 with a deviation of 3, RADIUS is 4
deviations above that.

The items are broadcast: up to ITEM_BYTES of text at a time. A larger benchmark is taken in as many
blocks, each with a scan of its own that is staged before the next block is read, so neither the driver
nor a task holds more than one. Words are what [^\\x20\\x09-\\x0D]+ matches after lower-casing A-Z. Cases:
items and windows with fewer words than a shingle are one shingle as a whole; null or empty texts and
items match nothing. Repeated rows each get their own; empty tables give no rows. Only doc_id, text
and item_id are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, among, chunks, combine, joined, mix, prefix, word_hash, word_spans
from .util import staged

BLOCKS, RADIUS = 8, 22
ITEM_BYTES = 16 << 20
MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long"
#: Bits of the screen of listed shingles.
SCREEN_BITS = 22


def signs(values: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of the (already mixed) hashes."""
    bits = np.unpackbits(mix(values ^ U(0x5851F42D4C957F2D)).view(np.uint8).reshape(len(values), 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit where the sum is positive."""
    return np.packbits(sums > 0, axis=1)


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, at = joined([r.lower() for r in raw])
    start, end, first = word_spans(buf, at)
    return word_hash(buf, prefix(buf), start, end), first


class Items:
    """The multi-index of a block of items."""

    def __init__(self, ids: list[int], texts: list[bytes], n: int):
        words, first = words_of(texts)
        self.n, self.ids, self.size, self.counts, prints = n, [], [], [], []
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if b > a and ids[k] is not None:
                own = combine(words[a:b], min(n, b - a))
                self.ids.append(ids[k])
                self.size.append(int(b - a))
                self.counts.append(Counter(own.tolist()))
                prints.append(packed(signs(own).sum(axis=0, keepdims=True))[0])
        self.prints = np.array(prints, dtype=np.uint8).reshape(-1, 8)
        listed = np.array([x for c in self.counts for x in c], dtype=np.uint64)
        self.screen = np.zeros(1 << SCREEN_BITS, dtype=bool)
        self.screen[(listed >> U(64 - SCREEN_BITS)).astype(np.int64)] = True
        self.listed = np.unique(listed)
        self.sizes = sorted(set(self.size))
        self.of_size = {s: np.array(sorted({x for c, own in zip(self.counts, self.size, strict=True) if own == s for x in c}), dtype=np.uint64) for s in self.sizes}
        #: Of each size, block and block value the items listed there, in one array with offsets.
        near = [0] + [reduce(lambda v, b: v | 1 << b, c, 0) for d in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(8), d)]
        self.index = {}
        for size in self.sizes:
            own = np.array([k for k, s in enumerate(self.size) if s == size])
            for block in range(BLOCKS):
                values = (self.prints[own, block][:, None] ^ np.array(near, dtype=np.uint8)).ravel()
                order = np.argsort(values, kind="stable")
                self.index[size, block] = np.searchsorted(values[order], np.arange(257)), np.repeat(own, len(near))[order]

    def candidates(self, size: int, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs within RADIUS, among items of this size."""
        pairs = []
        for block in range(BLOCKS):
            offsets, items = self.index[size, block]
            v = prints[:, block].astype(np.int64)
            n = offsets[v + 1] - offsets[v]
            window = np.repeat(np.arange(len(v)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([window, items[np.repeat(offsets[v], n) + inside]], axis=1))
        pairs = np.concatenate(pairs)
        far = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]).sum(axis=1)
        return np.unique(pairs[far <= RADIUS], axis=0)

    def matches(self, words: np.ndarray, hits: np.ndarray, values: np.ndarray, least: float) -> dict[int, tuple[float, int, int]]:
        """For each item found in a text its best similarity, first word and number of words.

        hits, values: the numbers and hashes of the text's listed shingles.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            n = min(self.n, size)
            if len(words) < n:
                continue
            mine = hits[among(values, self.of_size[size])]
            if len(mine) < least * (min(size, len(words)) - n + 1):
                continue
            seen = np.zeros(len(words) - n + 2, dtype=np.int64)
            seen[mine + 1] = 1
            width = min(size, len(words))
            seen, own_shingles = np.cumsum(seen), width - n + 1
            starts = np.flatnonzero(seen[own_shingles:] - seen[:-own_shingles] >= least * own_shingles)
            for part in (starts[k : k + 4096] for k in range(0, len(starts), 4096)):
                low, high = int(part[0]), int(part[-1]) + width
                own = combine(words[low:high], n)
                sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)])
                at = part - low
                prints = packed(sums[at + width - n + 1] - sums[at])
                for w, item in self.candidates(size, prints):
                    mine, theirs = Counter(own[at[w] : at[w] + width - n + 1].tolist()), self.counts[item]
                    both = sum((mine & theirs).values())
                    score = both / (mine.total() + theirs.total() - both)
                    if score >= least and score > best.get(self.ids[item], (0.0,))[0]:
                        best[self.ids[item]] = (score, int(part[w]), width)
        return best

    def scan(self, raw: list[bytes], least: float) -> Iterator[tuple[int, int, tuple[float, int, int]]]:
        """(number of the text, item, match) of all texts."""
        words, first = words_of(raw)
        if not len(words) or not self.ids:
            return
        short = self.sizes[0] < self.n
        for n in {min(self.n, s) for s in self.sizes}:  # one length, unless items are shorter than a shingle
            if len(words) < n:
                continue
            own = combine(words, n)
            maybe = np.flatnonzero(self.screen[(own >> U(64 - SCREEN_BITS)).astype(np.int64)])
            maybe = maybe[among(own[maybe], self.listed)]
            text = np.searchsorted(first, maybe, side="right") - 1
            inside = maybe + n <= first[text + 1]
            maybe, text = maybe[inside], text[inside]
            for t in np.unique(text):
                own_words = words[first[t] : first[t + 1]]
                at = maybe[text == t]
                found = self.matches(own_words, at - first[t], own[at], least)
                for item, match in found.items():
                    if not short or min(self.n, match[2]) == n:
                        yield int(t), item, match


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each item in each text, where it reaches least."""
    found = []
    for ids, texts, only in _blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_scanner(_maker(ids, texts, shingle), least), MATCHES)
        found.append(part if only else staged(part, "matches"))
    return reduce(DataFrame.union, found)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """The items in blocks of about ITEM_BYTES, one at least, and whether there is one only. All texts of an item are in one block."""
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // ITEM_BYTES))
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect() if n_blocks > 1 else items.collect()
        yield [r["item_id"] for r in part], [r["text"].encode("utf-8") for r in part], n_blocks == 1


#: Of a Python worker, the index that it built last: the tasks of a scan share it.
_held: dict[str, Items] = {}


def _index(key: str, ids: list[int], texts: list[bytes], shingle: int) -> Items:
    if key not in _held:
        _held.clear()
        _held[key] = Items(ids, texts, shingle)
    return _held[key]


def _maker(ids: list[int], texts: list[bytes], shingle: int) -> Callable[[], Items]:
    """What gives the index of a block in a task."""
    return partial(_index, uuid.uuid4().hex, ids, texts, shingle)


def _scanner(make: Callable[[], Items], least: float):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = make()
        for part, raw in chunks(batches, "text"):
            own = part.column("doc_id").to_pylist()
            rows = [(own[t], item, *match) for t, item, match in index.scan(raw, least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows whose text holds a benchmark item. All columns stay; each row is judged by its own text, whatever its doc_id.

    With several blocks the rows are numbered and staged, and the numbers of those that a block finds are dropped at the end.
    """
    row, found = "_row", []
    while row in docs.columns:
        row += "_"
    rows = docs
    for ids, texts, only in _blocks(benchmark):
        make = _maker(ids, texts, shingle)
        if only:
            return docs.mapInArrow(_keeper(make, least), docs.schema)
        if not found:
            rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        found.append(staged(rows.select(F.col(row).alias("doc_id"), "text").mapInArrow(_scanner(make, least), MATCHES).select(F.col("doc_id").alias(row)).distinct(), "found"))
    return rows.join(reduce(DataFrame.union, found), row, "left_anti").drop(row)


def _keeper(make: Callable[[], Items], least: float):
    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = make()
        for part, raw in chunks(batches, "text"):
            hit = {t for t, _, _ in index.scan(raw, least)}
            yield part.filter(pa.array([t not in hit for t in range(len(raw))], pa.bool_()))

    return keep
