"""Numpy helpers that run inside Arrow functions: word hashes, window minima, sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _grow(name: str, base: int, n: int) -> np.ndarray:
    have = _tables.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), U(base), dtype=U)
        out[0] = U(1)
        _tables[name] = have = np.multiply.accumulate(out)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, with a leading 0; see span_hash."""
    out = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * _grow("up", BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes give equal hashes."""
    down = _grow("down", INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


#: Spans that are longer get a hash of another kind: modulo 2**64 a polynomial takes some built strings of 1,024 bytes for equal.
LONG_SPAN = 256


def word_hash(buf: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of any length; equal bytes give equal hashes."""
    out = span_hash(sums, start, end)
    for k in np.flatnonzero(end - start > LONG_SPAN):
        out[k] = U(xxhash.xxh3_64_intdigest(buf[start[k] : end[k]].tobytes(), seed=1))
    return out


#: Bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one byte array, a space after each, and where each starts (and the end)."""
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    at = np.concatenate(([0], np.cumsum(sizes)))
    return np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8), at


def word_spans(buf: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text (and the end) the number of its first word."""
    gap = space[buf]
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, end, np.searchsorted(start, at)


def shingles(raw: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles (fewer words: the whole sequence)."""
    buf, at = joined([r.lower() for r in raw])
    start, end, first = word_spans(buf, at)
    words = word_hash(buf, prefix(buf), start, end)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(combine(words[a:b], min(n, b - a))) if b > a else np.empty(0, dtype=U)


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U(0x9FB21C651E98DF25) + words[k : len(words) - n + 1 + k])
    return mix(out + U(n))


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20, rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have about limit bytes (one text at least, rows at most); null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column).cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        ends, low, at = offsets[1:], offsets[0], 0
        while at < len(col):
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, low + limit, side="right"))))
            part = batch.slice(at, to - at)
            yield part, [x or b"" for x in col.slice(at, to - at).to_pylist()]
            at, low = to, ends[to - 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])
    return out


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array listed."""
    if not len(listed):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(listed, values)
    at[at == len(listed)] = 0
    return listed[at] == values
