"""Exact removal of repeated substrings by suffix arrays over shards.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id,
or earlier in the same text. Strings never cross texts and are judged on the input.

1. Anchors. Of the hashes of GRAM bytes inside every LENGTH-byte window the smallest is an anchor, so
   two equal windows have the same anchor at the same place. An anchor's context is what any window
   around it can cover. Anchors with equal context are told apart in the scan already: all but the
   first cover only repeated windows. The firsts go, packed by bucket of their hash, through one
   shuffle, and each bucket again keeps the first of every context.
2. Suffix arrays. Where an anchor has different contexts, these may share some windows only. A window
   that two contexts share reaches STEP * i bytes or more before the gram and STEP * j after it, for some
   i + j = STEPS, so hashes of these reaches tell which contexts share none, and how far the others need
   go to each side. Such contexts are dealt to shards by anchor, and each shard's text is sorted by induced sorting. Runs of
   permuted common prefixes of LENGTH or more are equal windows; all but the earliest are repeated.
   An anchor with over HOT contexts in a bucket would not fit in one task's suffix array, and splitting it
   over several would part equal windows: its windows are dealt by their own hashes (128 bits) instead,
   with equal ones combined before the shuffle. The result is the same.
3. The repeated stretches of a text are joined and cut out.

Contexts are equal if the hashes of gram, context (64 bits each), sides and reaches (16 bits each) are. Cases: a null text
counts as empty; texts under LENGTH bytes stay whole. Rows that repeat a doc_id count as one document
(so equal places in two of them remove neither), told apart by their text; a null doc_id comes after
all others. An empty table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U, chunks, mix, prefix, sliding_min, span_hash
from .suffix_array import permuted_lcp, suffix_array
from .util import staged

LENGTH, GRAM = 100, 32
#: A shared window has LENGTH - GRAM = 68 bytes around its gram, so whole steps of 17 before and after it add up to 3.
STEP, STEPS = 17, 3
REACHES = [(i, STEPS - i) for i in range(STEPS + 1)]
#: Anchors that a scan combines before it sends them on.
FLUSH = 400_000
#: Bytes of input for a bucket of anchors, bytes of context for a shard, contexts of an anchor in a bucket.
BUCKET_BYTES, SHARD_BYTES, HOT = 16 << 20, 2 << 20, 20_000
LAST = (1 << 63) - 1
FULL, ANCHORS, NEED, NEED_HOT = 0, 1, 2, 3
KEYED = "bucket int, kind int, doc_id long, sig long, payload binary"
#: An anchor, with the text it is in and how far its context goes to both sides.
ANCHOR = np.dtype([("h", "u8"), ("ctx", "u8"), ("doc", "i8"), ("sig", "i8"), ("at", "i8"), ("left", "u1"), ("right", "u1"), *((f"k{i}", "u2") for i, _ in REACHES)])


def _pack(x: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)


def _unpack(raw: bytes, dtype: np.dtype = ANCHOR) -> np.ndarray:
    n = len(raw) // dtype.itemsize
    out, at = np.empty(n, dtype=dtype), 0
    for f in dtype.names:
        size = n * dtype[f].itemsize
        out[f] = np.frombuffer(raw, dtype=dtype[f], count=n, offset=at)
        at += size
    return out


def anchors(raw: list[bytes], doc: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The anchors of all texts of LENGTH bytes or more."""
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    end = np.cumsum(size)
    begin = end - size
    n = len(buf)
    if n < LENGTH:
        return np.empty(0, dtype=ANCHOR)
    sums = prefix(buf)
    start = np.arange(n - GRAM + 1)
    h = np.maximum(span_hash(sums, start, start + GRAM), U(1))
    low = sliding_min(h, LENGTH - GRAM + 1)  # of each window, by its start
    valid = np.zeros(n + 1, dtype=np.int8)
    long = size >= LENGTH
    valid[begin[long]] += 1
    valid[end[long] - LENGTH + 1] -= 1
    low[np.cumsum(valid[: len(low)]) == 0] = 0
    pad = np.full(LENGTH - GRAM, U((1 << 64) - 1))
    high = ~sliding_min(np.concatenate((pad, ~low, pad)), LENGTH - GRAM + 1)  # largest minimum of the windows around a gram
    at = np.flatnonzero(high[: len(h)] == h)
    text = np.searchsorted(end, at, side="right")
    out = np.empty(len(at), dtype=ANCHOR)
    left, right = np.minimum(LENGTH - GRAM, at - begin[text]), np.minimum(LENGTH, end[text] - at)
    out["h"], out["doc"], out["sig"], out["at"], out["left"], out["right"] = h[at], doc[text], sig[text], at - begin[text], left, right
    out["ctx"] = mix(span_hash(sums, at - left, at + right) + left.astype(U))
    for i, j in REACHES:  # 0: the text is too short for this reach
        there = (left >= STEP * i) & (right >= GRAM + STEP * j)
        out[f"k{i}"] = 0
        out[f"k{i}"][there] = np.maximum(span_hash(sums, at[there] - STEP * i, at[there] + GRAM + STEP * j) >> U(48), U(1))
    return out


def needed(x: np.ndarray) -> np.ndarray:
    """Of x (first places of anchors) those that may share a window with another context, cut to what it can cover."""
    least, most = np.full(len(x), STEPS + 1), np.full(len(x), -1)
    for i, _ in REACHES:
        own = np.flatnonzero(x[f"k{i}"])
        #: Places of one context hold nothing new, so what counts is whether a reach has several contexts.
        order = own[np.lexsort((x["ctx"][own], x[f"k{i}"][own], x["h"][own]))]
        y = x[order]
        edge = np.ones(len(y), dtype=bool)
        edge[1:] = (y["h"][1:] != y["h"][:-1]) | (y[f"k{i}"][1:] != y[f"k{i}"][:-1])
        run = np.cumsum(edge) - 1
        several = np.bincount(run, edge | np.concatenate(([True], y["ctx"][1:] != y["ctx"][:-1])), run[-1] + 1)[run] > 1 if len(y) else edge
        shared = order[several]
        least[shared], most[shared] = np.minimum(least[shared], i), np.maximum(most[shared], i)
    out = x[most >= 0]
    least, most = least[most >= 0], most[most >= 0]
    out["left"] = np.minimum(out["left"], np.where(most < STEPS, STEP * (most + 1), LENGTH))
    out["right"] = np.minimum(out["right"], np.where(least > 0, GRAM + STEP * (STEPS - least + 1), LENGTH))
    return out


def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x sorted by hash, context and place, and whether each is in its context's first place."""
    x = x[np.lexsort((x["at"], x["doc"], x["ctx"], x["h"]))]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["ctx"][1:] != x["ctx"][:-1])
    #: The hashes of reaches tell contexts apart once more; where they differ, the suffix array decides.
    for i, _ in REACHES:
        new[1:] |= x[f"k{i}"][1:] != x[f"k{i}"][:-1]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else np.empty(0, dtype=np.int64)
    return x, (x["doc"] == x["doc"][lead]) & (x["at"] == x["at"][lead])


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Disjoint stretches (pairs of begin and end) that cover the same bytes; lo is ascending."""
    if not len(lo):
        return np.empty((0, 2), dtype=np.int64)
    far = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.concatenate(([True], lo[1:] > far[:-1])))
    return np.stack([lo[new], far[np.concatenate((new[1:] - 1, [len(lo) - 1]))]], axis=1)


def _by_text(doc: np.ndarray, sig: np.ndarray, *others: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    if not len(doc):
        return
    order = np.lexsort((*others[:1], sig, doc))
    doc, sig, others = doc[order], sig[order], [o[order] for o in others]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]))))
    for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
        yield int(doc[a]), int(sig[a]), [o[a:b] for o in others]


def _spans(doc: np.ndarray, sig: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple]:
    for d, s, (a, b) in _by_text(doc, sig, lo, hi):
        yield -1, FULL, d, s, merged(a, b).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "kind", "doc_id", "sig", "payload"])


def _dealt(x: np.ndarray, n_buckets: int) -> Iterator[tuple]:
    """Rows of one flush: first places by bucket, and what the others cover, by text."""
    x, first = firsts(x)
    again = x[~first]
    bucket_of = lambda h: (h % U(n_buckets)).astype(np.int32)
    for row in _spans(again["doc"], again["sig"], again["at"] - again["left"], again["at"] + again["right"]):
        yield (int(bucket_of(np.array([row[2]]).astype(U))[0]), *row[1:])
    x = x[first]
    bucket = bucket_of(x["h"])
    order = np.lexsort((x["at"], x["doc"], bucket))
    x, bucket = x[order], bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(x) else []
    for a, b in zip(cut, [*cut[1:], len(x)], strict=True):
        yield int(bucket[a]), ANCHORS, None, None, _pack(x[a:b])


def _longs(col: pa.Array) -> np.ndarray:
    return col.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def scan(docs: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part, raw in chunks(batches, "text"):
            held.append(anchors(raw, _longs(part.column("doc_id")), _longs(part.column("sig"))))
            n += len(held[-1])
            if n >= FLUSH:
                yield _batch(list(_dealt(np.concatenate(held), n_buckets)))
                held, n = [], 0
        if n:
            yield _batch(list(_dealt(np.concatenate(held), n_buckets)))

    return docs.mapInArrow(run, KEYED)


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: row[key])


def settle(keyed: DataFrame, n_buckets: int) -> DataFrame:
    """Of each bucket the repeated stretches, and the first places of anchors with several contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            out, held = [], []
            for row in rows:
                if row["kind"] == ANCHORS:
                    held.append(_unpack(row["payload"]))
                else:
                    out.append((-1, row["kind"], row["doc_id"], row["sig"], row["payload"]))
            if held:
                x, first = firsts(np.concatenate(held))
                again, x = x[~first], x[first]
                out += _spans(again["doc"], again["sig"], again["at"] - again["left"], again["at"] + again["right"])
                x = needed(x)
                contexts = np.bincount(np.cumsum(np.concatenate(([0], x["h"][1:] != x["h"][:-1]))))
                contexts = np.repeat(contexts, contexts) if len(x) else np.empty(0)
                for kind, some in ((NEED, contexts <= HOT), (NEED_HOT, contexts > HOT)):
                    y = x[some]
                    for d, s, (at, h, left, right) in _by_text(y["doc"], y["sig"], y["at"], y["h"], y["left"], y["right"]):
                        out.append((-1, kind, d, s, _pack(np.rec.fromarrays([h, at, left, right], dtype=PLACE))))
            for k in range(0, len(out), 20_000):
                yield _batch(out[k : k + 20_000])

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, KEYED)


PLACE = np.dtype([("h", "u8"), ("at", "i8"), ("left", "u1"), ("right", "u1")])
CONTEXT = np.dtype([("doc", "i8"), ("sig", "i8"), ("at", "i8"), ("size", "i4")])


def contexts(asked: DataFrame, n_shards: int, n_buckets: int) -> DataFrame:
    """Packed contexts by shard, and hashed windows of anchors with very many contexts by bucket. asked: docs with needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            rows, hot = {}, []
            doc, sig = _longs(part.column("doc_id")), _longs(part.column("sig"))
            for t, needs in enumerate(part.column("needs").to_pylist()):
                for need in needs:
                    x = _unpack(need["payload"], PLACE)
                    begin, end = x["at"] - x["left"], x["at"] + x["right"]
                    if need["kind"] == NEED_HOT:
                        hot += _windows(raw[t], doc[t], sig[t], begin, end)
                        continue
                    for shard, a, b in zip((x["h"] % U(n_shards)).tolist(), begin.tolist(), end.tolist(), strict=True):
                        rows.setdefault(shard, []).append((doc[t], sig[t], a, raw[t][a:b]))
            out = [(s, NEED, None, None, _pack(np.array([(d, g, a, len(c)) for d, g, a, c in own], dtype=CONTEXT)) + b"".join(c for *_, c in own) + len(own).to_bytes(4, "little")) for s, own in rows.items()]
            if hot:
                out += [(b, k, d, g, p) for b, k, d, g, p in _dealt(np.concatenate(hot), n_buckets)]
            yield _batch(out)

    return asked.mapInArrow(run, KEYED)


def _windows(raw: bytes, doc: int, sig: int, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    sums, out = prefix(np.frombuffer(raw, dtype=np.uint8)), []
    order = np.argsort(begin, kind="stable")  # contexts are cut to the left one by one, so the order of anchors is not theirs
    for lo, hi in merged(begin[order], end[order] - LENGTH + 1).tolist():
        at = np.arange(lo, hi)
        x = np.empty(len(at), dtype=ANCHOR)
        half = LENGTH // 2
        x["h"] = span_hash(sums, at, at + LENGTH)
        x["ctx"] = mix(span_hash(sums, at, at + half) * U(3) + span_hash(sums, at + half, at + LENGTH))
        x["doc"], x["sig"], x["at"], x["left"], x["right"] = doc, sig, at, 0, LENGTH
        for i, _ in REACHES:
            x[f"k{i}"] = 0
        out.append(x)
    return out


def repeated_windows(where: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Rows (context number, offset) of windows that also start earlier, by the suffix array of all contexts."""
    size = where["size"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    s = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8).astype(np.int64) + 2
    s[begin[1:] - 1] = 1  # ends of contexts; no text in UTF-8 has the byte 255
    s = np.concatenate((s, [0]))
    sa = suffix_array(s, int(s.max()) + 1)
    lcp = permuted_lcp(s, sa)
    context = np.searchsorted(begin, sa, side="right") - 1
    keep = context < len(size)
    sa, context = sa[keep], context[keep]
    keep = begin[context + 1] - 1 - sa >= LENGTH
    sa, context = sa[keep], context[keep]
    if not len(sa):
        return np.empty((0, 2), dtype=np.int64)
    group = np.cumsum(np.concatenate(([0], lcp[sa[1:]] < LENGTH)))
    at = where["at"][context] + sa - begin[context]
    order = np.lexsort((at, where["doc"][context], group))
    lead = order[np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0)))][group]
    again = (where["doc"][context] != where["doc"][context][lead]) | (at != at[lead])
    return np.stack([context[again], (sa - begin[context])[again]], axis=1)


def sort_shards(keyed: DataFrame) -> DataFrame:
    """The stretches of contexts that the shard's suffix array shows to be repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            where, texts = [], []
            for row in rows:
                n = int.from_bytes(row["payload"][-4:], "little")
                own = _unpack(row["payload"][: n * CONTEXT.itemsize], CONTEXT)
                at = n * CONTEXT.itemsize + np.concatenate(([0], np.cumsum(own["size"])))
                where.append(own)
                texts += [row["payload"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            where = np.concatenate(where)
            found = repeated_windows(where, texts)
            own, lo = where[found[:, 0]], where["at"][found[:, 0]] + found[:, 1]
            yield _batch(list(_spans(own["doc"], own["sig"], lo, lo + LENGTH)))

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, KEYED)


def cut(docs: DataFrame) -> DataFrame:
    """What stays of docs (doc_id, text, spans), as text bytes and figures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            kept, removed, runs = [], [], []
            for text, parts in zip(raw, part.column("spans").to_pylist(), strict=True):
                x = np.concatenate([np.frombuffer(p, dtype=np.int64).reshape(-1, 2) for p in parts]) if parts else np.empty((0, 2), dtype=np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                x = merged(x[:, 0], x[:, 1])
                edges = [0, *x.ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(int((x[:, 1] - x[:, 0]).sum()))
                runs.append(len(x))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of docs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("sig"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(16, size // BUCKET_BYTES)
    found = staged(settle(scan(rows, n_buckets), n_buckets), "anchors")
    needs = found.filter(F.col("kind").isin(NEED, NEED_HOT))
    asked_bytes = needs.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0] // PLACE.itemsize * 2 * LENGTH
    n_shards = max(1, asked_bytes // SHARD_BYTES)
    text_key = [F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.col("sig").alias("_sig")]
    asked = needs.groupBy(*text_key).agg(F.collect_list(F.struct("kind", "payload")).alias("needs"))
    same = (F.coalesce("doc_id", F.lit(LAST)) == F.col("_doc")) & (F.col("sig") == F.col("_sig"))
    #: A row that comes twice gives its contexts twice, which changes nothing.
    dealt = staged(contexts(rows.join(asked, same).select("doc_id", "sig", "text", "needs"), n_shards, n_buckets), "contexts")
    spans = found.filter(F.col("kind") == FULL).union(sort_shards(dealt.filter(F.col("kind") == NEED))).union(settle(dealt.filter(F.col("kind") != NEED), n_buckets).filter(F.col("kind") == FULL))
    spans = spans.groupBy(*text_key).agg(F.collect_list("payload").alias("spans"))
    return cut(rows.join(spans, same, "left").select("doc_id", "text", "spans"))
