"""Byte-level BPE by a file of ranks: texts to ids and ids to bytes.

A pattern splits each text into pieces, and every distinct piece of a batch is encoded once. A piece that
is itself in the vocabulary is that token. The others go by length into buckets, each a padded matrix of
token ids with one row a piece: in every round each row merges its leftmost pair of least rank, the pairs
beside the merged one are looked up in a hash table of pairs, and rows without a pair left are taken out,
so that the matrix becomes smaller. The ids of short pieces are kept in a bounded table of the worker.

Pieces of over LONG bytes are first cut between two bytes that no token has next to each other: no merge
crosses such a place. A part that is still longer is a matrix of one row, in which one round merges all
places of the least pair up to the first one whose merge makes a pair of lower rank (the order in which
single merges would take them), so that rounds are as many as different merges, not as many as bytes.

ids are unsigned 32-bit little-endian integers in one binary value a text, as tables of token ids keep them.

Cases: a null text counts as empty and gives no ids; null ids decode to no bytes; strings that look like special tokens
are plain text; repeated rows each get a row; empty tables give no rows. All other columns are kept; encode()
raises if docs has a column of the name it adds, as does decode(), and an id that is not in the vocabulary stops decode().
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .kernels import U, chunks, mix

#: Entries of a worker's table of pieces, which starts anew when full, and characters of a piece that is kept.
KEPT_PIECES, KEPT_CHARS = 600_000, 64
#: Bytes of a piece that is cut, cells of one matrix, and pieces of a text that are held at a time.
LONG, CELLS, HELD = 256, 1 << 19, 200_000
NONE = np.int32(2**31 - 1)
PAD = np.int32(-1)


def _is_text(token: bytes) -> bool:
    try:
        return token.decode() is not None
    except UnicodeDecodeError:
        return False


class PairTable:
    """Rank of the token that two tokens make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        left, right = np.array(list(pairs), dtype=np.int64).reshape(-1, 2).T
        keys, values = self._key(left, right), np.array(list(pairs.values()), dtype=np.int32)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NONE, dtype=np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            slot, first = np.unique(at[todo], return_index=True)
            own = todo[first[self.keys[slot] == -1]]
            self.keys[at[own]], self.values[at[own]] = keys[own], values[own]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << np.int64(32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(U)) >> U(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where two tokens make none or one is PAD."""
        keys = self._key(left, right).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -1
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1) & (keys != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            same = found == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (found != -1)]
        out[keys == -1] = NONE
        return out.reshape(left.shape)


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get = self.ranks.get
        splits = ((get(t[:k]), get(t[k:]), r) for t, r in self.ranks.items() for k in range(1, len(t)))
        self.pairs = PairTable({(a, b): r for a, b, r in splits if a is not None and b is not None})
        #: Whether some token has the two bytes next to each other.
        self.beside = np.zeros((256, 256), dtype=bool)
        tokens = sorted(self.ranks, key=self.ranks.get)
        every = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        sizes = np.array([len(t) for t in tokens])
        inside = np.ones(len(every), dtype=bool)
        inside[np.cumsum(sizes) - 1] = False
        self.beside[every[:-1][inside[:-1]], every[1:][inside[:-1]]] = True
        #: For decoding: bytes of all tokens, and where those of an id stand.
        self.bytes, most = every, max(self.ranks.values()) + 1
        self.start, self.size = np.zeros(most, dtype=np.int64), np.full(most, -1, dtype=np.int64)
        ids = np.array([self.ranks[t] for t in tokens])
        self.start[ids], self.size[ids] = np.cumsum(sizes) - sizes, sizes
        #: Pieces that are tokens, and what is kept of others.
        self.whole = {t.decode(): r.to_bytes(4, "little") for t, r in self.ranks.items() if _is_text(t)}
        self.kept: dict[str, bytes] = {}

    # ---- merging

    def _bucket(self, pieces: list[bytes]) -> list[bytes]:
        """ids of pieces of about one length."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        tokens = np.full((len(pieces), sizes.max()), PAD, dtype=np.int32)
        tokens[np.arange(tokens.shape[1]) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks, place = self.pairs(tokens[:, :-1], tokens[:, 1:]), np.arange(len(pieces))
        while len(place):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(place), dtype=np.int64)
            least = ranks[np.arange(len(place)), at] if ranks.shape[1] else np.full(len(place), NONE)
            done, go = least == NONE, least != NONE
            if done.any():
                n, rows = sizes[done], tokens[done]
                ids, end = rows[np.arange(rows.shape[1]) < n[:, None]].astype("<u4").tobytes(), 4 * np.cumsum(n)
                for k, i, j in zip(place[done].tolist(), (end - 4 * n).tolist(), end.tolist(), strict=True):
                    out[k] = ids[i:j]
            place, at, least, sizes = place[go], at[go], least[go], sizes[go] - 1
            if not len(place):
                break
            #: Compaction: rows that go on, as wide as the widest of them, with all behind the merged pair one place to the left.
            wide = int(sizes.max())
            i, old, was = np.arange(len(place)), tokens[go], ranks[go]
            behind = np.arange(wide) > at[:, None]
            tokens = np.where(behind, old[:, 1 : wide + 1], old[:, :wide])
            tokens[i, at] = least
            ranks = np.where(behind[:, : wide - 1], was[:, 1:wide], was[:, : wide - 1])
            if wide > 1:
                left, right = i[at > 0], i[at < wide - 1]
                ranks[left, at[left] - 1] = self.pairs(tokens[left, at[left] - 1], tokens[left, at[left]])
                ranks[right, at[right]] = self.pairs(tokens[right, at[right]], tokens[right, at[right] + 1])
        return out

    def _long_row(self, piece: bytes) -> bytes:
        """One row, all places of its least pair in a round as far as single merges would take them in that order."""
        row = self.single[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.pairs(row[:-1], row[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            if len(at) > 1:  # of places that overlap, every other one in a run
                begins = np.concatenate(([True], np.diff(at) > 1))
                first = at[begins][np.cumsum(begins) - 1]
                at = at[(at - first) % 2 == 0]
            before = np.where(at > 0, row[at - 1], PAD)
            merged_before = np.concatenate(([False], at[1:] - at[:-1] == 2))
            after = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], PAD)
            new = np.full(len(at), least, dtype=np.int32)
            made = np.minimum(self.pairs(np.where(merged_before, least, before).astype(np.int32), new), self.pairs(new, after.astype(np.int32)))
            lower = np.flatnonzero(made < least)
            if len(lower):
                at = at[: lower[0] + 1]
            row = row.copy()
            row[at] = least
            keep = np.ones(len(row), dtype=bool)
            keep[at + 1] = False
            row, ranks = row[keep], np.append(ranks, NONE)[keep][:-1]
            at = at - np.arange(len(at))
            near = np.concatenate((at[at > 0] - 1, at[at < len(row) - 1]))
            ranks[near] = self.pairs(row[near], row[near + 1])
        return row.astype("<u4").tobytes()

    def _parts(self, piece: bytes) -> list[bytes]:
        """piece, cut where no token has the bytes on both sides."""
        b = np.frombuffer(piece, dtype=np.uint8)
        cuts = np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """ids of each piece."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        sizes, out, low = sizes[order], [b""] * len(pieces), 0
        while low < len(order):
            if sizes[low] > LONG:
                k, low = order[low], low + 1
                parts = self._parts(pieces[k])
                long = {p: self._long_row(p) for p in set(parts) if len(p) > LONG}
                short = list(set(parts) - long.keys())
                ids = long | dict(zip(short, self.merged(short), strict=True))
                out[k] = b"".join(ids[p] for p in parts)
                continue
            width = max(2, 1 << int(sizes[low] - 1).bit_length())
            high = min(int(np.searchsorted(sizes, width, side="right")), low + max(1, CELLS // width))
            where = order[low:high].tolist()
            for k, ids in zip(where, self._bucket([pieces[k] for k in where]), strict=True):
                out[k] = ids
            low = high
        return out

    # ---- texts

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= HELD:
            yield self.find.findall(text)
            return
        found = (m.group() for m in self.find.finditer(text))
        while part := list(islice(found, HELD)):
            yield part

    def _learn(self, met: set[str]) -> dict[str, bytes]:
        """A table that has every piece of met."""
        new = list(met - self.kept.keys())
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept, new = {}, list(met)
        whole, rest, other = self.whole, [], []
        for p in new:
            if p in whole:
                self.kept[p] = whole[p]
            else:
                rest.append(p)
                other.append(p.encode())
        ids = dict(zip(rest, self.merged(other), strict=True))
        long = {p: x for p, x in ids.items() if len(p) > KEPT_CHARS}
        for p in long:
            del ids[p]
        self.kept |= ids
        return _Both(long, self.kept) if long else self.kept

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= HELD]
        rows = [self.find.findall(texts[k]) for k in short]
        get = self._learn(set().union(*rows)).__getitem__
        for k, row in zip(short, rows, strict=True):
            out[k] = b"".join(map(get, row))
        for k in set(range(len(texts))) - set(short):
            out[k] = b"".join(b"".join(map(self._learn(set(part)).__getitem__, part)) for part in self._pieces(texts[k]))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids."""
        x = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(x):
            return b""
        if x.max() >= len(self.size) or (self.size[x] < 0).any():
            raise ValueError("an id is not in the vocabulary")
        size = self.size[x]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.start[x] - (end - size), size) + np.arange(end[-1])].tobytes()


class _Both(dict):
    """The first table, and for what it lacks the second."""

    def __init__(self, first: dict[str, bytes], second: dict[str, bytes]):
        super().__init__(first)
        self.second = second

    def __missing__(self, piece: str) -> bytes:
        return self.second[piece]


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The worker's one copy of a vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def _mapped(df: DataFrame, column: str, new: str, make) -> DataFrame:
    """df with a binary column more: make(raw values) of each slice of the batches."""
    if new in df.columns:
        raise ValueError(f"there is a column {new} already")
    schema = StructType([*df.schema.fields, StructField(new, BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, column):
            yield part.append_column(new, pa.array(make(raw), pa.binary()))

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of column text as one binary value a row."""
    return _mapped(docs, text, ids, lambda raw: loaded(path, pattern).encode([r.decode() for r in raw]))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the bytes that column ids stands for."""
    return _mapped(docs, ids, decoded, lambda raw: [loaded(path, pattern).decode(r) for r in raw])
