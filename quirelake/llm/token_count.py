"""Token counts of whole texts under a public tokenizer, as lengths only.

An Arrow function reads record batches, regroups texts into batches balanced by bytes, and returns
the number of tokens of each text; ids never leave the function. A sentencepiece model is counted by
units: no piece has a word mark after another character or holds a line feed, so a text may be split
before a run of spaces and before a line feed without changing the pieces. Each distinct unit is encoded
once and the lengths of short ones are kept in a bounded table. A unit of over LONG_UNIT characters is
split further, between two characters that no piece has next to each other; only one without such a
place is encoded in one call. With a tokenizers file, texts of over LONG_TEXT characters are split
before single spaces that follow another character. Each kind of split is checked once for a model, on
texts made for it; a model that fails is counted without that split.

Cases: a null text counts as empty and has 0 tokens; special strings in a text are plain text; repeated
rows each get a row; empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import chunks

#: Entries of a worker's table of unit lengths, which starts anew when full, and characters of a unit that is kept.
KEPT_UNITS, KEPT_CHARS = 400_000, 64
#: Characters of a unit that is split further, and of a text that a tokenizers file gets in parts.
LONG_UNIT, LONG_TEXT = 20_000, 100_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Lengths under a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        same = "  a  éﬁ①\n\n\tb "
        self.splits = all("▁" not in p.lstrip("▁") and "\n" not in p for p in plain) and self.model.decode(self.model.encode(same)) == same
        #: A word mark is put before a text, and a line feed is a token of its own: units count on both.
        self.splits = self.splits and len(self.model.encode("\n")) == 2 and self._adds_up("a b\nc   d\n\n  ﬁ ①② \n e  ")
        self.within = {p[k : k + 2] for p in plain for k in range(len(p) - 1)}
        self.splits_within = self.splits and self._inner_adds_up()
        self.kept: dict[str, int] = {"▁": 1}

    def _adds_up(self, text: str) -> bool:
        return len(self.model.encode(text)) == sum(1 if u == "▁" else len(self.model.encode(u)) - (u[0] == "\n") for u in self._units(text))

    def _inner_adds_up(self) -> bool:
        """Whether parts cut where no piece has the two characters add up to the whole, on runs of unlike characters."""
        for text in ("qzxjvkqqwxzj" * 9, "语文ж字éя数ß한글" * 9, "a1b2#$%xq^&Zz" * 9):
            parts = self._parts(text, 10)
            if len(self.model.encode(text)) != sum(self._inner(p, k) for k, p in enumerate(parts)):
                return False
        return True

    def _parts(self, unit: str, size: int) -> list[str]:
        """unit in parts of size characters or more, cut where no piece has the characters on both sides."""
        parts, at, k = [], 0, size
        while k < len(unit):
            pair = unit[k - 1 : k + 1]
            if pair.isalnum() and pair not in self.within and " " not in pair:
                parts.append(unit[at:k])
                at, k = k, k + size
            else:
                k += 1
        return [*parts, unit[at:]]

    def _inner(self, part: str, k: int) -> int:
        """Tokens of a unit's k-th part; later ones are encoded behind a line feed, in place of the word mark."""
        return len(self.model.encode("\n" + part)) - 2 if k else len(self.model.encode(part))

    def _length(self, unit: str) -> int:
        parts = self._parts(unit, LONG_UNIT) if self.splits_within else [unit]
        return sum(self._inner(p, k) for k, p in enumerate(parts)) - (unit[0] == "\n")

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        rows = [self._units(t) for t in texts]
        met = set().union(*rows)
        own = {u: self._length(u) for u in met if len(u) > LONG_UNIT}
        long = [u for u in met if KEPT_CHARS < len(u) <= LONG_UNIT]
        own |= {u: len(ids) - (u[0] == "\n") for u, ids in zip(long, self.model.encode(long, num_threads=1), strict=True)}
        met = {u for u in met if len(u) <= KEPT_CHARS}
        new = list(met - self.kept.keys())
        if len(self.kept) + len(new) > KEPT_UNITS:
            self.kept = {"▁": 1}
            new = list(met - self.kept.keys())
        #: A unit after a line feed is encoded with the feed before it; the word mark that is put first is taken off.
        for u, ids in zip(new, self.model.encode(new, num_threads=1), strict=True):
            self.kept[u] = len(ids) - (u[0] == "\n")
        if own:
            return [sum(own[u] if len(u) > KEPT_CHARS else self.kept[u] for u in row) for row in rows]
        get = self.kept.__getitem__
        return [sum(map(get, row)) for row in rows]

    @staticmethod
    def _units(text: str) -> list[str]:
        """Units whose lengths add up: the encoder puts a word mark before each, which stands for its first space."""
        if not text:
            return []
        text = text.replace("▁", " ")  # the model takes this mark for a space
        units: list[str] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                words[0] = "\n" + words[0]
            units += words
        if "" not in units:
            return units
        out, run = [], 0  # runs of spaces stay with the word after them, or alone before a line feed
        for u in [*units, None]:
            if u == "":
                run += 1
            elif u is None or u[0] == "\n":
                out += [" " * (run - 1) or "▁"] * (run > 0) + [u] * (u is not None)
                run = 0
            else:
                out.append(" " * run + u)
                run = 0
        return out


class FileCounter:
    """Lengths under a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        sample = " one two, three's 4567 été語 <x> " * 3 + "don't  stop\n\n now!! \t end "
        self.splits = sum(self._lengths(self._parts(sample, 1))) == self._lengths([sample])[0]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def _parts(text: str, size: int) -> list[str]:
        """text in parts of size characters or more, cut before a space that is alone."""
        parts, at = [], 0
        for m in re.finditer(r"(?<=\S) (?=\S)", text):
            if m.start() - at >= size:
                parts.append(text[at : m.start()])
                at = m.start()
        return [*parts, text[at:]]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return self._lengths(texts)
        parts = [self._parts(t, LONG_TEXT) if len(t) > LONG_TEXT else [t] for t in texts]
        n = iter(self._lengths([p for row in parts for p in row]))
        return [sum(next(n) for _ in row) for row in parts]


_counters: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    if path not in _counters:
        _counters[path] = FileCounter(path) if path.endswith(".json") else PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(model_path)
        for part, raw in chunks(batches, "text"):
            n = np.array(lengths([r.decode("utf-8") for r in raw]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
