"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Training: of labelled rows, at most TRAIN_ROWS (in hashed order; a documented bound) count for each
unit (a word, or the first 4, 5 or 6 bytes of one) the toxic and the other texts that have it. The
log-odds ratio under a Dirichlet prior with the corpus rates, drawn towards zero by so many standard
errors, is the unit's score, positive or negative; units whose score is thereby zero need no entry. How
many of CERTAIN it is, FOLDS folds of the training rows tell: each fold is scored by a model of the others,
and the number with the least log loss over all folds is taken (of equal ones the larger).

Scoring: every token scores that of its unit with the highest z-score (if none is positive, the lowest),
plus DRIFT, so that text without evidence falls. A linear-time scan finds all maximal-scoring segments
of the whole text. For a segment of score S in a text of n words, P = 1 - exp(-K n exp(-lambda S)) is
the chance of one as good in harmless text; lambda solves the Karlin-Altschul equation for the scores
of all harmless training words, K matches the segments seen in them. A segment with P of at most
SIGNIFICANT is a toxic passage. The text's evidence is the sum of -ln P over its passages; a logistic
fit on the training rows maps it to a score in 0 to 1.

Words are runs of letters and digits after lower-casing A-Z. Cases: null and empty texts have no
evidence and get the lowest score; a row with a null doc_id is scored and not held out; repeated rows
each get a row; of contradicting labels of a doc_id, toxic stands. With no toxic or no other training
row every score is the share of toxic ones (0 without any). An empty table gives no rows. Only doc_id
and text are read (without_toxic returns all columns), so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U, among, chunks, joined, mix, prefix, span_hash, word_hash, word_spans
from .util import staged

TRAIN_ROWS = 20_000
#: Standard errors that a log-odds ratio may be drawn towards zero, and the folds of the training rows that choose among them.
CERTAIN, FOLDS = (2.0, 3.0, 4.0), 2
#: What every token falls by; chance of a passage in harmless text.
DRIFT, SIGNIFICANT = -0.1, 0.01
PRIOR = 100.0
#: Scores of harmless words are counted by thousandths.
GRID = 1000
PREFIXES = (4, 5, 6)
#: Lower-cases A-Z; every other ASCII byte but digits and letters separates words.
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
BLANK = np.arange(256) == 32
SEGMENT = "array<struct<first_word:int,n_words:int,weight:double,p:double>>"


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are kept apart: crc32 of the id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def units(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Unit hashes, a column for the word and for each prefix (0: none), and each text's first word."""
    buf, at = joined([r.translate(TABLE) for r in raw])
    start, end, first = word_spans(buf, at, BLANK)
    sums = prefix(buf)
    cols = [word_hash(buf, sums, start, end)]
    for k in PREFIXES:
        cols.append(np.where(end - start > k, mix(span_hash(sums, start, np.minimum(start + k, end)) + U(k)), U(0)))
    return np.stack(cols, axis=1), first


def unit_counts(train: DataFrame) -> DataFrame:
    """(unit, toxic, other): training texts that have the unit."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            u, first = units(raw)
            toxic = np.array(part.column("toxic").to_pylist(), dtype=np.int64)
            text = np.repeat(np.arange(len(raw)), np.diff(first))
            pairs = np.unique(np.stack([np.repeat(text, u.shape[1]).astype(U), u.ravel()], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] != 0]
            unit, inverse = np.unique(pairs[:, 1], return_inverse=True)
            y = np.bincount(inverse, toxic[pairs[:, 0].astype(np.int64)], len(unit)).astype(np.int64)
            n = np.bincount(inverse, minlength=len(unit))
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(y), pa.array(n - y)], names=["unit", "toxic", "other"])

    rows = train.select("text", "toxic").mapInArrow(count, "unit long, toxic long, other long")
    return rows.groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


@dataclass
class Model:
    """Sorted unit hashes with their scores and z-scores, and the calibration."""

    unit: np.ndarray
    weight: np.ndarray
    z: np.ndarray
    decay: float = 1.0
    k: float = 1e-3
    slope: float = 1.0
    offset: float = 0.0

    def word_scores(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The score of every word of all texts, and each text's first word."""
        u, first = units(raw)
        score = np.full(len(u), DRIFT)
        known = among(u.ravel(), self.unit).reshape(u.shape)
        word = np.flatnonzero(known.any(axis=1))
        if len(word):
            at = np.searchsorted(self.unit, u[word].ravel()).reshape(-1, u.shape[1])
            at[~known[word]] = 0
            high = np.where(known[word], self.z[at], -np.inf)
            low = np.where(known[word], self.z[at], np.inf)
            pick = np.where(high.max(axis=1) > 0, high.argmax(axis=1), low.argmin(axis=1))
            score[word] += self.weight[at[np.arange(len(word)), pick]]
        return score, first

    def segments(self, raw: list[bytes]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Of each text its number of words, and its maximal-scoring segments (first word, words, score)."""
        score, first = self.word_scores(raw)
        return [(int(b - a), maximal(score[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]

    def chance(self, n: int, score: float) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.decay * score))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(-math.log(max(p, 1e-30)) for p in (self.chance(n, s) for *_, s in found) if p <= SIGNIFICANT)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.offset + self.slope * math.log1p(evidence)))))


def maximal(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, words, score) of a text, in linear time.

    Runs of positive words are candidates from the start. A list holds disjoint candidates with the running
    sums before and after each, and a link to the last candidate before that began lower; so a new run skips
    what began higher, is merged back to where it can gain, and if nothing began lower the list is final.
    """
    up = np.concatenate(([False], score > 0, [False]))
    begin, end = np.flatnonzero(~up[:-1] & up[1:]), np.flatnonzero(up[:-1] & ~up[1:])
    if not len(begin):
        return []
    sums = np.concatenate(([0.0], np.cumsum(score)))
    out: list[tuple[int, int, float]] = []
    low, high, first, last, link = [], [], [], [], []

    def settle() -> None:
        out.extend((f, e - f, r - w) for f, e, r, w in zip(first, last, high, low, strict=True))
        for held in (low, high, first, last, link):
            held.clear()

    for f, e, w, r in zip(begin.tolist(), end.tolist(), sums[begin].tolist(), sums[end].tolist(), strict=True):
        k = len(low) - 1
        while True:
            while k >= 0 and low[k] >= w:
                k = link[k]
            if k < 0 or high[k] >= r:
                break
            f, w = first[k], low[k]
            before = link[k]
            for held in (low, high, first, last, link):
                del held[k:]
            k = before
        if k < 0:
            settle()
        for held, x in ((low, w), (high, r), (first, f), (last, e), (link, k)):
            held.append(x)
    settle()
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labels of rows that aren't held out; labels: doc_id, toxic."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", fold), "train")
    n = {(r["fold"], r["toxic"]): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    held = [sum(k for (_, toxic), k in n.items() if toxic == x) for x in (0, 1)]
    if not all(held):
        return Model(np.zeros(0, U), np.zeros(0), np.zeros(0), slope=0.0, offset=30.0 if held[1] else -30.0)
    loss = dict.fromkeys(sorted(CERTAIN, reverse=True), 0.0)
    for k in range(FOLDS):
        if all(any(n.get((f, x)) for f in range(FOLDS) if f != k) for x in (0, 1)):
            rest = texts.filter(F.col("fold") != k)
            counts = staged(unit_counts(rest), "units")
            for certain in loss:
                loss[certain] += log_loss(fit(rest, counts, certain), texts.filter(F.col("fold") == k))
    return fit(texts, staged(unit_counts(texts), "units"), min(loss, key=loss.get))


def fit(texts: DataFrame, counts: DataFrame, certain: float) -> Model:
    """A calibrated model of training texts (text, toxic) and their unit_counts()."""
    all_toxic, all_other = counts.agg(F.sum("toxic"), F.sum("other")).first()
    prior = 0.5 + PRIOR * (F.col("toxic") + F.col("other")) / F.lit(float(all_toxic + all_other))
    a, b = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(a / (all_toxic + PRIOR - a)) - F.log(b / (all_other + PRIOR - b))
    error = F.sqrt(1 / a + 1 / b)
    scored = counts.select("unit", (F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - certain * error)).alias("weight"), (odds / error).alias("z"))
    model_rows = scored.filter("weight <> 0").toPandas()  # part of the vocabulary of TRAIN_ROWS texts
    unit = model_rows["unit"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(unit)
    model = Model(unit[order], model_rows["weight"].to_numpy(dtype=float)[order], model_rows["z"].to_numpy(dtype=float)[order])
    return calibrate(model, texts)


def log_loss(model: Model, texts: DataFrame) -> float:
    """The sum of a model's log loss over texts (text, toxic)."""

    def lost(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            p = np.array([model.score(model.evidence(n, x)) for n, x in model.segments(raw)])
            toxic = np.array(part.column("toxic").to_pylist(), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(-np.log(np.maximum(np.where(toxic, p, 1 - p), 1e-12)))], names=["loss"])

    return texts.select("text", "toxic").mapInArrow(lost, "loss double").agg(F.sum(F.round("loss", 9))).first()[0] or 0.0


def calibrate(model: Model, texts: DataFrame) -> Model:
    """Extreme-value and logistic parameters from the training rows (bounded, so held by the driver)."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            score, first = model.word_scores(raw)
            bounds = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            values, counts = zip(*(np.unique(np.rint(score[a:b] * GRID).astype(np.int64), return_counts=True) for a, b in bounds), strict=True)
            lists = [[s for *_, s in maximal(score[a:b])] for a, b in bounds]
            kinds = ((values, pa.int64()), (counts, pa.int64()), (lists, pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([b - a for a, b in bounds], pa.int64()), *(pa.array([list(x) for x in rows], pa.list_(kind)) for rows, kind in kinds)], names=["toxic", "n", "value", "times", "scores"])

    seen = staged(texts.select("text", "toxic").mapInArrow(scan, "toxic int, n long, value array<long>, times array<long>, scores array<double>"), "seen")
    words = seen.filter("toxic = 0").select(F.explode(F.arrays_zip("value", "times")).alias("x")).groupBy("x.value").agg(F.sum("x.times").alias("n")).toPandas()
    rows = seen.select("toxic", "n", "scores").collect()
    model.decay = decay(words["value"].to_numpy(dtype=float) / GRID, words["n"].to_numpy(dtype=float))
    harmless = [r for r in rows if not r["toxic"]]
    found = sorted(s for r in harmless for s in r["scores"])
    middle = found[len(found) // 2] if found else 1.0
    model.k = min(1.0, (len(found) / 2 + 0.5) / (sum(max(r["n"], 1) for r in harmless) * math.exp(-model.decay * middle)))
    x = np.array([math.log1p(model.evidence(r["n"], [(0, 0, s) for s in r["scores"]])) for r in rows])
    y = np.array([r["toxic"] for r in rows], dtype=float)
    model.offset, model.slope = logistic(x, y)
    return model


def decay(score: np.ndarray, n: np.ndarray) -> float:
    """The positive lambda with sum(n * exp(lambda * score)) = sum(n), for scores whose mean is negative."""
    low, high = 1e-3, 20.0
    share = n / max(n.sum(), 1.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(np.minimum(mid * score, 700.0))).sum() > 1 else (mid, high)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope (at least 0) by Newton's method with a small penalty on the slope."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w = np.array([base, 0.0])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - np.array([0.0, ridge * w[1]])
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-6, ridge])
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[1] > 0 else (base, 0.0)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the significant passages of every row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            found = model.segments(raw)
            score = [model.score(model.evidence(n, x)) for n, x in found]
            parts = [[{"first_word": f, "n_words": w, "weight": s, "p": p} for f, w, s in x if (p := model.chance(n, s)) <= SIGNIFICANT] for n, x in found]
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("weight", pa.float64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array(parts, kind)], names=["doc_id", "score", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, passages {SEGMENT}")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (score of threshold or more) and passages of every row of docs."""
    out = passages(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that are predicted toxic; judged by text, so every row is, whatever its doc_id."""
    model = train(docs, labels)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in chunks(batches, "text"):
            good = [model.score(model.evidence(n, x)) < threshold for n, x in model.segments(raw)]
            yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
