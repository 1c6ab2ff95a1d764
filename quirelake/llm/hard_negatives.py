"""Hard-negative mining by a two-dimensional block matrix product.

Rows are dealt to blocks and cut into chunks of dimensions; a packed chunk of a block is one row. Each
row chunk goes to every block of anchors and each anchor chunk to every block of rows (as in SUMMA): the task
that owns the tile of a pair of blocks has all chunks of both, multiplies them FAN at a time and adds up the products, for
SLICE anchors at once. The tile is reduced where it is made, so no score is shuffled: to each anchor's best rows of its own
label, and, once these are known for all of the table, to the best rows of other labels in the window
of each (anchor, positive). What the tiles leave is ranked by Spark.

Blocks hold rows of one label group (labels by hash, GROUPS of them), so rows of the anchor's label are
looked for in the tiles of its own group only; the windows need all tiles. A block is a bounded number of rows dealt by row number,
whatever label or vector is common, and fewer of them where vectors are long (CELLS numbers of a block at most). Scores are exact:
float64 products where no sum can reach 2**53, int64 ones else.

Cases: rows with a null label, a null vector or a null component take no part; the caller decides about other
components, which are longs here. Shorter vectors count as continued by zeros. Repeated rows are rows of their own, as positives, negatives and anchors;
the anchor itself is the one row that is not its positive. Ties go to the smaller vec_id, null last. A null vec_id
can be returned. A positive score below 0 has an empty window. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import staged

#: Rows and anchors of a block, numbers in it, dimensions of a chunk, label groups, chunks that are multiplied at once, and anchors whose scores are held at once.
ROWS, ANCHORS, CELLS, DIMENSIONS, GROUPS, FAN, SLICE = 16384, 1024, 1 << 22, 32, 8, 8, 256
LARGEST = np.iinfo(np.int64).max
PACKED = "block long, chunk long, grp long, row binary, vec_id binary, no_id binary, label binary, matrix binary"
META = ["row", "vec_id", "no_id", "label"]
#: What the tasks of an anchor block are told of its windows.
TOLD = ["anchor_row", "positive_row", "positive_id", "no_id", "positive_score"]


def _packed(rows: DataFrame, counts: dict[int, int], size: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """rows (row, vec_id, label, grp, vector) as packed chunks of blocks of about size rows, and each group's first and number of blocks."""
    held, at = {}, 0
    for g, n in sorted(counts.items()):
        held[g] = (at, max(1, -(-n // size)))
        at += held[g][1]
    first = F.create_map(*[F.lit(x).cast("long") for g, (a, _) in held.items() for x in (g, a)]) if held else F.lit(None)
    many = F.create_map(*[F.lit(x).cast("long") for g, (_, b) in held.items() for x in (g, b)]) if held else F.lit(None)
    if not held:
        return rows.sparkSession.createDataFrame([], PACKED), held
    block = first[F.col("grp")] + F.pmod(F.xxhash64("row"), many[F.col("grp")])
    #: Chunk 0 has every row, so that an empty vector is one of zeros.
    last = F.greatest(F.ceil(F.size("vector") / DIMENSIONS).cast("int") - 1, F.lit(0))
    cut = rows.select("row", "vec_id", "label", "grp", block.alias("block"), "vector", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    cut = cut.select("row", "vec_id", "label", "grp", "block", F.col("chunk").cast("long").alias("chunk"), F.slice("vector", F.col("chunk") * DIMENSIONS + 1, DIMENSIONS).alias("part"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        part = t.column("part").combine_chunks()
        sizes = np.diff(part.offsets.to_numpy())
        matrix = np.zeros((t.num_rows, DIMENSIONS), dtype=np.int64)
        matrix[np.arange(DIMENSIONS) < sizes[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
        ids = t.column("vec_id")
        own = {"row": t.column("row").to_numpy(), "vec_id": ids.fill_null(LARGEST).to_numpy(), "no_id": ids.is_null().to_numpy(), "label": t.column("label").to_numpy(), "matrix": matrix}
        head = {"block": t.column("block")[:1], "chunk": t.column("chunk")[:1], "grp": t.column("grp")[:1]}
        return pa.table(head | {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in own.items()})

    return staged(cut.groupBy("block", "chunk").applyInArrow(pack, PACKED), "packed"), held


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in int64, by float64 where that is exact."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(y.astype(np.float64)).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def _side(t: pa.Table, by_id: bool = False) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    """What is known of a block's rows, and their numbers by panels of FAN chunks. Chunk 0 has every row. by_id: in order of id."""
    chunks = sorted(t.select(["chunk", *META, "matrix"]).to_pylist(), key=lambda r: r["chunk"])
    own = {k: np.frombuffer(chunks[0][k], dtype=bool if k == "no_id" else np.int64) for k in META}
    order = np.lexsort((own["row"], own["vec_id"], own["no_id"])) if by_id else np.arange(len(own["row"]))
    place, panels, last = np.argsort(order), {}, chunks[-1]["chunk"]
    for r in chunks:
        at = place[np.searchsorted(own["row"], np.frombuffer(r["row"], dtype=np.int64))]
        k, first = r["chunk"] // FAN, r["chunk"] % FAN * DIMENSIONS
        if k not in panels:
            panels[k] = np.zeros((len(order), min(FAN, last + 1 - k * FAN) * DIMENSIONS), dtype=np.int64)
        panels[k][at, first : first + DIMENSIONS] = np.frombuffer(r["matrix"], dtype=np.int64).reshape(-1, DIMENSIONS)
    return {k: v[order] for k, v in own.items()}, panels


class Tile:
    """The tile of a pair of blocks: rows in order of id, anchors, and the scores of one anchor after the other."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        (self.rows, self._x), (self.anchors, self._y) = _side(rows, by_id=True), _side(anchors)
        self._first, self._held = 0, np.empty((0, 0), dtype=np.int64)

    def scores(self, j: int) -> np.ndarray:
        """Of all rows with anchor j; those of the anchors after it are made with them."""
        if not self._first <= j < self._first + len(self._held):
            self._first, some = j, slice(j, j + SLICE)
            self._held = np.zeros((len(self.anchors["row"][some]), len(self.rows["row"])), dtype=np.int64)
            for k in self._x.keys() & self._y.keys():
                x, y = self._x[k], self._y[k][some]
                wide = min(x.shape[1], y.shape[1])  # beyond that one side is zeros
                self._held += product(y[:, :wide], x[:, :wide])
        return self._held[j - self._first]

    def best(self, j: int, among: np.ndarray) -> np.ndarray:
        """Numbers of the rows among, by score of anchor j from high to low, then by id."""
        among = np.flatnonzero(among)
        return among[np.argsort(-self.scores(j)[among], kind="stable")]


def _ids(values: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=none)


POSITIVE = "anchor_row long, anchor_id long, anchors_in long, positive_row long, positive_id long, positive_score long"
NEGATIVE = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"


def _empty(kinds: str) -> pa.Table:
    return pa.schema([(x.split()[0], pa.int64()) for x in kinds.split(", ")]).empty_table()


def _positives(top: int):
    def reduce(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _empty(POSITIVE)
        tile, found = Tile(rows, anchors), []
        for j, (own, label) in enumerate(zip(tile.anchors["row"], tile.anchors["label"], strict=True)):
            best = tile.best(j, (tile.rows["label"] == label) & (tile.rows["row"] != own))[:top]
            found.append((np.full(len(best), j), best, tile.scores(j)[best]))
        j, i, scores = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
        a, r = {k: v[j] for k, v in tile.anchors.items()}, {k: v[i] for k, v in tile.rows.items()}
        block = np.full(len(i), anchors.column("anchors_in")[0].as_py(), dtype=np.int64)
        return pa.table({"anchor_row": a["row"], "anchor_id": _ids(a["vec_id"], a["no_id"]), "anchors_in": block, "positive_row": r["row"], "positive_id": _ids(r["vec_id"], r["no_id"]), "positive_score": scores})

    return reduce


def _told(t: pa.Table) -> pa.Table:
    """The windows of an anchor block as one row, beside its chunk 0."""
    t = t.sort_by("anchor_row")
    ids = t.column("positive_id")
    own = [*(t.column(k).to_numpy() for k in TOLD[:2]), ids.fill_null(LARGEST).to_numpy(), ids.is_null().to_numpy(), t.column(TOLD[4]).to_numpy()]
    return pa.table({"block": t.column("anchors_in")[:1], "chunk": pa.array([0], pa.int64()), "windows": pa.array([np.stack([x.astype(np.int64) for x in own]).tobytes()], pa.binary())})


def _negatives(top: int, low: int, high: int):
    def reduce(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        told = [w for w in anchors.column("windows").to_pylist() if w is not None]
        if not rows.num_rows or not told:
            return _empty(NEGATIVE)
        tile, made = Tile(rows, anchors), []
        at = {row: j for j, row in enumerate(tile.anchors["row"].tolist())}
        last, best, scores = None, None, None
        windows = np.frombuffer(told[0], dtype=np.int64).reshape(len(TOLD), -1)
        for n, (anchor, score) in enumerate(zip(windows[0].tolist(), windows[4].tolist(), strict=True)):
            j = at[anchor]
            if j != last:
                last, best = j, tile.best(j, tile.rows["label"] != tile.anchors["label"][j])
                scores = -tile.scores(j)[best]
            #: low * positive <= 100 * negative <= high * positive, in whole numbers; scores ascend, being negated.
            most, least = high * score // 100, -(-low * score // 100)
            begin, end = np.searchsorted(scores, -most, side="left"), np.searchsorted(scores, -least, side="right")
            pick = best[begin : max(begin, min(end, begin + top))]
            if len(pick):
                made.append((np.full(len(pick), n), np.full(len(pick), j), pick, tile.scores(j)[pick]))
        if not made:
            return _empty(NEGATIVE)
        n, j, i, scores = (np.concatenate([m[k] for m in made]) for k in range(4))
        w, a, r = windows[:, n], {k: v[j] for k, v in tile.anchors.items()}, {k: v[i] for k, v in tile.rows.items()}
        return pa.table([pa.array(w[0]), _ids(a["vec_id"], a["no_id"]), pa.array(w[1]), _ids(w[2], w[3].astype(bool)), pa.array(w[4]), pa.array(r["row"]), _ids(r["vec_id"], r["no_id"]), pa.array(scores)], names=[x.split()[0] for x in NEGATIVE.split(", ")])

    return reduce


def _ranked(rows: DataFrame, by: list[str], score: str, name: str, n: int) -> DataFrame:
    """The first n rows of each key by score, then id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(f"{name}_id"), f"{name}_row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, vector (array of long), is_anchor. The first positives rows of the anchor's label by inner product; for each, the
    first negatives rows of other labels whose score is between low and high hundredths of the positive's.
    """
    whole = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = rows.filter(whole).select("vec_id", F.col("label").cast("long").alias("label"), "vector", "is_anchor")
    rows = staged(rows.withColumns({"row": F.monotonically_increasing_id(), "grp": F.pmod(F.xxhash64(F.col("label")), F.lit(GROUPS))}), "rows")
    counts = {r["grp"]: (r["n"], r["k"], r["d"]) for r in rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("k"), F.max(F.size("vector")).alias("d")).collect()}  # GROUPS rows at most
    longest = max((d for *_, d in counts.values()), default=0)
    bounded = lambda size: max(1, min(size, CELLS // max(longest, DIMENSIONS)))
    packed, held = _packed(rows, {g: n for g, (n, _, _) in counts.items()}, bounded(ROWS))
    marked, held_anchors = _packed(rows.filter("is_anchor"), {g: k for g, (_, k, _) in counts.items() if k}, bounded(ANCHORS))

    def spread(side: DataFrame, own: str, other: str, places: Column) -> DataFrame:
        """A block's chunks, once for each block of the other side."""
        kept = [c for c in side.columns if c not in ("block", "grp")]
        return side.select(F.col("block").alias(own), F.explode(places.cast("array<long>")).alias(other), *kept).groupBy("rows_in", "anchors_in")

    def blocks(of: dict[int, tuple[int, int]]) -> Column:
        """All blocks of a side."""
        return F.sequence(F.lit(0), F.lit(max(1, sum(b for _, b in of.values())) - 1))

    def same_group(of: dict[int, tuple[int, int]]) -> Column:
        """The blocks of a row's own group."""
        out = F.array().cast("array<int>")
        for g, (a, b) in of.items():
            out = F.when(F.col("grp") == g, F.sequence(F.lit(a), F.lit(a + b - 1))).otherwise(out)
        return out

    def tiles(anchors: DataFrame, of_rows: Column, of_anchors: Column, reduce, kind: str) -> DataFrame:
        """What reduce leaves of the tile of each pair of blocks."""
        pairs = spread(packed, "rows_in", "anchors_in", of_anchors).cogroup(spread(anchors, "anchors_in", "rows_in", of_rows))
        return pairs.applyInArrow(reduce, kind)

    found = tiles(marked, same_group(held), same_group(held_anchors), _positives(positives), POSITIVE)
    best = staged(_ranked(found, ["anchor_row"], "positive_score", "positive", positives).drop("rank"), "positives")
    told = best.groupBy("anchors_in").applyInArrow(_told, "block long, chunk long, windows binary")
    mined = tiles(marked.join(told, ["block", "chunk"], "left"), blocks(held), blocks(held_anchors), _negatives(negatives, low, high), NEGATIVE)
    return _ranked(mined, ["anchor_row", "positive_row"], "negative_score", "negative", negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
