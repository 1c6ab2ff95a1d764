"""Keyword, vector and hybrid retrieval over a kept index of passages(id, item, text) and vectors(id, vector)."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import accent_key, let, tokens
from ..functions.vectors import codes, cosines, distances, matrix
from .components import shared_dir, staged

K1, B = 1.5, 0.75
#: A term in this share of the passages or more is dropped from a query, where there are PRUNE_FROM passages.
HIGH_DF, PRUNE_FROM, MOST_VARIANTS = 0.3, 100, 24
RRF_K, POOL_FACTOR, CODE_POOL, LEAST_POOL = 60, 3, 16, 500
#: Queries that one scan answers, queries by which the pool is measured, and the share of neighbours it has to hold.
QUERY_BLOCK, MEASURED, RECALL = 1024, 64, 0.97
#: Queries of a block whose scores of a batch of rows are held at once.
QUERY_SLICE = 64
#: Counts changes of what an index holds; one kept under another number is not read.
FORMAT = 2
#: Folders that the postings are dealt to by term.
PARTS = 64
#: Candidates that are sought by their ids in the scan; more are joined.
FEW = 5_000


def counted(passages: DataFrame) -> DataFrame:
    """(id, length, terms) of every passage, terms being its distinct ones as (term, tf). They are counted within the row: sorted words
    are cut where one differs from the word before it, so no word of a text is a row before it is counted."""

    def runs(t: Column) -> Column:
        starts = F.array_compact(F.transform(t, lambda x, k: F.when((k == 0) | (x != F.get(t, k - 1)), k)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - at).cast("long").alias("tf"))))

    own = let(F.sort_array(tokens(F.col("text"))), lambda t: F.struct(F.size(t).alias("length"), runs(t).alias("terms")))
    return passages.select("id", own.alias("c")).select("id", "c.length", "c.terms")


def spread(counts: DataFrame) -> DataFrame:
    """(id, length, term, tf) of counted passages; passages of one id and length count as one, and are only gathered if there are any."""
    rows = counts.select("id", "length", F.inline("terms"))
    if counts.groupBy("id", "length").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows
    return rows.groupBy("id", "length", "term").agg(F.sum("tf").alias("tf"))


def postings(passages: DataFrame) -> DataFrame:
    """(id, length, term, tf) of every passage with a term."""
    return spread(staged(counted(passages), "counted"))


@dataclass(frozen=True)
class Index:
    """Tables under one path: lengths(id, length), postings by term, terms with their frequencies, and, with vectors,
    vectors(id, vector, code), mean and pool. They are written once; a refresh writes a new path."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def facts(self) -> tuple[int, float]:
        """Number of passages and their average length."""
        row = self.read("facts").first()
        return row["n"], row["avgdl"] or 1.0


def _part(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _write_terms(spark: SparkSession, path: str) -> None:
    index = Index(spark, path)
    by_term = index.read("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    by_term.withColumn("folded", accent_key(F.col("term"))).write.parquet(f"{path}/terms")
    index.read("lengths").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).write.parquet(f"{path}/facts")


def _write_postings(post: DataFrame, path: str) -> None:
    """By term's folder, sorted, so that a query reads a few row groups; rebalancing splits the folder of a common term."""
    post.withColumn("part", _part()).hint("rebalance", "part").sortWithinPartitions("part", "term", "id").write.partitionBy("part").parquet(f"{path}/postings")


def build(passages: DataFrame, path: str, vectors: DataFrame | None = None) -> Index:
    """Index passages and vectors under a path that must not exist."""
    write_from(staged(counted(passages), "counted"), path)
    if vectors is not None:
        _write_vectors(vectors, path)
    return Index(passages.sparkSession, path)


def write_from(counts: DataFrame, path: str) -> None:
    """The tables of a keyword index under path, from counted passages that are kept."""
    _write_postings(spread(counts), path)
    counts.select("id", "length").write.parquet(f"{path}/lengths")
    _write_terms(counts.sparkSession, path)


def build_vectors(vectors: DataFrame, path: str) -> Index:
    """An index of vectors alone."""
    _write_vectors(vectors, path)
    return Index(vectors.sparkSession, path)


def counts(index: Index, sources: DataFrame) -> DataFrame:
    """One row: passages, vectors, and from sources(id, item, source) how many passages and items each source gave."""
    n = index.facts()[0]
    return sources.groupBy("source").agg(F.count("*").alias("passages"), F.count_distinct("item").alias("items")).withColumns({"documents": F.lit(n), "vectors": F.lit(index.read("pool").first()["n"])})


def refresh(index: Index, path: str, changed: DataFrame, gone: DataFrame) -> Index:
    """A new index under path with the changed passages replaced whole and the gone ids left out; vectors stay as they are."""
    out = staged(changed.select("id").union(gone.select("id")).distinct(), "out")
    new = staged(counted(changed.join(gone.select("id"), "id", "left_anti")), "counted")
    index.read("lengths").join(out, "id", "left_anti").unionByName(new.select("id", "length")).write.parquet(f"{path}/lengths")
    _write_postings(index.read("postings").drop("part").join(out, "id", "left_anti").unionByName(spread(new)), path)
    _write_terms(index.spark, path)
    return Index(index.spark, path)


def files_state(spark: SparkSession, files: list[str]) -> str:
    """A digest of the files' places, sizes and times, from listings of their folders; no file is read."""
    folders: dict[str, set[str]] = {}
    for f in files:
        folder, _, name = f.rpartition("/")
        folders.setdefault(folder, set()).add(unquote(name))
    out = hashlib.sha256()
    for folder, names in sorted(folders.items()):
        at = spark._jvm.org.apache.hadoop.fs.Path(unquote(folder))
        found = [s for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.getPath().getName() in names]
        for line in sorted(f"{folder}|{s.getPath().getName()}|{s.getLen()}|{s.getModificationTime()}" for s in found):
            out.update(f"{line}\n".encode())
    return out.hexdigest()


def kept(name: str, source: DataFrame, make: Callable[[str], Index]) -> Index:
    """The index called name of a table in its present files, made if there is none in the shared folder yet."""
    spark = source.sparkSession
    state = files_state(spark, source.inputFiles())
    path = f"{shared_dir(spark)}/quirelake/index-{FORMAT}-{name}-{state[:16]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ready")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return Index(spark, path)
    made = make(f"{path}-{uuid.uuid4().hex}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    spark.range(1).write.parquet(f"{made.path}/ready")
    return Index(spark, path) if fs.rename(spark._jvm.org.apache.hadoop.fs.Path(made.path), folder) else made


def high_df_terms(df: DataFrame, n: int) -> DataFrame:
    """Terms in HIGH_DF of n passages or more; none for few passages, or if that were the whole vocabulary."""
    if n < PRUNE_FROM:
        return df.limit(0)
    cut = math.ceil(HIGH_DF * n)
    return df.filter(F.col("df") >= cut) if not df.filter(F.col("df") < cut).isEmpty() else df.limit(0)


def accent_variants(terms: DataFrame) -> DataFrame:
    """(folded, term, df, self_df): accented spellings beside the plain one's own df. terms: term, df, folded."""
    plain = terms.select(F.col("term").alias("folded"), F.col("df").alias("self_df"))
    return terms.filter("folded <> term").join(plain, "folded", "left").select("folded", "term", "df", F.coalesce("self_df", F.lit(0)).alias("self_df"))


def words_of(spark: SparkSession, query: str) -> list[tuple[str, str]]:
    """The query's distinct terms, each with its accent key."""
    asked = spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term"))
    return [(r["term"], r["k"]) for r in asked.select("term", accent_key(F.col("term")).alias("k")).collect()]


def bm25(index: Index, query: str, accents: bool = True) -> DataFrame:
    """(id, score) of every passage with a query term, by BM25: a few rows of the term table, then those terms' postings."""
    asked = words_of(index.spark, query)
    terms = index.read("terms")
    typed = [t for t, _ in asked]
    near = F.col("term").isin(typed) | (F.col("folded").isin([k for _, k in asked]) if accents else F.lit(False))
    stats = {r["term"]: (r["folded"], r["df"]) for r in terms.filter(near).select("term", "folded", "df").collect()} if typed else {}
    n, avgdl = index.facts()
    used = {t: stats[t][1] for t in query_terms(typed, dict(asked), stats, n, accents) if t in stats}
    if not used:
        return index.read("lengths").select("id", F.lit(0.0).alias("score")).limit(0)
    parts = [r["p"] for r in index.spark.range(1).select(F.explode(F.array(*map(F.lit, used))).alias("term")).select(_part().alias("p")).distinct().collect()]
    idf = F.create_map(*[F.lit(x) for t, df in used.items() for x in (t, math.log(1 + (n - df + 0.5) / (df + 0.5)))])
    score = idf[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(avgdl))))
    found = index.read("postings").filter(F.col("part").isin(parts) & F.col("term").isin(list(used)))
    return found.groupBy("id").agg(F.sum(score).alias("score")).filter("score > 0")


def query_terms(typed: list[str], plain: dict[str, str], stats: dict[str, tuple[str, int]], n: int, accents: bool = True) -> list[str]:
    """Terms that are scored: frequent ones go unless all are, then accented spellings join where they outweigh the plain one."""
    df = lambda t: stats.get(t, (t, 0))[1]
    rare = [t for t in typed if n < PRUNE_FROM or df(t) < math.ceil(HIGH_DF * n)]
    out: dict[str, None] = {}
    for t in rare or typed:
        out[t] = None
        if accents and plain.get(t, t) == t:
            others = sorted((s for s, (k, _) in stats.items() if k == t and s != t), key=lambda s: (-df(s), s))
            if sum(map(df, others)) > df(t):
                out.update(dict.fromkeys(others[:MOST_VARIANTS]))
    return list(out)


def top(scored: DataFrame, k: int, by: str = "score", digits: int | None = None) -> DataFrame:
    """The k best by score, ties by id."""
    key = F.round(by, digits) if digits is not None else F.col(by)
    return scored.filter(F.col(by) > 0).orderBy(key.desc(), "id").limit(k)


def corpus_mean(vectors: DataFrame, stride: int = 1) -> DataFrame:
    """(pos, mean) over every stride-th vector."""
    some = vectors.filter(F.col("id") % stride == 0) if stride > 1 else vectors
    return some.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def query_blocks(queries: DataFrame, most: int = QUERY_BLOCK) -> Iterator[tuple[list[int], np.ndarray]]:
    """The queries(id, vector) in blocks of about most, as ids and a matrix; one block at a time is held."""
    n = max(1, -(-queries.count() // most))
    for k in range(n):
        rows = (queries.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k) if n > 1 else queries).select("id", "vector").collect()
        if rows:
            width = max(len(r["vector"] or []) for r in rows)
            yield [r["id"] for r in rows], np.array([[*(r["vector"] or []), *[0.0] * (width - len(r["vector"] or []))] for r in rows], dtype=float)


def _best(scores: np.ndarray, ids: np.ndarray, asked: list[int], k: int, digits: int) -> pa.RecordBatch:
    """Of each query (column) the k best rows above zero, by rounded score and id."""
    out = []
    rounded = np.round(scores, digits)
    for q, own in enumerate(asked):
        order = np.lexsort((ids, -rounded[:, q]))[:k]
        order = order[scores[order, q] > 0]
        out.append((np.full(len(order), own), ids[order], scores[order, q]))
    cols = [np.concatenate(x) if out else np.empty(0) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])], names=["query", "id", "score"])


def _best_of(rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, asked: list[int], k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """_best() of the cosines, for QUERY_SLICE queries at a time: only their scores of the rows are held."""
    for at in range(0, len(asked), QUERY_SLICE):
        yield _best(cosines(rows, queries[at : at + QUERY_SLICE]), ids, asked[at : at + QUERY_SLICE], k, digits)


HIT = "query long, id long, score double"


def scored_batches(vectors: DataFrame, asked: list[int], queries: np.ndarray, k: int, digits: int) -> DataFrame:
    """(query, id, score): of every batch of rows the k best for each query, one matrix product a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                yield from _best_of(matrix(batch.column("vector"), queries.shape[1]), queries, ids, asked, k, digits)

    return vectors.filter("id is not null").select("id", "vector").mapInArrow(run, HIT)


def _ranked_hits(found: DataFrame, k: int, digits: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.round("score", digits).desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, id, score, rank): the k nearest of all vectors for every query, exactly; a scan answers a block of queries."""
    found = [scored_batches(vectors, asked, q, k, digits) for asked, q in query_blocks(queries)]
    empty = vectors.select(F.lit(0).cast("long").alias("query"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    for part in found:
        empty = empty.union(part)
    return _ranked_hits(empty, k, digits)


def coded(vectors: DataFrame, mean: np.ndarray) -> DataFrame:
    """vectors with their sign codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes(matrix(batch.column("vector"), len(mean)), mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in own], pa.binary())], names=["id", "vector", "code"])

    return vectors.filter("id is not null").select(F.col("id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(run, "id long, vector array<float>, code binary")


def _write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors sorted by id with their codes, the mean, and the share of rows that a pool needs for the wanted recall."""
    spark = vectors.sparkSession
    corpus_mean(vectors).write.parquet(f"{path}/mean")
    mean = _mean(Index(spark, path))
    coded(vectors, mean).repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
    index = Index(spark, path)
    share = measured_share(index, mean)
    spark.range(1).select(F.lit(float(share)).alias("share"), F.lit(index.read("vectors").count()).alias("n")).write.parquet(f"{path}/pool")


def _mean(index: Index) -> np.ndarray:
    return np.array([r["mean"] for r in index.read("mean").orderBy("pos").collect()])  # one number a dimension


def histograms(index: Index, asked: list[int], own: np.ndarray) -> dict[int, np.ndarray]:
    """For each query the number of rows at every Hamming distance; one scan of the codes alone."""
    bits = own.shape[1] * 8

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), bits + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                d = distances(np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1), own)
                total += np.stack([np.bincount(d[:, q], minlength=bits + 1) for q in range(len(asked))])
        q, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(asked, dtype=np.int64)[q]), pa.array(at.astype(np.int64)), pa.array(total[q, at])], names=["query", "distance", "n"])

    rows = index.read("vectors").select("code").mapInArrow(run, "query long, distance long, n long").groupBy("query", "distance").agg(F.sum("n").alias("n")).collect()
    out = {q: np.zeros(bits + 1, dtype=np.int64) for q in asked}
    for r in rows:  # bits + 1 numbers a query of the block
        out[r["query"]][r["distance"]] = r["n"]
    return out


def measured_share(index: Index, mean: np.ndarray, k: int = 20) -> float:
    """The share of rows, nearest by code, that holds RECALL of the true k nearest, over MEASURED queries."""
    sample = index.read("vectors").orderBy(F.xxhash64("id")).limit(MEASURED)
    ids, q = next(query_blocks(sample, MEASURED), ([], None))
    if not ids:
        return 1.0
    own = codes(q, mean)
    counts = histograms(index, ids, own)
    true = nearest(index.read("vectors"), sample, k).join(index.read("vectors").select("id", "code"), "id").select("query", "code").collect()
    place, within = {i: k for k, i in enumerate(ids)}, []
    for r in true:  # k rows a measured query
        d = int(np.bitwise_count(np.frombuffer(r["code"], dtype=np.uint8) ^ own[place[r["query"]]]).sum())
        within.append(counts[r["query"]][: d + 1].sum() / counts[r["query"]].sum())
    return float(np.quantile(within, RECALL)) if within else 1.0


def hamming_pool(index: Index, query: list[float], pool: int) -> DataFrame:
    """(id, distance) of the rows nearest by code, ties by id."""
    own = codes(np.array([query], dtype=float), _mean(index))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1), own)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(d)], names=["id", "distance"])

    return index.read("vectors").select("id", "code").mapInArrow(run, "id long, distance int").orderBy("distance", "id").limit(pool)


def two_stage(index: Index, queries: DataFrame, k: int, digits: int = 6, pool: int | None = None) -> DataFrame:
    """(query, id, score, rank): the k nearest by a pool over sign codes, scored exactly.

    The pool is the largest of CODE_POOL x k, LEAST_POOL and the share of rows measured for RECALL when the index was
    built. A scan of the codes counts rows by distance, which gives every query the distance where its pool is full;
    a second one takes the rows up to it (ties included), and only their vectors are scored.
    """
    mean, row = _mean(index), index.read("pool").first()
    pool = pool or max(CODE_POOL * k, LEAST_POOL, math.ceil(row["share"] * row["n"]))
    out = index.read("vectors").select(F.lit(0).cast("long").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    for asked, q in query_blocks(queries):
        own = codes(matrix(pa.array(q.tolist(), pa.list_(pa.float64())), len(mean)), mean)
        counts = histograms(index, asked, own)
        cut = np.array([int(np.searchsorted(np.cumsum(counts[i]), min(pool, counts[i].sum()))) for i in asked], dtype=np.int32)
        out = out.union(_rescored(index, asked, q, own, cut, pool, k, digits))
    return _ranked_hits(out, k, digits)


def _rescored(index: Index, asked: list[int], q: np.ndarray, own: np.ndarray, cut: np.ndarray, pool: int, k: int, digits: int) -> DataFrame:
    def near(batch: pa.RecordBatch) -> np.ndarray:
        return distances(np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1), own) <= cut

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(near(batch).any(axis=1)))], names=["id"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.where(near(batch), cosines(matrix(batch.column("vector"), q.shape[1]), q), 0.0)
                yield _best(s, batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), asked, k, digits)

    rows = index.read("vectors")
    if len(asked) * pool <= FEW:  # few enough for the scan to skip row groups by id
        ids = [r["id"] for r in rows.select("id", "code").mapInArrow(pick, "id long").collect()]
        rows = rows.filter(F.col("id").isin(ids))
    return rows.mapInArrow(score, HIT)


def ranked(scored: DataFrame, pool: int, digits: int | None = None) -> DataFrame:
    """(id, rank) of the pool's best, from 0; the window sees the pool only."""
    best = top(scored, pool, digits=digits)
    key = F.round("score", digits) if digits is not None else F.col("score")
    return best.select("id", (F.row_number().over(Window.orderBy(key.desc(), "id")) - 1).alias("rank"))


def fuse(lists: DataFrame) -> DataFrame:
    """Sum of 1 / (60 + place) over ranked lists, as rows (id, rank) of all of them."""
    return lists.groupBy("id").agg(F.sum(1.0 / (RRF_K + 1 + F.col("rank"))).alias("score"))


def best_per_item(hits: DataFrame, items: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Of each item its first passage, then the k best items. items: id, item."""
    key = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy("item").orderBy(key.desc(), "id")
    return hits.join(items.select("id", "item"), "id").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").orderBy(key.desc(), "id").limit(k)


def hybrid(index: Index, passages: DataFrame, query: str, query_vector: list[float], limit: int = 10, mode: str = "auto", digits: int | None = None) -> DataFrame:
    """(id, item, score): keyword and vector lists fused by reciprocal rank, an item once.

    Both lists are cut to a pool that starts at 3 times the limit and doubles until enough items are
    found or both are used up, so a hit outside one pool gets nothing from that list. The lists are scored once and
    their heads staged; how far the pool has to be widened is one aggregate over these.
    """
    most, total = POOL_FACTOR * limit * 64, index.facts()[0]
    lists = []
    if mode in ("auto", "keyword"):
        lists.append(bm25(index, query))
    if mode in ("auto", "semantic"):
        asked = index.spark.createDataFrame([(0, [float(x) for x in query_vector])], "id long, vector array<double>")
        lists.append(nearest(index.read("vectors"), asked, most, digits or 6).select("id", "score"))
    while True:
        heads = [ranked(x, most, digits) for x in lists]
        heads = heads[0] if len(heads) == 1 else heads[0].union(heads[1])
        heads = staged(heads.join(passages.select("id", "item"), "id"), "heads")
        pools = [POOL_FACTOR * limit * 2**k for k in range(64) if POOL_FACTOR * limit * 2**k <= most]
        found = heads.agg(*[F.count_distinct(F.when(F.col("rank") < p, F.col("item"))) for p in pools]).first()
        enough = [p for p, n in zip(pools, found, strict=True) if n >= limit]
        if enough or most >= total:
            pool = enough[0] if enough else max(total, most)
            return best_per_item(fuse(heads.filter(F.col("rank") < pool)), heads.select("id", "item").distinct(), limit, digits)
        most *= 16
        if mode in ("auto", "semantic"):
            lists[-1] = nearest(index.read("vectors"), asked, most, digits or 6).select("id", "score")


def find(index: Index, items: DataFrame, query: str, n: int = 10, digits: int | None = None) -> DataFrame:
    """(id, score, way): the index's best hits; where it has none, items(id, title) whose title holds the query, by title."""
    hits = top(bm25(index, query), n, digits=digits)
    if not hits.isEmpty():
        return hits.select("id", "score", F.lit("index").alias("way"))
    named = items.filter(F.lower("title").contains(query.lower())).orderBy("title", "id").limit(n)
    return named.select("id", F.lit(None).cast("double").alias("score"), F.lit("title").alias("way"))


def merge_by_rank(hits: DataFrame, k: int) -> DataFrame:
    """hits(library, id, score): the libraries' lists interleaved by rank, with each library's number of hits."""
    w = Window.partitionBy("library").orderBy(F.desc("score"), "id")
    counts = hits.groupBy("library").agg(F.count("*").alias("hits"))
    placed = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return placed.orderBy("rank", "library").limit(k).join(counts, "library")


def _log(c: Column) -> Column:
    """Natural logarithms by the C library, as DuckDB has them; the JVM's differ in the last bit, which parts equal scores."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        own, at = np.unique(values.to_numpy(zero_copy_only=False), return_inverse=True)
        return pa.array(np.array([math.log(x) for x in own.tolist()], dtype=float)[at])

    return run(c)


def rank_within(passages: DataFrame, query: str, n: int = 5) -> DataFrame:
    """passages(doc, id, text): the n best of every document by BM25, with statistics of that document alone. A document without a word has none."""
    terms = [t for t, _ in words_of(passages.sparkSession, query)]
    own = passages.select("doc", "id", tokens(F.col("text")).alias("t")).select("doc", "id", F.size("t").alias("length"), *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"f{k}") for k, w in enumerate(terms)])
    stats = own.groupBy("doc").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    stats = stats.select("doc", "avgdl", *[_log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)).alias(f"idf{k}") for k in range(len(terms))])
    score = sum((F.col(f"idf{k}") * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("length") / F.nullif("avgdl", F.lit(0.0)))) for k in range(len(terms))), F.lit(0.0))
    scored = own.join(stats, "doc").select("doc", "id", score.alias("score")).filter("score > 0")
    w = Window.partitionBy("doc").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rank_within_fused(passages: DataFrame, vectors: DataFrame, query: str, own: list[float], n: int = 5) -> DataFrame:
    """passages(doc, id, text) ranked as by rank_within(), its best max(4n, 20) of every document once more by the cosine of
    vectors(doc, id, vector) with own, and both lists fused by reciprocal ranks: (doc, id, score, rank). A passage without a vector has cosine 0."""
    pool = rank_within(passages, query, max(4 * n, 20)).select("doc", "id", F.col("rank").alias("word_rank"))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = F.array(*[F.lit(float(x)) for x in own])
    both = F.zip_with("vector", asked, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    cosine = F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.nullif(size(F.col("vector")) * size(asked), F.lit(0.0))
    placed = pool.join(vectors.select("doc", "id", "vector"), ["doc", "id"], "left").withColumn("cosine", F.round(F.coalesce(cosine, F.lit(0.0)), 9))
    near = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("cosine"), "word_rank"))
    fused = placed.withColumn("near", near).withColumn("score", 1.0 / (RRF_K + F.col("word_rank")) + 1.0 / (RRF_K + F.col("near")))
    last = Window.partitionBy("doc").orderBy(F.desc("score"), "word_rank")
    return fused.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= n).select("doc", "id", "score", "rank")
