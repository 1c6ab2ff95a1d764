"""Merkle manifest, hard negatives and byte-level BPE: against plain versions, the tokenizer's own library, and SQL."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quirelake.llm import bpe, chat_format, hard_negatives, merkle, mixing, queries, toxicity, url_filter

from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long, ids binary"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """For each of nodes, what stands beside it and above it, as (slot, run) pairs; and the last node."""
    above, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            above[k].append((at % 8, nodes[at // 8 * 8 : at // 8 * 8 + 8]))
        place, nodes = [at // 8 for at in place], [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return above, nodes[0] if nodes else None


def plain_merkle(rows):
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else None))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in langs}
    over, root = climb([trees[g][1] for g in langs])
    out = []
    for g, up in zip(langs, over, strict=True):
        for x, own in zip(sorted(groups[g]), trees[g][0], strict=True):
            steps, h = own + up, x[3] or x[2]
            beside = "".join("".join(run[:s] + run[s + 1 :]) for s, run in steps)
            for s, run in steps:
                h = sha("".join([*run[:s], h, *run[s + 1 :]]))
            out.append((x[1] if x[0] else None, x[2], trees[g][1], root, sha(beside), h, h == root))
    return out


def merkle_rows(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1, b"") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r) for r in out.collect()]


def test_merkle(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, r.choice(["One", "two", None, "", "ÄB c"]), r.choice(["en", "en", "en", "de", None, ""]), r.choice([None, "s"]), r.choice([1, None])) for k in range(700)]
    rows += [(None, "A", "en", "s", 1), (None, "b", "en", None, None), (5, "A", "en", "s", 1), (5, "A", "en", "s", 1), (9000, "Lone", "zz", "s", 4), (9003, "x" * 300_000 + "Y", "é", "s", 4)]
    rows += [(10_000 + k, "B", "nine", "s", 1) for k in range(9)]
    r.shuffle(rows)
    got, want = merkle_rows(spark, rows, tmp_path), plain_merkle(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert any(x[6] for x in got) and not all(x[6] for x in got)


@pytest.mark.parametrize("rows", [[], [(1, "A", None, None, None)], [(1, None, "en", "s", 1), (2, "B", "de", "s", 1)]])
def test_merkle_small(spark, tmp_path, rows):
    assert sorted(map(repr, merkle_rows(spark, rows, tmp_path))) == sorted(map(repr, plain_merkle(rows)))


def plain_negatives(rows):
    """rows: vec_id, label, vector, is_anchor."""
    rows = [(k, i, g, [*v, *[0] * (200 - len(v))], a) for k, (i, g, v, a) in enumerate(rows) if g is not None and v is not None and None not in v]
    place = lambda s, r: (-s, r[1] is None, r[1] or 0)
    out = []
    for a in (r for r in rows if r[4]):
        scores = [(sum(x * y for x, y in zip(a[3], r[3], strict=True)), r) for r in rows]
        for p, pos in sorted(((s, r) for s, r in scores if r[2] == a[2] and r[0] != a[0]), key=lambda x: place(*x))[:5]:
            fit = sorted(((s, r) for s, r in scores if r[2] != a[2] and 30 * p <= 100 * s <= 90 * p), key=lambda x: place(*x))[:10]
            out += [(a[1], pos[1], k + 1, r[1], p, s) for k, (s, r) in enumerate(fit)]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 20)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)


@pytest.mark.parametrize("dims", [5, 70, 170])
def test_hard_negatives(spark, small_blocks, monkeypatch, dims):
    if dims == 170:
        monkeypatch.setattr(hard_negatives, "FAN", 2)
    r = random.Random(dims)
    vector = lambda n: [r.randint(-9, 30) for _ in range(n)]
    rows = [(k, r.choice([0, 1, 1, 1, 2, 9]), vector(dims if r.random() < 0.9 else r.randint(0, dims)), k % 11 == 0) for k in range(150)]
    same = vector(dims)
    rows += [(200 + k, k % 3, same, False) for k in range(30)] + [(300, None, same, True), (301, 1, None, True), (302, 1, [None, 1], True), (303, 2, [], True), (None, 1, same, False), (400, 77, same, True)]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "vec_id long, label long, vector array<long>, is_anchor boolean, row string, block long")
    got = sorted(map(repr, map(tuple, hard_negatives.mine(df).collect())))
    assert got == sorted(map(repr, plain_negatives(rows))) and got
    twice = spark.createDataFrame([x for x in rows if x[0] in (0, 1, 2, 3)] * 2, "vec_id long, label long, vector array<long>, is_anchor boolean")
    assert len(hard_negatives.mine(twice).collect()) == len(plain_negatives([x for x in rows if x[0] in (0, 1, 2, 3)] * 2))
    assert hard_negatives.mine(df.filter("false")).count() == 0


def test_exact_products():
    x, y = np.full((1, 2), 2**30 + 1, dtype=np.int64), np.full((1, 2), 2**30 + 3, dtype=np.int64)
    assert hard_negatives.product(x, y)[0, 0] == 2 * (2**30 + 1) * (2**30 + 3)
    assert hard_negatives.product(x // 2**20, y // 2**20)[0, 0] == 2 * 2**20


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    r = random.Random(4)
    draw = lambda letters, n: "".join(r.choices(letters, k=n))
    return [None, "", "a", " ", "  a b\n\n c \t", "<|endoftext|> x", "x" * 5000, "ab" * 700, draw("abc", 9000), draw("abcdefghijklmnopqrstuvwxyz", 9000), draw("бвгдежз", 3000), draw([chr(c) for c in range(32, 0x2FFF)], 4000), draw([chr(c) for c in range(0x4E00, 0x9FFF)], 3000), "é" * 900, "don't we'll 123 4567 !!?? ﬁ①", "word " * 300_000, "same", "same"]


def test_bpe(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 500)
    path, texts = public_tokenizers.path(queries.RANKS), hard_texts()
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, decoded_ string")
    out = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"]), r["text"]) for r in out.collect()}
    for k, t in enumerate(texts):
        assert got[k] == (np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode(), t), k
    assert bpe.encode(docs.filter("false"), path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("decoded_", "ids"), path, public_tokenizers.PATTERN)


def test_bpe_matrix_and_row_agree():
    """Single merges in a matrix and all places of a pair at once give the same ids."""
    b, r = bpe.loaded(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN), random.Random(6)
    for letters in ("ab", "aei ", "thein", "\x00\xff\x80é"):
        pieces = ["".join(r.choices(letters, k=r.randint(1, 250))).encode() for _ in range(60)]
        assert b._bucket(pieces) == [b._long_row(p) for p in pieces]


def test_bpe_pairs_that_make_lower_ranks():
    """A vocabulary whose merges make pairs of lower rank than their own, so not all places can be merged at once."""
    ranks = {bytes([k]): 1000 + k for k in range(256)} | {b"ab": 50, b"aba": 3, b"abab": 2, b"bab": 70, b"cab": 1, b"abc": 4}
    b = bpe.Bpe.__new__(bpe.Bpe)
    b.single, b.ranks = np.array([1000 + k for k in range(256)], dtype=np.int32), ranks
    b.pairs = bpe.PairTable({(ranks[t[:k]], ranks[t[k:]]): n for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks})
    r = random.Random(9)

    def plain(piece):
        row = [bytes([x]) for x in piece]
        while True:
            best = min(((ranks.get(row[k] + row[k + 1], math.inf), k) for k in range(len(row) - 1)), default=(math.inf, 0))
            if best[0] == math.inf:
                return np.array([ranks[t] for t in row], dtype="<u4").tobytes()
            row[best[1] : best[1] + 2] = [row[best[1]] + row[best[1] + 1]]

    pieces = ["".join(r.choices("abc", k=r.randint(1, 40))).encode() for _ in range(400)]
    want = [plain(p) for p in pieces]
    assert b._bucket(pieces) == want and [b._long_row(p) for p in pieces] == want


def test_bpe_query(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, SMALL).collect()}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    want = {k: np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes() for k, t in texts.items()}
    assert got == {k: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256((texts[k] or "").encode()).hexdigest()) for k, x in want.items()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    """The registered query gives the rows of its SQL."""
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = con.execute(queries.ORACLE[name])
    mine, names = queries.QUERIES[name](spark, SMALL), [x[0] for x in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, mine.select(names).collect()))) == sorted(map(repr, theirs.fetchall()))


def plain_paths(rows, most):
    """Best branches by walking up from every leaf; rows: conv_id, msg, parent, role, text, score."""
    copies = {}
    for k, r in enumerate(rows):
        copies.setdefault((r[0], r[1]), []).append(k)
    up = {}
    for (conv, _), own in copies.items():
        for before, k in zip([None, *own], own, strict=False):
            up[k] = before if before is not None else copies.get((conv, rows[k][2]), [None])[-1] if rows[k][2] is not None else None
    out = {}
    for k in set(up) - set(up.values()):
        path, at = [], k
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        if at is None:
            out.setdefault(rows[k][0], []).append((-sum(rows[j][5] or 0 for j in path), -len(path), rows[k][1], [rows[j][3:5] for j in reversed(path)]))
    return {(conv, n + 1): x[3] for conv, found in out.items() for n, x in enumerate(sorted(found, key=lambda x: x[:3])[:most])}


@pytest.mark.parametrize("numbered", [True, False])
def test_reply_trees_with_repeated_messages(spark, numbered):
    r = random.Random(3)
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 0.5)]
    rows += [(2, k, k - 1 if k else None, "user", f"t{k}", 0.0) for k in range(70)] + [(None, 1, None, "user", None, None), (None, 2, 1, None, "x", None)]
    rows += [(3, 1, 2, "user", "c", 0.0), (3, 2, 1, "user", "c", 0.0), (3, 3, 2, "user", "under", 0.0), (3, 4, 9, "user", "no parent", 0.0)]
    for conv in range(10, 40):
        rows += [(conv, m, r.choice([None, *range(m)]) if m else None, "assistant", f"{conv}-{m}", float(r.randint(-2, 5))) for m in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double")
    df = chat_format.numbered(df) if numbered else df
    out = chat_format.read_back(chat_format.format_paths(df, chat_format.paths(df, 2))).collect()
    got = {(x["conv_id"], x["branch"]): [(t["role"], t["text"]) for t in x["turns"]] for x in out}
    assert got == {k: [(a or "", b or "") for a, b in v] for k, v in plain_paths(rows, 2).items()}
    assert [t for t in got[1, 1]] == [("user", "hi"), ("user", "hi"), ("assistant", "a")]


def test_url_filter_keeps_other_columns(spark):
    """Columns with names that the operator uses, map columns, and pages with ids of any kind."""
    rows = [(f"p{k % 40}", "http://a.example.com/en/7" if k % 3 else None, {"k": "v"}, 1, 2, 3, "x", f"own {k}") for k in range(120)]
    schema = "page_id string, url string, extra map<string,string>, salt int, _salt int, salt_of_page int, url_found string, rule string"
    pages = spark.createDataFrame(rows, schema)
    out = url_filter.url_filter(pages, url_filter.rule_table(spark, queries.URL_RULES))
    assert out.columns == ["page_id", "url", "extra", "salt", "_salt", "salt_of_page", "url_found", "host", "path", "rule", "verdict"]
    got = out.collect()
    assert len(got) == 120 and all((r["salt"], r["_salt"], r["salt_of_page"], r["url_found"], r["extra"]) == (1, 2, 3, "x", {"k": "v"}) for r in got)
    assert {(r["url"] is None, r["rule"], r["verdict"]) for r in got} == {(True, None, "allow"), (False, "example.com/en/7", "allow")}


def test_mixing_keeps_other_columns(spark):
    """Columns with the operator's own names; the rows drawn are those without such columns."""
    names = ["source", "weight", "full", "n", "rest", "h", "tokens", "block", "t", "run", "s", "b", "take", "room", "spent", "c", "cut", "fits", "epoch"]
    rows = [(k if k % 7 else None, "word " * (k % 9), f"s{k % 3}" if k % 2 else "big") for k in range(300)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = plain.selectExpr("*", *[f"'own' AS _mix_{n}" for n in names], "'mine' AS mix_tokens", "map('a', 1) AS m")
    a, b = (mixing.mix(d, repetition_limit=1.7) for d in (plain.filter("doc_id IS NOT NULL"), wide.filter("doc_id IS NOT NULL")))
    assert b.columns == [*[c for c in wide.columns if c != "mix_tokens"], "mix_tokens", "mix_weight", "mix_epoch", "mix_block_rank"]
    key = ["doc_id", "mix_tokens", "mix_weight", "mix_epoch", "mix_block_rank"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))
    assert b.filter(" OR ".join(f"_mix_{n} <> 'own'" for n in names)).count() == 0
    assert mixing.mix(wide, repetition_limit=1.7).filter("doc_id IS NULL").count() >= sum(r[0] is None for r in rows)


def plain_mixing(rows, limit):
    """How many tokens each source may spend: the smallest exponent by bisection in plain arithmetic."""
    total = Counter()
    for _, s, t in rows:
        total[s] += t
    share = {s: t / sum(total.values()) for s, t in total.items() if t}
    ratio = lambda a: max(p ** (a - 1) for p in share.values()) / min(p ** (a - 1) for p in share.values())
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if ratio(mid) <= limit else (mid, high)
    a = 0.0 if ratio(0.0) <= limit else high
    z = sum(p**a for p in share.values())
    least = min(p ** (a - 1) / z for p in share.values())
    return {s: p**a / z / least / p * total[s] for s, p in share.items()}, total


def test_mixing_query(spark):
    """op5: every source's spending is its budget, but for less than one document of the block that is cut; whole epochs have every row."""
    out = queries.op5_mixing(spark, SMALL)
    rows = duckdb.sql(f"SELECT doc_id, source, ceil(length(coalesce(text, '')) / 4)::BIGINT FROM '{SMALL}/documents.parquet'").fetchall()
    budget, total = plain_mixing(rows, 2.0)
    got, drawn = Counter(), Counter()
    for r in out.collect():
        got[r["source"]] += r["mix_tokens"]
        drawn[r["doc_id"], r["mix_epoch"]] += 1
    largest = Counter()
    for _, s, t in rows:
        largest[s] = max(largest[s], t)
    assert set(drawn.values()) == {1} and all(drawn[i, 1] == 1 for i, _, _ in rows)
    for s, b in budget.items():
        assert b * (1 + 1e-6) + 1 >= got[s] > b * (1 - 1e-6) - largest[s] - 1, s
        assert got[s] <= 2 * total[s]


def test_toxicity_learns_from_training_rows_only(spark):
    """Labels of rows that are held out change no score, and on the tables held-out toxic documents are told from others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b
    rows = [(a[r["doc_id"]], r["toxic"]) for r in labels.filter(held).dropna().join(docs.select("doc_id"), "doc_id").collect()]
    bad, good = [s for s, t in rows if t], [s for s, t in rows if not t]
    auc = sum((x > y) + (x == y) / 2 for x in bad for y in good) / (len(bad) * len(good))
    assert auc >= 0.85 and sum(s >= 0.7 for s in bad) >= 0.6 * len(bad) and sum(s >= 0.7 for s in good) <= 0.05 * len(good)
