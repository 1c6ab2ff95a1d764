"""The corpus operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat_format, decontaminate, exact_dedup, mixing, near_dedup, queries, sharding, substring_dedup, suffix_array, token_count, toxicity, url_filter

from . import brute

#: Extra columns whose names clash with ones that operators use inside.
CLASH = "doc_id long, text string, key string, label long, shard int, n long, h long, source string"


def texts(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    base, passage = prose(200), prose(40)
    out = [None, "", " \n\t", "one", "One", base, base.upper(), base, f"{prose(30)} {passage} {prose(20)}", f"{passage} {prose(60)}", passage, prose(20_000)]
    for k in range(12):  # near copies
        ws = base.split()
        for _ in range(2 * k):
            ws[r.randrange(len(ws))] = r.choice(vocabulary)
        out.append(" ".join(ws))
    out += [prose(r.randint(1, 80)) for _ in range(20)] + [f"  {base}\n", "x" * 250, "x" * 250, "é" * 120]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, None if i % 5 == 0 else f"s{i % 2}") for i, t in rows], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


def test_substring_dedup(spark, docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute.substring_dedup(rows)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0
    twice = substring_dedup.substring_dedup(docs.filter("doc_id = 5").union(docs.filter("doc_id = 5"))).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]  # one document, told twice


def test_windows_of_hot_anchors():
    raw = random.Random(7).randbytes(300)
    at, left, right = np.array([100, 135]), np.array([17, 68]), np.array([100, 83])
    got = np.concatenate(substring_dedup._windows(raw, 1, 2, at - left, at + right))
    assert got["at"].tolist() == list(range(67, 119))


def test_substring_dedup_hot(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 1)
    r = random.Random(11)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passages = [prose(400) for _ in range(4)]
    rows = []
    for i in range(160):
        p = passages[i % 4]
        a = r.randrange(0, 250)
        rows.append((i, prose(r.randint(0, 60)) + p[a : a + r.randint(100, 200)] + prose(r.randint(0, 60))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute.substring_dedup(rows)


def test_suffix_array():
    r = np.random.default_rng(1)
    for n in range(1, 120):
        x = np.concatenate((np.tile(r.integers(1, 4, n), 1 + n % 3), [0]))
        for suffix_array.DENSE in (1, 10**9):
            sa = suffix_array.suffix_array(x, int(x.max()) + 1)
            assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    suffix_array.DENSE = 1000


def test_token_counts(spark, docs, rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = [(100, "<s> </s> ▁ ▁▁a"), (101, "a  b   c\n\n d \t e\r\n"), (102, "\n"), (103, "  "), (104, "ﬁ①　x")]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(more, path, 10).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in [*rows, *odd]}
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path)
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(docs, path).collect()}
    assert got == {i: len(want.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert token_count.token_counts(empty(spark), path).count() == 0


def test_decontaminate(spark, docs, rows):
    items = [(1, rows[10][1]), (2, None), (3, ""), (4, "one two"), (5, rows[20][1]), (6, "only here " * 9)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == brute.decontaminate(rows, items) and {8, 9, 10} <= {d for d, _ in got}
    kept = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in got} and kept.columns == docs.columns
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontaminate_in_blocks(spark, docs, rows, monkeypatch):
    items = [(k, rows[d][1]) for k, d in enumerate((10, 20, 9, 0))]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", sum(len((t or "").encode()) for _, t in items) // 2)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    named = docs.withColumn("_row", F.lit("x"))
    want = brute.decontaminate(rows, items)
    assert len(list(decontaminate._blocks(bench))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(named, bench).collect()} == want
    kept = decontaminate.decontaminate(named, bench)
    assert kept.columns == named.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})


@pytest.mark.parametrize(("n", "percent"), [(2, 80), (5, 80)])
def test_near_dedup(spark, docs, rows, n, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs, n, percent).collect()}
    assert got == brute.near_dedup(rows, n, percent)
    assert near_dedup.near_dedup(empty(spark), n, percent).count() == 0


def test_near_dedup_across_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "KEY_MEMBERS", 3)
    monkeypatch.setattr(near_dedup, "HUB_MEMBERS", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs, 2, 80).collect()}
    assert got == brute.near_dedup(rows, 2, 80)


def test_exact_dedup(spark, docs, rows):
    want = brute.exact_dedup(rows)
    for out in (exact_dedup.exact_dedup(docs), exact_dedup.exact_dedup(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")), exact_dedup.exact_dedup(docs, empty(spark)), exact_dedup.exact_dedup(empty(spark), docs)):
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect()} == want


def test_fuse_filter():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = exact_dedup.FuseFilter(keys)
    assert f.may_have(keys).all()
    assert f.may_have(keys + np.uint64(1)).mean() < 0.01
    assert exact_dedup.FuseFilter(keys[:1]).may_have(keys[:1]).all()


def test_sharding(spark, docs, rows):
    out = sharding.shard(docs, 7).collect()
    assert len(out) == len(rows) and sharding.shard(empty(spark), 7).count() == 0
    by, size = {}, {}
    for r in out:
        raw = (rows[r["doc_id"]][1] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        by.setdefault(r["shard"], []).append(r)
        k = hashlib.sha256(raw).hexdigest()
        size[k] = size.get(k, 0) + r["size"]
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert max(sum(r["size"] for r in v) for v in by.values()) == brute.minimax([size[k] for k in sorted(size)], 7)


def test_mixing(spark, docs):
    out = mixing.mix(docs, tokens=F.coalesce(F.length("text"), F.lit(0)), repetition_limit=2.0)
    n = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == {r["doc_id"] for r in docs.select("doc_id").collect()} and max(n.values()) <= 2
    assert mixing.mix(empty(spark), repetition_limit=2.0).count() == 0


def test_url_filter(spark):
    urls = [(1, "http://A.Example.com/en/7x?q"), (2, None), (3, "nothing"), (4, "http://x.net/de/"), (5, "http://com/en/1"), (6, "http://xcom/en/1"), (7, "http://e.org/es/#a"), (1, "http://A.Example.com/en/7x?q")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, host string")
    out = url_filter.url_filter(pages, url_filter.rule_table(spark, queries.URL_RULES))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.na.fill("-", ["rule"]).collect())
    one = (1, "a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got == sorted([one, one, (2, "", "", "-", "allow"), (3, "", "", "-", "allow"), (4, "x.net", "/de/", "net/de/", "allow"), (5, "com", "/en/1", "com/en/", "block"), (6, "xcom", "/en/1", "-", "allow"), (7, "e.org", "/es/", "org/es/", "block")])
    listed = url_filter.url_filter(pages, url_filter.rule_table(spark, []), listed=pages.filter("page_id = 4"))
    assert {r["page_id"] for r in listed.filter("verdict = 'block'").collect()} == {4}


def test_chat_tree(spark):
    rows = [(1, 1, None, "user", "q<\\#", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "better", 2.0), (1, 4, 3, "user", None, 0.0), (2, 1, None, None, "", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_paths(messages, chat_format.paths(messages))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", "q<\\#"), ("assistant", "better"), ("user", "")]
    assert out[1]["loss_texts"] == ["better"] and [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")]


def test_toxicity(spark):
    r = random.Random(5)
    fine, bad = ["river", "stone", "cloud", "paper", "green", "table"], ["vilest", "hateful", "scumbag"]
    rows = [(i, " ".join(r.choices(fine, k=60)) + (" " + " ".join(r.choices(bad, k=6)) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[i]["held_out"] == brute.held_out(i) and out[i]["predicted"] == (i % 4 == 0) for i in range(400))
    assert out[900]["score"] == out[901]["score"] < 0.5
    assert toxicity.toxicity(docs, labels.limit(0)).filter("score > 0.01").count() == 0
