"""Steps whose cost has to follow the input: what they give is held against plain versions, and what they shuffle against their plans."""

import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirelake.functions import normal
from quirelake.functions import text as tx
from quirelake.functions.vectors import cosines
from quirelake.operators import components as shared
from quirelake.operators import graph, items, retrieval
from quirelake.operators.asof import last_before
from quirelake.operators.components import components
from quirelake.plans import items as plans_items
from quirelake.plans import library, listing, scholarly
from quirelake.plans import retrieval as plans_retrieval


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_their_row(spark):
    texts = [(1, "bb aa bb éé ÉÉ x"), (2, None), (3, ""), (4, "x . y"), (None, "zz zz"), (6, "aa " * 300 + "bb")]
    docs = spark.createDataFrame(texts, "id long, text string")
    counts = retrieval.counted(docs)
    assert "Exchange" not in plan(counts) and "Aggregate" not in plan(counts)
    assert "Exchange" not in plan(retrieval.spread(counts))
    words = lambda t: [w for w in tx_words(spark, t) if w]
    want = {(i, len(words(t)), w, n) for i, t in texts for w, n in Counter(words(t)).items()}
    assert {tuple(r) for r in retrieval.postings(docs).collect()} == want
    assert {(r["id"], r["length"]) for r in counts.collect()} == {(i, len(words(t))) for i, t in texts}
    again = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (1, "cc")], "id long, text string")  # one id: texts of one length count as one
    got = sorted(tuple(r) for r in retrieval.postings(again).collect())
    assert got == [(1, 1, "cc", 1), (1, 2, "aa", 1), (1, 2, "bb", 2), (1, 2, "cc", 1)]


def tx_words(spark, text):
    return spark.range(1).select(tx.tokens(F.lit(text).cast("string")).alias("t")).first()["t"]


def test_title_keys_take_one_pass(spark):
    texts = ["", " ", " ", "A  b", "Élève —x́ ", "a​b", "𝒳 y\U0001f600z", "x_y\n\t-　Z", "…", None, "ﬁ 1½2", " a﻿b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.nullif(tx.squash(F.regexp_replace(F.lower(tx.fold(F.col("t"))), rf"[^\p{{L}}\p{{N}}{tx.SPACES}]", " ")), F.lit(""))
    both = df.select(tx.title_key(F.col("t")).alias("key"), plain.alias("plain"))
    assert all(r["key"] == r["plain"] for r in both.collect())
    assert plan(df.select(tx.title_key(F.col("t")).alias("key"))).count("regexp_replace") < plan(df.select(plain.alias("key"))).count("regexp_replace")


def test_duplicate_texts_are_read_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(library.components, "components", lambda pairs: seen.append(plan(pairs)) or components(pairs))
    library.dup_components(spark, sf_dir)
    assert "documents.parquet" not in seen[0]


def test_rows_at_their_top_are_spread(spark):
    rows = [(k, None if k < 5 else k % 5 if k < 3000 else k - 2990) for k in range(4000)]
    own = spark.createDataFrame(rows, "key long, parentItem long")
    up, conf = dict(rows), {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = items.to_top(own.filter("parentItem is not null"), own).withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    def top(k):
        for _ in range(3):
            k = up[k] if up[k] is not None else k
        return k

    assert {r["key"]: r["top"] for r in got} == {k: top(k) for k, p in rows if p is not None}
    assert max(Counter(r["p"] for r in got).values()) < len(got) / 2


def test_pairs_of_a_group_take_no_join(spark):
    rows = [(k % 7, k * k % 11) for k in range(60)] + [(None, 1), (None, 2), (1, None), (2, 3), (2, 3)]
    groups = {g: {m for h, m in rows if h == g and m is not None} for g, _ in rows if g is not None}
    want = Counter((a, b) for own in groups.values() for a in own for b in own if a < b)
    got = graph.co_occurrence(spark.createDataFrame(rows, "g long, m long"), "g", "m", least=2)
    assert {(r["a"], r["b"]): r["n"] for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}
    assert "Join" not in plan(got)


def test_more_rows_take_more_tasks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    assert shared.tasks(spark.range(10_000)) == 20 and shared.tasks(spark.range(10)) == 4
    seen = []
    monkeypatch.setattr(plans_items.asof, "last_before", lambda lines, marks, *a, **k: seen.append(plan(lines)) or last_before(lines, marks, *a, **k))
    plans_items.events_after_orders(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in seen[0]


def test_parts_are_dealt_to_all_tasks(spark, sf_dir):
    assert all("REPARTITION_BY_NUM" in plan(q(spark, sf_dir)) for q in (scholarly.text_keys, listing.identifiers_in_text))


def test_scores_are_held_for_some_queries_at_a_time():
    r = np.random.default_rng(3)
    rows, queries = r.normal(size=(4000, 8)), r.normal(size=(1000, 8))
    ids, asked = np.arange(4000), list(range(1000))
    tracemalloc.start()
    got = [b.to_pydict() for b in retrieval._best_of(rows, queries, ids, asked, 3, 6)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole = retrieval._best(cosines(rows, queries), ids, asked, 3, 6).to_pydict()
    assert peak < rows.shape[0] * queries.shape[0] * 8 / 2
    assert [x for b in got for x in b["query"]] == whole["query"] and [x for b in got for x in b["id"]] == whole["id"]


def test_documents_without_words_and_long_numbers(spark, tmp_path):
    """Neither stops the ranking of passages: a document without a word has none, and a line of many numbers is a heading."""
    texts = [(1, "! ? ."), (2, "a"), (3, "1" + ".1" * 20_000 + " Birds\n" + "the heron " * 200), (4, "the heron")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = plans_retrieval.passages_in_document(spark, str(tmp_path)).collect()
    assert {r["doc"] for r in got} == {3, 4} and all(r["score"] > 0 for r in got)
    assert max(r["section"] or "" for r in got if r["doc"] == 3) == ("1" + ".1" * 50)[:100]


def test_lone_marks_are_joined_and_texts_taken_apart_once(spark, sf_dir):
    bases, marks = "aEnzQ é1ß", ["", "́", "̈", "̧", "̈́", "̣́", "̣́", "̸", "ְ"]
    texts = [f"{a}{m}{b}{n}" for a in bases for m in marks for b in ("", "o", "中") for n in marks] + ["́", "́a", "café näıve Zürich 中"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r["c"] == unicodedata.normalize("NFC", r["t"]) for r in df.select("t", normal.composed(F.col("t")).alias("c")).collect())
    own = plans_retrieval.term_df_decomposed(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert own.count("regexp_extract_all(text#") == 1  # what the terms are read from is a column made before
