"""The pipeline's stages against brute force, with null and repeated ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quirelake.llm import decontaminate

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(n))
    a, b, c, d, item = (prose(60) for _ in range(5))
    clean = [(None, prose(40)), (None, prose(50)), (7, prose(30)), (None, None), (None, None), (None, ""), (20, "")]
    copies = [(1, a), (None, a), (2, a + " more"), (3, b), (3, b), (None, c), (None, c), (7, d), (9, d), (4, d)]
    leaks = [(None, prose(9) + " " + item), (30, prose(20) + " " + item + " x"), (30, prose(25))]
    return clean + copies + leaks, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows[0]], SCHEMA)


def near(rows):
    parts = {}
    for k, (_, own) in brute.near_dedup([(k, t) for k, (_, t) in enumerate(rows)], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT).items():
        parts.setdefault(own, []).append(rows[k])
    return [min(p, key=lambda x: (x[0] is None, x[0] or 0)) for p in parts.values()]


def clean(rows, items):
    hit = {k for k, _ in brute.decontaminate([(k, t) for k, (_, t) in enumerate(rows)], items)}
    return [x for k, x in enumerate(rows) if k not in hit]


def found(df):
    return Counter((x["doc_id"], x["text"]) for x in df.collect())


def test_near_stage(spark, docs, rows):
    assert found(corpus_pipeline.near_stage(spark, docs, "")) == Counter(near(rows[0]))


@pytest.mark.parametrize("item_bytes", [1 << 20, 100])
def test_decontaminate(spark, docs, rows, monkeypatch, item_bytes):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    bench = spark.createDataFrame(rows[1], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert found(out) == Counter(clean(*rows)) and out.columns == docs.columns


def test_run(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows[1], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = Counter(i for i, _ in clean(near(rows[0]), rows[1]))
    got = Counter(x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) == set(want) and all(got[i] >= n for i, n in want.items())
