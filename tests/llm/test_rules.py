"""Rules of the corpus operators that need inputs of their own: exhaustive searches, built collisions, ids, budgets."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import bloom, chat_format, exact_dedup, kernels, mixing, near_dedup, toxicity, url_filter, util

from . import brute


def all_maximal(score):
    """Maximal-scoring segments by their definition: the best one, then those of the rest on both sides."""
    out = []

    def search(a, b):
        best = max(((sum(score[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 0:
            i, j = -best[2], -best[2] - best[1]
            out.append((i, j - i, best[0]))
            search(a, i)
            search(j, b)

    search(0, len(score))
    return sorted(out)


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(300):
        score = [r.choice([-5, -3, -2, -1, 1, 2, 3, 7]) + r.choice([0, 0.125]) for _ in range(r.randint(0, 14))]
        got = sorted(toxicity.maximal(np.array(score)))
        want = all_maximal(score)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
        assert [x[:2] for x in got] == [x[:2] for x in want] or sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want))


def test_maximal_is_linear():
    def seconds(n):
        score = np.full(n, -0.1)
        score[::50] = 4.0 + np.arange(len(score[::50])) % 7
        score[1::100] = -9.0
        began = time.process_time()
        toxicity.maximal(score)
        return time.process_time() - began

    seconds(1000)
    assert seconds(2_000_000) < 2 + 40 * seconds(100_000)


def test_karlin_altschul():
    lam = toxicity.decay(np.array([-1.0, 1.0]), np.array([3.0, 1.0]))
    assert lam == pytest.approx(math.log(3), abs=1e-6)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "fine river stone", 0.5, "x"), (2, None, 0.1, "y")], "doc_id long, text string, score double, passages string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect()} == {1, 2}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    kept = toxicity.without_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 2


def test_long_words_are_told_apart():
    a = b"a"
    for _ in range(11):
        a += a.translate(bytes.maketrans(b"ab", b"ba"))
    b = a.translate(bytes.maketrans(b"ab", b"ba"))
    x, y = (next(kernels.shingles([t], 2)) for t in (a, b))
    assert len(a) == 2048 and x.tolist() != y.tolist()


def test_exact_dedup_ids(spark):
    low = -(1 << 63)
    rows = [(low, "a b"), (5, "ab"), (None, "a  b"), (None, "a  b"), (low, "x"), (7, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect())
    assert out == Counter({(low, None, 4, False): 1, (5, None, 4, False): 1, (None, None, 4, True): 2, (low, low, 1, True): 1, (7, 8, 2, False): 1, (8, 8, 2, True): 1})


def test_kept_snapshot(spark, tmp_path):
    old = spark.createDataFrame([(k, f"text {k % 40}") for k in range(100)], "doc_id long, text string")
    path = str(tmp_path / "snapshot")
    exact_dedup.write_snapshot(old, path)
    new = spark.createDataFrame([(k, f"text{k % 60}") for k in range(100, 220)], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(new, old, path).collect()}
    assert got == brute.exact_dedup([(r["doc_id"], r["text"]) for r in old.union(new).collect()])
    with pytest.raises(Exception, match="(?i)already exists"):
        exact_dedup.write_snapshot(new, path)


def test_bytes_are_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "first_hash", lambda norm: F.unhex(F.lit("00" * 32)))
    monkeypatch.setattr(exact_dedup, "second_hash", lambda norm: F.lit(1).cast("long"))
    one, two, three = (spark.createDataFrame([(k, t)], "doc_id long, text string") for k, t in ((1, "ab"), (2, "cd"), (3, "a b")))
    with pytest.raises(ValueError, match="share the digest"):
        exact_dedup.exact_dedup(one, two)
    assert exact_dedup.exact_dedup(one, three).filter("kept").count() == 1


def test_near_dedup_ids(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choices("abcdefg", k=5)) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(7, a), (7, b), (3, b + " x"), (None, a), (None, c), (9, c + " y"), (9, c + " y"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.near_dedup(docs, 2, 80).collect())
    assert got == Counter({(7, 7, True): 1, (7, 3, False): 1, (3, 3, True): 1, (None, 7, False): 1, (None, 9, False): 1, (9, 9, True): 2, (None, None, True): 2})


def drawn(out):
    return {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


def test_mixing_against_plain_arithmetic(spark):
    r = random.Random(9)
    rows = [(k, "big" if k % 10 else "small" if k % 20 else None, r.randint(0, 50)) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    total = Counter()
    for _, s, t in rows:
        total[s] += t
    p = {s: t / sum(total.values()) for s, t in total.items()}
    entropy = lambda a: -sum(w * math.log(w) for w in ((x**a / sum(y**a for y in p.values())) for x in p.values()))
    low, high = 0.0, 8.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.9 else (low, mid)
    budget = 70_000
    weight = {s: x**low / sum(y**low for y in p.values()) for s, x in p.items()}
    out = mixing.mix(docs, tokens=F.col("tokens"), target_entropy=0.9, budget=budget)
    spent = {x["source"]: (x["t"], x["w"]) for x in out.groupBy("source").agg(F.sum("mix_tokens").alias("t"), F.max("mix_weight").alias("w")).collect()}
    for s in total:
        assert spent[s][1] == pytest.approx(weight[s], abs=1e-6)
        assert budget * weight[s] - 50 <= spent[s][0] <= budget * weight[s] + 1  # up to one document short
    n, own = drawn(out), {k: s for k, s, _ in rows}
    for s in total:  # epochs are whole: counts of one source differ by one at most
        counts = {n.get(k, 0) for k in own if own[k] == s}
        assert max(counts) - min(counts) <= 1


def test_mixing_limits(spark):
    docs = spark.createDataFrame([(1, "a", 10), (2, "b", 30), (None, "b", 30), (None, "b", 20), (4, None, 0)], "doc_id long, source string, tokens long")
    for wrong in (1.2, -0.1):
        with pytest.raises(ValueError, match="out of reach"):
            mixing.mix(docs, tokens=F.col("tokens"), target_entropy=wrong)
    with pytest.raises(ValueError, match="repetition limit"):
        mixing.mix(docs, tokens=F.col("tokens"), repetition_limit=2.0, budget=1000)
    assert mixing.mix(docs, tokens=F.col("tokens"), target_entropy=0.0, budget=80).filter("source = 'b'").count() == 3


def test_canonical_list(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.org:80/x"), (2, "https://a.org./x?q=1"), (3, "http://a.org/x/"), (4, "http://b.org"), (5, "http://u@b.org:443/#f"), (6, None), (7, "http://c.org/" + "p/" * 5000)], "page_id long, url string")
    listed = spark.createDataFrame([("http://a.org/x",), ("https://b.org/",), (None,), ("c.org/x",)], "url string")
    out = url_filter.url_filter(pages, url_filter.rule_table(spark, [("c.org/" + "p/" * 4000, "block")]), listed)
    assert {r["page_id"] for r in out.filter("verdict = 'block'").collect()} == {1, 2, 4, 5, 7} and out.count() == 7
    assert url_filter.url_filter(pages.limit(0), url_filter.rule_table(spark, []), listed).count() == 0


def test_bloom_filter(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert bloom.possible(keys, keys, 20_000).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert bloom.possible(others, keys, 20_000).count() < 400
    assert bloom.possible(keys, keys.limit(0), 0).count() == 0


def test_chat_branches(spark):
    r = random.Random(6)
    rows, want = [], {}
    for conv in range(40):
        nodes = {}
        for m in range(1, r.randint(1, 14)):
            parent = None if m == 1 or r.random() < 0.1 else m - 1 if conv % 3 == 0 else r.randrange(1, m)
            nodes[m] = (parent, float(r.randint(-3, 3)))
            rows.append((conv, m, parent, "user", "t" * (30_000 if m == 3 else 3), nodes[m][1], "extra"))
        up = lambda m: [*up(nodes[m][0]), m] if nodes[m][0] else [m]
        leaves = [m for m in nodes if m not in {p for p, _ in nodes.values()}]
        best = sorted(leaves, key=lambda m: (-sum(nodes[x][1] for x in up(m)), -len(up(m)), m))[:2]
        want |= {(conv, b + 1): up(m) for b, m in enumerate(best)}
    messages = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double, branch string")
    found = {}
    for x in chat_format.paths(messages, per_conversation=2).orderBy("depth").collect():
        found.setdefault((x["conv"], x["branch"]), []).append(x["msg"])
    assert found == want
    assert chat_format.digest(messages.select("conv_id", F.col("msg").alias("turn"), "role", "text").limit(0)).count() == 0


def test_salts(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("key"), util.salt_of("id").alias("salt"))
    groups = util.salted(rows.groupBy("key").agg(util.salts_seen(F.col("salt")).alias("salts"), F.count("*").alias("n")), "salts")
    assert rows.join(groups, ["key", "salt"]).count() == 1000 and groups.count() <= 3 * util.SALTS
