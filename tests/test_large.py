"""Rules for what one task can't hold: percentiles of large groups, files read in parts, and composed search forms."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirelake.functions import normal
from quirelake.functions import text as tx
from quirelake.operators import identifiers, retrieval, upkeep, usage
from quirelake.session import table
from quirelake.sources import bibliography, bibtex, split


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_nearest_rank(spark, sf_dir, monkeypatch):
    r = random.Random(1)
    rows = [("hot", r.choice([1.5, 1e-300, -1e300, 7.0, r.random(), r.random() * 1e6])) for _ in range(3000)] + [(None, float(k)) for k in range(11)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("none", None), ("some", None), ("some", -0.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: (x["a"], x["b"], x["c"]) for x in usage.nearest_rank(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0}).collect()}
    for k in {x[0] for x in rows}:
        own = sorted(v for key, v in rows if key == k and v is not None)
        want = [own[max(1, -(-len(own) * p // 100)) - 1] if own else None for p in (50, 95, 0)]
        assert got[k] == tuple(want), k
    events = usage.from_event_table(table(spark, sf_dir, "events"))
    plain = sorted(map(repr, usage.daily(events).collect()))
    monkeypatch.setattr(usage, "GROUP_ROWS", 2)
    assert sorted(map(repr, usage.daily(events).collect())) == plain
    one = events.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "name": F.lit("n"), "user_id": F.lit(1)})
    row = usage.daily(one).first()
    own = sorted(x["ms"] for x in events.select("ms").dropna().collect())
    assert (row["ms_p50"], row["ms_p95"]) == (own[-(-len(own) // 2) - 1], own[-(-len(own) * 95 // 100) - 1])


def bib_file(n):
    r, out = random.Random(4), ["A comment before all\n@string{acm = {ACM Press}}"]
    for k in range(n):
        if k % 97 == 0:
            out.append(f'@STRING(acm = "Press {k}")')
        out.append(f"@article{{k{k}, title = {{The {{\\'e}}t{{\\'e}} of {k}}}, publisher = acm # {{ & Co}}, month = mar, year = {1900 + k % 99}, author = {{Ann von Bee{k} and Cee, D.}}}}")
        if k % 50 == 7:
            out[-1] = out[-1][:-1] + ", abstract = {first\n@home and\n@work (told) }}"
        if k % 41 == 3:
            out[-1] += " @misc{x" + str(k) + ", title={same line}}"
        if k % 60 == 5:
            out.append("@book{open" + str(k) + ", title = {never closed")
        if r.random() < 0.1:
            out.append(f"  @misc{{, note = {{indented {k}}}}}")
    return "\n".join(out) + "\n"


def test_bibtex_in_parts(spark, tmp_path):
    text = bib_file(400)
    (tmp_path / "a.bib").write_text(text)
    (tmp_path / "b.bib").write_text("@article{only, month = feb, publisher = acm}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.option("lineSep", "\n@").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = split.read_bibtex(spark, str(tmp_path))
        got = got.select(F.element_at(F.split("doc", "/"), -1).alias("doc"), *got.columns[1:])
        whole = bibtex.read(spark.createDataFrame([("a.bib", text), ("b.bib", (tmp_path / "b.bib").read_text())], "doc string, text string"))
        assert same_rows(whole, got) and whole.count() > 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ris_in_parts(spark, tmp_path):
    text = "\n".join(f"TY  - JOUR\nTI  - Title {k}\n  goes on\nAU  - Bee{k}, Ann\nPY  - 2020/3//\n" + ("" if k % 9 == 4 else "ER  - \n") for k in range(300))
    (tmp_path / "a.ris").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = split.read_ris(spark, str(tmp_path))
        whole = bibliography.ris(spark.createDataFrame([("a.ris", text)], "doc string, text string"))
        got = got.select(F.element_at(F.split("doc", "/"), -1).alias("doc"), *got.columns[1:])
        assert [x["nth"] for x in got.orderBy("nth").collect()] == list(range(300))
        assert same_rows(whole.drop("warnings", "label"), got.drop("warnings", "label"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_composed(spark):
    r, texts = random.Random(1), [chr(k) for r in (range(0x20, 0xD800, 7), range(0xF900, 0x10000)) for k in r]
    marks, bases = [*map(chr, range(0x300, 0x370)), "़", "া", "゙"], "aeiouAEIOUnscéęǭṩ가각ᄀαωΑеиককেে"
    texts += ["".join(r.choice(bases) + "".join(r.choices(marks, k=r.randint(0, 3))) for _ in range(4)) for _ in range(3000)]
    texts += [unicodedata.normalize("NFD", "Théorie 한국어 Việt Ǖ ǣ"), "", "̈́"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for x in df.select("t", normal.composed(F.col("t")).alias("c")).collect():
        assert x["c"] == unicodedata.normalize("NFC", x["t"]), ascii(x["t"])


def test_searchable(spark):
    forms = {"Théorie": "théorie", "λόγος": "λόγοσ", "µm ſo": "μm so", "İstanbul": "İstanbul", "Ꭰb": "Ꭰb", "ʹ": "ʹ", "ǡ": "ǡ", "ÉCOLE": "école", "𐓀": "𐓀"}
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    assert {x["t"]: x["s"] for x in df.select("t", tx.searchable(F.col("t")).alias("s")).collect()} == forms


def test_identifiers(spark):
    text = "See https://doi.org/10.1000/AB(1).x, doi: 10.2000/c; [10.3000/d]. and arXiv:2101.00001v2, arxiv.org/abs/hep-th/9901001 (arXiv 2102.00002) 10.1 5/6 www.x.org/10.4000/e."
    rows = identifiers.scan(spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "doc int, page int, text string")).collect()
    got = {(x["type"], x["value"]): (x["confidence"], x["label"]) for x in rows}
    assert got["doi", "10.2000/c"] == ("high", "doi:") and got["doi", "10.3000/d"] == ("low", "") and got["arxiv", "2101.00001v2"][0] == "high"
    assert got["arxiv", "hep-th/9901001"][0] == got["arxiv", "2102.00002"][0] == "high" and got["doi", "10.1000/AB"][0] == "high"
    assert all(x["value"] in x["context"] for x in rows)


def test_build_in_steps(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    plan, path = {"embedder": "none", "backend": "tables", "total": 200, "version": 1}, f"{tmp_path}/stepped"
    index, read = upkeep.build_in_steps(docs, path, plan, steps=2, most=1)
    assert index is None and 0 < read < docs.count()
    index, rest = upkeep.build_in_steps(docs, path, plan, steps=2)
    assert read + rest == docs.count()  # what was kept isn't read again
    fresh = retrieval.build(docs, f"{tmp_path}/fresh")
    for name in ("terms", "lengths", "facts"):
        assert same_rows(fresh.read(name), index.read(name))
    index, read = upkeep.build_in_steps(docs, f"{tmp_path}/other", plan, steps=2, most=1)
    assert upkeep.build_in_steps(docs, f"{tmp_path}/other", plan | {"version": 2}, steps=2)[1] == docs.count()
    with pytest.raises(ValueError):
        upkeep.build_in_steps(docs, f"{tmp_path}/other", plan | {"embedder": "x"}, steps=2)


def test_merged_statistics(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = retrieval.build(docs, f"{tmp_path}/index")
    changed = docs.filter("id % 9 = 0").withColumn("text", F.concat(F.lit("Neuwort und "), F.col("text").substr(1, 40)))
    gone = docs.filter("id % 7 = 0").select("id")
    now = docs.filter("id % 9 <> 0").unionByName(changed).join(gone, "id", "left_anti")
    assert same_rows(retrieval.build(now, f"{tmp_path}/now").read("terms"), upkeep.merged_terms(index, changed, gone))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = retrieval.build_vectors(rows, f"{tmp_path}/vectors")
    other = rows.filter("id % 50 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    small, made = upkeep.refresh_vectors(index, f"{tmp_path}/small", other, rows.filter("id = 7").select("id"))
    assert made == other.count() and same_rows(index.read("mean"), small.read("mean"))
    assert same_rows(index.read("vectors").filter("id % 50 <> 0 and id <> 7"), small.read("vectors").filter("id % 50 <> 0"))
    large, made = upkeep.refresh_vectors(small, f"{tmp_path}/large", other.limit(0), rows.filter("id % 5 = 0").select("id"))
    fresh = retrieval.build_vectors(small.read("vectors").select("id", "vector").filter("id % 5 <> 0"), f"{tmp_path}/again")
    assert made == large.read("vectors").count() and all(same_rows(fresh.read(n), large.read(n)) for n in ("mean", "vectors", "pool"))
