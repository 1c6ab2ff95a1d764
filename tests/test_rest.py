"""Small rules that no query with SQL covers."""

import datetime
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quirelake.functions import chunks, vectors
from quirelake.operators import components, dedupe, extraction, graph, incremental, library, retrieval, review


def test_prisma(spark):
    flow = spark.createDataFrame([(10, None, 1, 8, 3, 2, 5, 4, 2, 0, 2)], "records_identified int, duplicates_removed int, duplicates_still int, records_screened int, records_excluded int, records_awaiting int, reports_sought int, reports_assessed int, reports_excluded int, reports_awaiting int, studies_included int")
    why = spark.createDataFrame([("full-text", "wrong-outcome", 2), ("full-text", "a", 2), ("title-abstract", "x", 9)], "stage string, reason string, n int")
    out = review.flow_text(flow, why).first()
    lines = out["text"].split("\n")
    assert lines[0] == "Records identified: n = 10" and lines[1].endswith("n = unknown") and lines[7:9] == ["  a (n = 2)", "  wrong outcome (n = 2)"]
    assert lines[-1] == "Not final: 2 record(s) still await title and abstract screening; 1 duplicate record(s) are still in the collection."
    assert out["diagram"].startswith("flowchart TD\n  id1[") and "<br/>a (n = 2)<br/>" in out["diagram"] and out["diagram"].count("-->") == 7


def test_resume_and_cursor():
    now = {"backend": "a", "total": 5, "version": 2, "embedder": "e"}
    assert incremental.resume_at(now | {"offset": 3}, now, 9) == 3 and incremental.resume_at(now | {"offset": 3, "total": 4}, now, 9) == 0
    assert incremental.resume_at(now | {"embedder": "x"}, now, 9) is None and incremental.resume_at(now, now, 0) is None
    assert incremental.next_cursor(5, 9, True) == 9 and incremental.next_cursor(5, 9, False) == 5 and incremental.next_cursor(5, 3, True) == 5
    assert incremental.drifted(100, 111) and not incremental.drifted(100, 110) and incremental.drifted(0, 1)


def test_rescreened(spark):
    tags = F.array(*map(F.lit, ["screen/full-text/include@ann", "screen/full-text/include", "other"]))
    got = spark.range(1).select(review.rescreened(tags, "full-text", "ann", "screen/full-text/exclude@ann").alias("x")).first()["x"]
    assert got == ["screen/full-text/include", "other", "screen/full-text/exclude@ann"]


def test_annotatable(spark):
    rows = spark.createDataFrame([("a", "application/pdf", "imported_file"), ("b", "text/html", "linked_url"), ("c", "image/png", "x")], "key string, contentType string, linkMode string")
    assert [r["key"] for r in library.annotatable(rows).collect()] == ["a"]


def test_damaged_notes(spark):
    good = '{"extraction":1,"schema":"s","fields":[{"name":"a","value":true},{"name":"b"}]}'
    notes = [(1, f"<pre>{{broken</pre><pre>{good}</pre>"), (2, good), (3, "<pre>" + good.replace(":1,", ":2,") + "</pre>"), (4, None)]
    rows = extraction.extractions(spark.createDataFrame([(k, 9, n, False) for k, n in notes], "key int, parentItem int, note string, deleted boolean")).collect()
    assert [(r["noteKey"], [(f["name"], f["value"]) for f in r["fields"]]) for r in rows] == [(1, [("a", "true")])]


def test_vectors(spark):
    v = spark.range(300).select("id", vectors.test_vector(F.col("id").cast("string"), 32).alias("vector"))
    uneven = v.union(spark.createDataFrame([(900, [1.0] * 40), (901, []), (902, None)], "id long, vector array<float>"))
    asked = v.filter("id < 5")
    out = retrieval.nearest(uneven, asked, 3).filter("rank = 1").collect()
    assert {(r["query"], r["id"]) for r in out} == {(k, k) for k in range(5)} and all(r["score"] == 1 or abs(r["score"] - 1) < 1e-6 for r in out)


def test_two_stage_pool(spark, tmp_path):
    """The pool counts ties at its edge in, and a small one gives a part of the exact result."""
    v = spark.range(2000).select("id", vectors.test_vector(F.col("id").cast("string"), 64).alias("vector"))
    index = retrieval.build_vectors(v, str(tmp_path / "index"))
    asked = index.read("vectors").filter("id % 50 = 0")
    exact = {(r["query"], r["id"]) for r in retrieval.nearest(v, v.filter("id % 50 = 0"), 10).collect()}
    found = {(r["query"], r["id"]) for r in retrieval.two_stage(index, asked, 10).collect()}
    few = {(r["query"], r["id"]) for r in retrieval.two_stage(index, asked, 10, pool=60).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(exact & few) < len(exact & found) and len(few) == len(exact)


def test_refresh_and_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, "heron lake"), (2, "heron"), (3, None)], "id long, text string")
    index = retrieval.build(rows, str(tmp_path / "a"))
    new = retrieval.refresh(index, str(tmp_path / "b"), spark.createDataFrame([(2, "pond heron heron")], "id long, text string"), spark.createDataFrame([(1,)], "id long"))
    assert {(r["term"], r["df"], r["cf"]) for r in new.read("terms").collect()} == {("heron", 1, 2), ("pond", 1, 1)} and new.facts() == (2, 1.5)
    rows.write.parquet(str(tmp_path / "t"))
    made = []
    for _ in range(2):
        source = spark.read.parquet(str(tmp_path / "t"))
        got = retrieval.kept("test", source, lambda path: made.append(path) or retrieval.build(source, path))
        assert {r["id"] for r in retrieval.bm25(got, "lake").collect()} == {1}
    assert len(made) == 1


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40) if k % 10] + [(100, k) for k in range(101, 160)]
    out = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(out[k] == (k - 1) // 10 * 10 + 1 for k in range(1, 41)) and all(out[k] == 100 for k in range(100, 160))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_snippet_column(spark):
    text = "word " * 80 + "heron " + "more " * 80
    got = spark.range(1).select(chunks.snippet(F.lit(text), ["heron"]).alias("x")).first()["x"]
    assert "heron" in got and len(got) <= 246


def test_dates_and_links(spark):
    row = spark.range(1).select(graph.iso_date(F.array(F.lit(2020), F.lit(3))).alias("d"), graph.page_range(F.lit("5"), F.lit("5")).alias("p")).first()
    assert (row["d"], row["p"]) == ("2020-03", "5") and datetime.date.fromisoformat(row["d"] + "-01")


def test_title_matches_against_all_pairs(spark):
    """Years within one, or a long title or a shared surname where a year is missing; surnames with blanks, several shared ones."""
    r = random.Random(11)
    names = ["berg", "van berg", "lee", "ng"]
    items = [
        (k, "book", r.choice(["on", "on rivers", "on the rivers of asia"]), r.choice([None, "10.1/a", "10.1/b"] if k % 3 == 0 else [None]), r.choice([None, "1999", "2000", "2001", "2003"]), r.sample(names, r.randrange(3)))
        for k in range(90)
    ]
    schema = "key int, itemType string, title string, title_key string, doi string, isbns array<string>, year string, surnames array<string>"
    rows = spark.createDataFrame([(k, i, t, t, d, [], y, n) for k, i, t, d, y, n in items], schema)
    want = set()
    for a in items:
        tiers = {"doi": set(), "title": set()}
        for b in items:
            if a[0] == b[0]:
                continue
            if a[3] and a[3] == b[3]:
                tiers["doi"].add((a[0], b[0], None))
            elif a[2] == b[2] and not (a[3] and b[3]):
                shared = next((n for n in a[5] if n in b[5]), None)
                if a[4] and b[4]:
                    if abs(int(a[4]) - int(b[4])) <= 1:
                        tiers["title"].add((a[0], b[0], None))
                elif shared or len(a[2].split()) >= 4:
                    lacks = "neither has a year" if not a[4] and not b[4] else "the candidate has no year" if not a[4] else "the item has no year"
                    tiers["title"].add((a[0], b[0], lacks + ("; shared surname " + shared if shared else "; title alone")))
        want |= tiers["doi"] or tiers["title"]
    got = [(r["candidate"], r["key"], r["caveat"]) for r in dedupe.matches(rows, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_scores_stay_equal(spark):
    """10 of 115 words and 4 of 28 have one score where a passage has 90 on the average; the smaller id comes first."""
    counts = [(2, 27), (6, 133), (3, 21), (10, 115), (4, 28), (20, 282), (0, 24)]
    c = spark.createDataFrame([(1, k, "the " * n + "word " * (m - n)) for k, (n, m) in enumerate(counts)], "doc long, id long, text string")
    ranked = retrieval.rank_within(c, "the", 3).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [3, 4, 5] and ranked[0]["score"] == ranked[1]["score"]


def test_passages_cut_in_slices():
    """A batch of many texts takes memory for a slice of them, with the same passages."""
    r = random.Random(3)
    texts = pa.array([None, "", "x" * 3000] + [" ".join(r.choice(["heron", "lake", "é"]) for _ in range(r.randrange(4000))) for _ in range(400)])
    assert all(chunks._sliced(texts.slice(k), 512, 64, words).equals(chunks._listed(texts.slice(k), 512, 64, words)) for words in (True, False) for k in (0, 2, 403))
    whole = pa.array(texts.to_pylist() * 5)
    tracemalloc.start()
    chunks._sliced(whole, 512, 64, True)
    assert tracemalloc.get_traced_memory()[1] < 12 * whole.nbytes
    tracemalloc.stop()


def test_doi_links_give_the_groups_of_the_matches(spark):
    """The same groups from one link a row, whatever rows are candidates, library or both; a row alone has none."""
    r = random.Random(5)
    schema = "key int, itemType string, title string, title_key string, doi string, isbns array<string>, year string, surnames array<string>"
    rows = spark.createDataFrame([(k, "book", None, None, r.choice(["a", "b", "c", "d", None]) if k < 40 else f"x{k // 2}", [], None, []) for k in range(60)], schema)
    c, e = rows.filter("key % 3 < 2 and key <> 58"), rows.filter("key % 5 > 0")
    items = rows.selectExpr("key", "0 as numChildren", "'2000' as dateAdded")
    linked = dedupe.doi_links(c, e)
    of = lambda found: sorted(map(tuple, dedupe.groups(found, items).collect()))
    assert of(linked) == of(dedupe.matches(c, e)) and linked.count() < rows.count()


def test_link_counts_are_those_of_the_matches(spark):
    """As many links a row as matches() gives pairs, by DOI, ISBN and title, with rows in one table or both."""
    r = random.Random(7)
    schema = "key int, itemType string, title string, title_key string, doi string, isbns array<string>, year string, surnames array<string>"
    pick = lambda: (r.choice(["book", "bookSection"]), "t", r.choice(["on", "on the rivers of", None]), r.choice([None, None, "a", "b"]), r.sample(["1", "2", "3"], r.choice([0, 0, 1, 2])), r.choice([None, "1999", "2000", "2002"]), r.sample(["lee", "ng"], r.randrange(3)))
    rows = spark.createDataFrame([(k, *pick()) for k in range(150)], schema)
    c, e = rows.filter("key % 3 < 2"), rows.filter("key % 4 > 0")
    want = dedupe.matches(c, e).groupBy("candidate", "tier").agg(F.count("*").alias("links"), F.count("caveat").alias("caveats"))
    got = dedupe.link_counts(c, e).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_class_links_give_every_match(spark):
    """The matches between classes, with their members put in, are those of matches(), and links counts them."""
    r = random.Random(11)
    schema = "key int, itemType string, title string, title_key string, doi string, isbns array<string>, year string, surnames array<string>"
    pick = lambda: (r.choice(["book", "bookSection"]), "t", r.choice(["on", "on the rivers of", None]), r.choice([None, None, "a", "b"]), r.choice([[], [], ["1"], ["2", "1"]]), r.choice([None, "1999", "2000", "2002"]), r.choice([[], ["lee"], ["ng", "lee"]]))
    rows = spark.createDataFrame([(k, *pick()) for k in range(120)] + [(900, "book", "t", "alone", "z", [], None, [])], schema)
    facts = ["itemType", "title_key", "doi", "isbns", "year", "surnames"]
    own, found = dedupe.classes(rows, facts), dedupe.class_links(rows, facts)
    both = found.join(own.select("class_id", "candidate"), "class_id").join(own.select(F.col("class_id").alias("key"), F.col("candidate").alias("other")), "key").filter("candidate <> other")
    want = dedupe.matches(rows, rows)
    got = both.select("candidate", F.col("other").alias("key"), "tier", "value", "caveat")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert both.groupBy("candidate", "key").agg(F.count("*").alias("n"), F.max("links").alias("links")).filter("n <> links").isEmpty()
