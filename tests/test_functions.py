"""Text, identifier, review and duplicate rules on literals."""

from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import dedupe, items, review


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_keys(spark):
    assert value(spark, tx.title_key(F.lit("Attention Is All You Need!"))) == "attention is all you need"
    assert value(spark, tx.doi_from(F.lit(None).cast("string"), F.lit("x\nDOI: 10.1/ABC \n"))) == "10.1/abc"
    assert value(spark, tx.isbn_keys(F.lit("0-262-03384-4, ISBN"))) == ["0262033844", "9780262033848"]
    assert value(spark, tx.year_key(F.lit("in press, 2019"))) == "2019"
    assert value(spark, tx.slug(F.lit("Wrong Outcome."))) == "wrong-outcome"
    assert value(spark, tx.identifier(F.lit("doi:10.1038/nature14539")))["value"] == "10.1038/nature14539"
    assert value(spark, tx.identifier(F.lit("978-0-262-03384-8")))["type"] == "isbn"


def test_html_text(spark):
    html = "<head><title>t</title></head><p>One&nbsp;&amp; two</p><script>x</script><div>&#233;&#x41; &zzz;</div>"
    assert value(spark, tx.html_text(F.lit(html))) == "One & two\n\néA &zzz;"


def test_csv_field(spark):
    for plain, field in (("a", "a"), ("a,b", '"a,b"'), ("=1", "\"'=1\""), ("-5", "-5"), ('q"', '"q"""')):
        assert value(spark, tx.csv_field(F.lit(plain))) == field


def test_quotations(spark):
    assert value(spark, tx.occurs_in_order(F.lit("one two three"), F.array(F.lit("one"), F.lit("three"))))
    assert not value(spark, tx.occurs_in_order(F.lit("one two three"), F.array(F.lit("three"), F.lit("one"))))


def test_screening(spark):
    rows = [
        ("A", ["screen/title-abstract/include@alice", "screen/title-abstract/include@bob", "screen/full-text/exclude:wrong-outcome"]),
        ("B", ["screen/title-abstract/include@alice", "screen/title-abstract/exclude:wrong-population@bob"]),
        ("C", ["screen/title-abstract/exclude:wrong-population"]),
        ("D", ["screen/title-abstract/include", "screen/full-text/include"]),
        ("E", ["screen/nonsense"]),
    ]
    records = spark.createDataFrame(rows, "key string, tags array<string>")
    result = review.outcomes(records)
    t = {r["stage"]: r for r in review.tally(result).collect()}
    assert [t["title-abstract"][c] for c in ("records", "include", "exclude", "conflict", "pending")] == [5, 2, 1, 1, 1]
    assert [t["full-text"][c] for c in ("records", "include", "exclude")] == [2, 1, 1]
    a = review.agreement(review.votes(records)).first()
    assert (a["a"], a["b"], a["both"], a["agreement"], a["kappa"]) == ("alice", "bob", 2, 0.5, 0)


def test_duplicate_tiers(spark):
    schema = "key string, itemType string, title string, DOI string, ISBN string, date string, extra string, creators array<struct<lastName:string,name:string>>"
    library = [("DOIONE1", "journalArticle", "Deep learning", "https://doi.org/10.1038/NATURE14539", None, "2015-05-27", None, None), ("ISBNONE", "book", "Pattern recognition", None, "978-0-387-31073-2", "2006", None, None), ("TITLEON", "preprint", "Attention Is All You Need!", None, None, "2017", None, None)]
    asked = [("a", None, "x", "10.1038/nature14539", None, None, None, None), ("b", "book", "y", None, "9780387310732", None, None, None), ("c", None, "attention is all you need", None, None, "2018-06", None, None), ("d", None, "attention is all you need", None, None, "2029", None, None)]
    found = dedupe.matches(*(dedupe.census(spark.createDataFrame(x, schema)) for x in (asked, library)))
    assert {(r["candidate"], r["key"], r["tier"]) for r in found.collect()} == {("a", "DOIONE1", "doi"), ("b", "ISBNONE", "isbn"), ("c", "TITLEON", "title")}


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "note", ["a"]), (2, "book", ["a", "b"]), (3, "annotation", ["c"])], "key int, itemType string, tags array<string>")
    keys = lambda **f: sorted(r["key"] for r in items.search(df, **f).collect())
    assert keys(tag="a || c") == [1, 2, 3]
    assert keys(tag="-a || b") == [1]
    assert keys(tag="a && b") == [2]


def test_item_search(spark):
    rows = [("A", "book", "On herons", "Smith", None, False), ("B", "book", "Lakes", "Lee", "herons live here", False), ("C", "note", "herons", None, None, True)]
    df = spark.createDataFrame(rows, "key string, itemType string, title string, creators string, text string, deleted boolean").withColumn("tags", F.array(F.lit("x")))
    found = lambda **k: {r["key"] for r in items.search(df, **k).collect()}
    assert found(text="heron") == {"A"} and found(text="here heron", everything=True) == {"B"} and found(text="smith") == {"A"}
    assert found(keys=["B", "C"]) == {"B"} and found(keys=["B", "C"], trashed=True) == {"B", "C"} and found(keys=[]) == set()
    assert found(tag=items.split_conjunction("x && -y")) == {"A", "B"} and found(tag=items.split_conjunction("x && y")) == set()


def test_field_twins(spark):
    pairs = {("sampleSize", "sample sizes"): True, ("n", "number"): True, ("sample size", "size of sample"): True, ("outcome", "method"): False, ("HTMLText", "text"): False, ("", "a"): True}
    for (a, b), same in pairs.items():
        assert value(spark, tx.is_twin(F.lit(a), F.lit(b))) == same, (a, b)


def test_markdown(spark):
    from quirelake.functions.markdown import note_html

    cases = {
        "# One\n\n## Two ##\nText *here*.\n\n---\n\nMore.": "<h1>One</h1>\n<h2>Two</h2>\n<p>Text <em>here</em>.</p>\n<hr>\n<p>More.</p>",
        "- a\n- **b** c\n\n1. x\n2) y": "<ul>\n<li>a</li>\n<li><strong>b</strong> c</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>",
        "> quoted **here**\n> and on\n\nafter": "<blockquote>\n<p>quoted <strong>here</strong>\nand on</p>\n</blockquote>\n<p>after</p>",
        "```ts\nif (a < b && c) {}\n\n  *x*\n```\nend": "<pre>if (a &lt; b &amp;&amp; c) {}\n\n  *x*</pre>\n<p>end</p>",
        "```\nnever closed": "<pre>never closed</pre>",
        "**b** *i* `c*d*` ~~s~~ [l](https://x.org/a_b_c) snake_case_name": '<p><strong>b</strong> <em>i</em> <code>c*d*</code> <span style="text-decoration: line-through">s</span> <a href="https://x.org/a_b_c">l</a> snake_case_name</p>',
        "<b>x</b> & [click](javascript:alert) \\*not em\\* a * b * c": "<p>&lt;b&gt;x&lt;/b&gt; &amp; click *not em* a * b * c</p>",
        "one  \ntwo\nthree": "<p>one<br>two\nthree</p>",
        "": "", "\n\n": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "md string")
    got = {r["md"]: r["h"] for r in df.select("md", note_html(F.col("md")).alias("h")).collect()}
    assert {k: got[k] for k, v in cases.items() if v is not None} == {k: v for k, v in cases.items() if v is not None}
