"""Listings, own words, extraction tables, identifiers and bibliographies, over orders and lines standing in for a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import components, extraction, identifiers, incremental, items, library, retrieval, review
from ..session import table
from ..sources import bibliography, bibtex
from .retrieval import _scores, document_index

#: Lines of an order by number: the fixed kinds of its children.
KINDS = ["attachment", "note", "annotation", "note", "annotation", "attachment", "note"]
COLLECTION, PARENT = 7, 100


def _kind(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), n)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: the customer as collection, the day as version, partly shipped ones in the trash."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "5-LOW", "note").otherwise("book").alias("itemType"),
        F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")).alias("title"), F.lit(None).cast("long").alias("parentItem"), F.array("o_custkey").alias("collections"),
        F.array("o_orderpriority").alias("tags"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("version"), (F.col("o_orderstatus") == "P").alias("deleted"),
        F.lit(None).cast("string").alias("text"),
    )


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as children, the first of its number in an order; annotations hang on the order's first attachment if it has one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_returnflag").alias("flag"), F.min("l_shipdate").alias("ship"))
    key = F.col("l_orderkey") * -10 - F.col("l_linenumber")
    first = lines.filter("l_linenumber = 1").select("l_orderkey", F.lit(True).alias("has"))
    kind = _kind(F.col("l_linenumber"))
    both = lines.join(first, "l_orderkey", "left")
    parent = F.when((kind == "annotation") & F.col("has"), F.col("l_orderkey") * -10 - 1).otherwise(F.col("l_orderkey"))
    return both.select(
        key.alias("key"), kind.alias("itemType"), F.lit("").alias("title"), parent.alias("parentItem"), F.array().cast("array<long>").alias("collections"), F.array("flag").alias("tags"),
        F.datediff("ship", F.lit("1970-01-01")).alias("version"), (F.col("flag") == "A").alias("deleted"), F.concat(F.lit("Part "), F.col("part").cast("string"), F.lit(" of "), F.col("supp").cast("string")).alias("text"),
    )


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).unionByName(_children(spark, sf_dir))


def item_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 30 books of one word in the title, newest first, with totals and the next start."""
    found = items.search(_orders(spark, sf_dir), tag="-1-URGENT", item_type="book", text="order of 1", top=True, since=9000)
    return library.listing(found, "version", descending=True, start=30, limit=30).select("key", "version", "total", "library_version", "next_start")


def item_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of one order, and the order itself as a point lookup."""
    own = _all(spark, sf_dir)
    return library.children(own, PARENT, "note").select("key", "itemType").union(library.one(own, PARENT).select("key", "itemType"))


def collection_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.crawl(_orders(spark, sf_dir), COLLECTION).select("key", "skipped")


def census_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.capped_census(_all(spark, sf_dir), 5000).select("key", "complete")


def scope_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a collection, and the ones of a key list, that are in both lists or one, with how many named them."""
    o = _orders(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("key"))
    listed, own = library.scope(o, wanted), library.scope(o, collection=COLLECTION)
    both = library.intersect(library.keys(listed), library.keys(o.filter("itemType = 'book'")))
    return both.unionByName(library.keys(own)).groupBy("key").agg(F.count("*").alias("lists"))


def collection_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return library.collection_listing(c, start=40, limit=40)


def trash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.across_trash(_orders(spark, sf_dir), F.array_contains("tags", "2-HIGH") & (F.col("version") > 10000)).select("key", "trashed")


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's notes and annotations, 30 characters of them."""
    return library.own_words(_all(spark, sf_dir), 30)


def full_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _children(spark, sf_dir)
    return library.full_text(c, c.select("key", F.concat("text", F.lit("."), "title").alias("content")), 40_000)


def child_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of children changed since a day, the parent's children counted."""
    v = library.child_versions(_all(spark, sf_dir))
    return incremental.changed(v, 10_500).join(v, ["key", "version"]).groupBy("parentItem").agg(F.count("*").alias("n"), F.max("version").alias("version"))


def item_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records, with title fallbacks, authors and year."""
    s = table(spark, sf_dir, "supplier")
    person = "array<struct<lastName:string,firstName:string,name:string>>"
    own = s.select(
        F.col("s_suppkey").alias("key"), F.lit("book").alias("itemType"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("title"), F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("Case "), "s_name")).alias("caseName"),
        F.concat(F.lit("in "), (F.col("s_nationkey") + 1990).cast("string")).alias("date"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
        F.array(F.struct(F.col("s_name").alias("lastName"), F.when(F.col("s_suppkey") % 2 == 0, "Ann").alias("firstName"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("").alias("lastName"), F.lit(None).cast("string").alias("firstName"), F.lit("Org").alias("name"))).cast(person).alias("creators"),
    )
    return library.project(own, detailed=True).withColumn("authors", F.array_join("authors", "; "))


def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yellow or blue annotations with one of two tags, in reading order, with each attachment's number."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("part"))
    hexes = F.element_at(F.array(*map(F.lit, ("#FFD400", "#ff6666", "2ea8e5"))), (F.col("part") % 3 + 1).cast("int"))
    rows = lines.select(F.col("l_orderkey").alias("attachment"), F.col("l_linenumber").alias("key"), F.lit("Highlight").alias("kind"), hexes.alias("color"), F.array("flag").alias("tags"), F.col("part").alias("sortIndex"))
    return library.annotation_digest(library.annotations(rows, ["highlight"], ["Yellow", "#2EA8E5"], ["a", "R"])).select("attachment", "key", "nth", "annotations")


def annotation_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the annotations of one attachment, as an HTML note."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    rows = lines.select(F.col("l_orderkey").alias("attachment"), F.lit("A & B").alias("title"), F.col("part").alias("sortIndex"), F.col("l_linenumber").alias("key"), F.concat(F.lit("<"), F.col("part").cast("string")).alias("text"), F.when(F.col("part") % 2 == 0, "c").alias("comment"), F.col("l_linenumber").cast("string").alias("page"))
    return library.digest_html(rows)


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that parts are found by, in the order of a reading queue."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), "p_brand", "p_type", "p_size")
    queue = library.queue_order(p).limit(100)
    return queue.select("key", library.item_text({"title": F.col("title"), "abstractNote": F.lit(""), "surnames": F.col("p_brand"), "tags": F.col("p_type"), "date": F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))}).alias("text"))


def generic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search that the index answers, and one for a part of a name that only titles have."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("Document N-"), F.col("doc_id").cast("string")).alias("title"))
    index = document_index(spark, sf_dir)
    both = retrieval.find(index, docs, "heron eaux", digits=6), retrieval.find(index, docs, "t N-1")
    return both[0].union(both[1]).withColumn("score", F.round("score", 6))


def text_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments whose text is newer than a day, that are indexed, and that no delta has taken already."""
    c = _children(spark, sf_dir).filter("itemType = 'attachment'").withColumn("textVersion", F.col("version"))
    return incremental.full_text_targets(c, c.filter("not deleted"), c.filter("key % 2 = 0"), 10_500)


def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items whose type and size are fields: brands 1 to 9 know only the type, and no part's maker may be a translator."""
    p = table(spark, sf_dir, "part")
    own = p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("itemType"), F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")).alias("fields"), F.array(F.when(F.col("p_size") % 7 == 0, "translator").otherwise("author")).alias("creatorTypes"))
    brands = p.select(F.col("p_brand").alias("itemType")).distinct()
    known = brands.select("itemType", F.explode(F.when(F.length("itemType") == 7, F.array(F.lit("type"))).otherwise(F.array(F.lit("type"), F.lit("size")))).alias("name"))
    return library.validate(own, known, brands.select("itemType", F.lit("author").alias("name")))


def top_of_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by the record at the top of their chain, up to three hops."""
    own = _all(spark, sf_dir)
    top = items.to_top(own.filter("parentItem is not null").select("key", "parentItem"), own.select("key", "parentItem"))
    return top.groupBy("top").agg(F.count("*").alias("children"))


def document_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    own = d.select(F.col("doc_id").alias("key"), F.lit("").alias("title"), F.col("lang").alias("itemType"), F.col("source").alias("date"))
    return library.fetch(own, d.select(F.col("doc_id").alias("key"), F.col("text").alias("content")), 5, 400).select("key", "title", F.md5("text").alias("text_md5"), "cut")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes with an extracted record: the customer is the paper, the priority the schema."""
    o = table(spark, sf_dir, "orders")
    entry = lambda name, value: F.concat(F.lit(f'{{&quot;name&quot;:&quot;{name}&quot;,&quot;value&quot;:'), value, F.lit("}"))
    size = F.concat(F.lit("&quot;a &lt; b"), (F.col("o_orderkey") % 10).cast("string"), F.lit("&quot;,&quot;quote&quot;:&quot;q&quot;,&quot;check&quot;:&quot;"), F.when(F.col("o_orderkey") % 2 == 0, "verified").otherwise("not-found"), F.lit("&quot;"))
    fields = F.concat_ws(",", F.when(F.col("o_orderkey") % 4 != 0, entry("size", size)), entry("kind", F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit(""))))
    json = F.concat(F.lit("{&quot;extraction&quot;:1,<br>&quot;schema&quot;:&quot;"), F.substring("o_orderpriority", 1, 1), F.lit("&quot;,&quot;updated&quot;:&quot;"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("&quot;,&quot;fields&quot;:["), fields, F.lit("]}"))
    note = F.concat(F.lit("<p>a note</p><pre>none</pre><pre class='x'><code>"), json, F.lit("</code></pre>"))
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("parentItem"), F.when(F.col("o_orderkey") % 9 != 0, note).otherwise("<p>other</p>").alias("note"), (F.col("o_orderstatus") == "P").alias("deleted"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.newest(extraction.extractions(_notes(spark, sf_dir)))


def extraction_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda n: extraction.value_of(n)["value"]
    return _rows(spark, sf_dir).select("parentKey", "schema", "noteKey", "updated", v("size").alias("size"), v("kind").alias("kind"))


def extraction_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.columns(_rows(spark, sf_dir))


def extraction_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a record of schema 1, and rows that lack a field."""
    rows = _rows(spark, sf_dir).filter("schema = '1'")
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    lacking = extraction.missing_fields(rows, ["size", "kind"]).filter(F.size("missing") > 0).select(F.col("parentKey").alias("key"), F.array_join("missing", ",").alias("missing"))
    return extraction.missing(papers, rows).select("key", F.lit("all").alias("missing")).unionByName(lacking)


def extraction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema 1 as lines of a Markdown and of a CSV table."""
    c = table(spark, sf_dir, "customer")
    study = extraction.study_label(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 3 == 1, F.lit("2001")), F.when(F.col("c_custkey") % 2 == 0, F.lit("=Title|x")), F.col("c_custkey").cast("string"))
    rows = _rows(spark, sf_dir).filter("schema = '1'").join(c.select(F.col("c_custkey").alias("parentKey"), study.alias("study"), F.lit("=t").alias("title")), "parentKey")
    md, csv = extraction.markdown_rows(rows, ["size", "kind"]), extraction.csv_rows(rows, ["size"])
    return md.withColumnRenamed("line", "markdown").join(csv.withColumnRenamed("line", "csv"), "parentKey")


def extraction_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.quote_counts(_rows(spark, sf_dir))


def extraction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as held and given fields of an order: the part's number as name, returned ones removed."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("f"), (F.col("l_partkey") % 4).cast("string")).alias("name"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("place"), "l_returnflag", F.col("l_quantity").cast("string").alias("value"), "l_suppkey")
    one = lines.groupBy("key", "name", "l_suppkey", "place").agg(F.min("value").alias("value"), F.min("l_returnflag").alias("flag"))
    held = one.filter("l_suppkey % 2 = 0").select("key", "place", "name", "value")
    given = one.filter("l_suppkey % 2 = 1").select("key", "place", "name", F.when(F.col("flag") != "R", F.col("value")).alias("value"))
    first = lambda df: df.groupBy("key", "name").agg(F.min_by(F.struct("place", "value"), F.struct("place", F.coalesce("value", F.lit("")))).alias("x")).select("key", "name", "x.*")
    return extraction.merge_fields(first(held), first(given)).select("key", "name", "value", "change", "place")


def identifiers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best occurrence of every DOI and arXiv id in pages, documents, and a sentence made of each part; parts are dealt to all tasks."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    made = F.concat(F.lit("As shown (doi: 10.1234/p."), n, F.lit("), and in 10.5555/Q"), (F.col("p_partkey") % 50).cast("string"), F.lit("; see arXiv:2101."), F.lpad((F.col("p_partkey") % 700).cast("string"), 5, "0"), F.lit("v2."))
    texts = [
        p.select("p_partkey").repartition(components.tasks(p), "p_partkey").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), made.alias("text")),
        table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.lit(2).alias("page"), F.col("html").alias("text")),
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(3).alias("page"), "text"),
    ]
    return identifiers.best(identifiers.scan(texts[0].union(texts[1]).union(texts[2]))).select("type", "value", "doc", "page", "label", "confidence", "hits")


def ris_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as RIS, one file for each size, and read back."""
    p = table(spark, sf_dir, "part")
    one = F.concat_ws("\n", F.lit("TY  - JOUR"), F.concat(F.lit("TI  - "), "p_name"), F.concat(F.lit("  of "), "p_brand"), F.concat(F.lit("AU  - "), "p_type", F.lit(", "), "p_brand"), F.concat(F.lit("PY  - "), (F.col("p_size") + 1950).cast("string"), F.lit("/3//")), F.lit("KW  - a; b"), F.concat(F.lit("ID  - p"), F.col("p_partkey").cast("string")), F.lit("SP  - 1\nEP  - 9\nER  - "))
    files = p.select("p_partkey", F.col("p_size").alias("doc"), one.alias("one")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "one"))), lambda x: x["one"]), "\n\n").alias("text"))
    r = bibliography.ris(files.filter(bibliography.sniff(F.col("text")) == "ris"))
    return _flat(r)


def bibtex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as BibTeX, one file for each nation, and read back."""
    s = table(spark, sf_dir, "supplier")
    one = F.concat(F.lit("@article{s"), F.col("s_suppkey").cast("string"), F.lit(", title = {The {\\'e}t{\\'e} of "), "s_name", F.lit("}, author = {Ann von "), "s_name", F.lit(" and {Org}}, year = "), (F.col("s_nationkey") + 1990).cast("string"), F.lit(", month = mar, keywords = {a, b}, pages = {1--9}}"))
    files = s.select("s_suppkey", F.col("s_nationkey").alias("doc"), one.alias("one")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "one"))), lambda x: x["one"]), "\n").alias("text"))
    return _flat(bibtex.read(files))


def csl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSL-JSON, one file for each nation, and read back."""
    c = table(spark, sf_dir, "customer")
    name = F.struct(F.col("c_mktsegment").alias("family"), F.lit("A").alias("given"))
    one = F.to_json(F.struct(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("book").alias("type"), F.col("c_name").alias("title"), F.array(name).alias("author"), F.struct(F.array(F.array(F.col("c_nationkey") + 1990, F.lit(3))).alias("date-parts")).alias("issued"), F.lit("a, b").alias("keyword"), F.lit("1-9").alias("page")))
    files = c.select("c_custkey", F.col("c_nationkey").alias("doc"), one.alias("one")).groupBy("doc").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "one"))), lambda x: x["one"]), ","), F.lit("]")).alias("text"))
    return _flat(bibliography.csl_json(files))


def _flat(records: DataFrame) -> DataFrame:
    f = F.col("fields")
    who = F.transform("creators", lambda c: F.concat_ws("|", c["cslName"], c["family"], c["given"], c["literal"]))
    return records.select("doc", "nth", "label", "cslType", f["title"].alias("title"), f["issued"].alias("issued"), f["page"].alias("page"), F.array_join(who, ";").alias("creators"), F.array_join("tags", ";").alias("tags"), F.size("warnings").alias("n_warnings"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as records with two reviewers' votes and some final tags."""
    from .library import _records as made

    return made(spark, sf_dir)


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the team and one reviewer have still to decide on title and abstract, and records with tags that can't be read."""
    r = _records(spark, sf_dir)
    result = review.outcomes(r)
    parts = [review.awaiting(r, result, review.STAGES[0]).withColumn("why", F.lit("team")), review.awaiting(r, result, review.STAGES[1], "bob").withColumn("why", F.lit("bob")), r.filter(F.exists("tags", review.malformed)).select("key", F.lit("malformed").alias("why"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def reviewer_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    v = review.votes(r)
    return review.by_reviewer(review.in_population(v, review.outcomes(r)))


def review_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = review.votes(_records(spark, sf_dir))
    said = F.array_join(F.transform("decisions", lambda d: F.concat(d["reviewer"], F.lit(":"), d["decision"])), ",")
    return review.disagreements(v).select("key", "stage", said.alias("decisions"), "resolved")


def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons by number, then name."""
    r = _records(spark, sf_dir)
    return review.reasons(review.outcomes(r)).orderBy(F.desc("n"), "reason")


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence rows: how many of each coverage break a rule."""
    line = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "4").alias("page"), F.when(F.col("l_partkey") % 3 == 0, "q").alias("quotation"), F.element_at(F.array(F.lit("passage"), F.lit("abstract"), F.lit("unavailable")), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("coverage"), F.when(F.col("l_returnflag") == "R", "unverified").otherwise("supports").alias("support"))
    return extraction.coverage_counts(line, review.evidence_flags())


def sync_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and deletions by type since a day: orders and lines as objects, trashed orders as tombstones."""
    own = _all(spark, sf_dir)
    objects = own.filter("not deleted").select(F.col("itemType").alias("type"), "key", "version")
    gone = own.filter("deleted").select(F.col("itemType").alias("type"), "key", "version")
    return incremental.sync_report(objects, gone, 10_000)


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders held by an index, with those changed since a day taken anew (first copy of a key) and the trashed ones left out."""
    o = _orders(spark, sf_dir).select("key", "version", "deleted")
    delta = incremental.first_copy(o.filter("version > 10000").union(o.filter("version > 10000")).withColumn("mark", F.lit("new")), ["key"], "version").drop("deleted")
    return incremental.upsert(o.select("key", "version", F.lit("old").alias("mark")), delta, o.filter("deleted").select("key"))


def stale_own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to index again: a held child is gone or newer."""
    live = library.live(_children(spark, sf_dir)).select(F.col("parentItem").alias("item"), F.col("key").alias("child"), "version")
    held = _children(spark, sf_dir).filter("itemType = 'note'").select(F.col("parentItem").alias("item"), F.col("key").alias("child"))
    return incremental.own_words_changed(held, live, 10_900)


def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is as before keep their vector; the others, and new ones, wait for one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    old = d.select("id", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    kept = incremental.reused_vectors(d, old, vectors)
    return kept.select("id", F.lit("kept").alias("state")).unionByName(incremental.without_vector(d, kept).select("id", F.lit("waits").alias("state")))


QUERIES = {f.__name__: f for f in (item_listing, item_children, collection_crawl, census_capped, scope_gather, collection_page, trash_matches, own_words, full_text_source, child_versions, item_projection, annotation_filter, annotation_digest, item_texts, generic_search, text_catch_up, schema_validation, top_of_children, document_fetch, extraction_newest, extraction_columns, extraction_missing, extraction_table, extraction_quotes, extraction_merge, identifiers_in_text, ris_records, bibtex_records, csl_records, review_queue, reviewer_matrix, review_disagreements, exclusion_reasons, evidence_coverage, sync_feed, index_upsert, stale_own_words, vector_reuse)}

_KIND = f"{KINDS!r}[l_linenumber]"
_O = "o AS (SELECT *, o_orderdate::DATE - DATE '1970-01-01' AS version, CASE WHEN o_orderpriority = '5-LOW' THEN 'note' ELSE 'book' END AS kind FROM orders)"
_L = f"""ln AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS flag, min(l_shipdate)::DATE - DATE '1970-01-01' AS version FROM lineitem GROUP BY ALL),
    ch AS (SELECT l_orderkey * -10 - l_linenumber AS key, {_KIND} AS kind, l_orderkey AS item, flag, version, 'Part ' || part || ' of ' || supp AS text,
        CASE WHEN {_KIND} = 'annotation' AND EXISTS (SELECT 1 FROM ln f WHERE f.l_orderkey = ln.l_orderkey AND f.l_linenumber = 1) THEN l_orderkey * -10 - 1 ELSE l_orderkey END AS parent FROM ln)"""
_X = """x AS (SELECT o_custkey AS parentKey, o_orderpriority[1] AS schema, o_orderkey AS noteKey, strftime(o_orderdate, '%Y-%m-%d') AS updated,
        CASE WHEN o_orderkey % 4 <> 0 THEN 'a < b' || (o_orderkey % 10) END AS size, (o_orderkey % 5)::VARCHAR AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'verified' ELSE 'not-found' END AS chk
        FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority[1] ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey DESC) = 1)"""
_V = """v AS (SELECT doc_id AS key, quality, toxic, quality = 1 AS a, toxic = 0 AS b FROM labels WHERE doc_id IS NOT NULL),
    ta AS (SELECT *, CASE WHEN key % 7 = 0 THEN 'maybe' WHEN a <> b THEN 'conflict' WHEN a THEN 'include' ELSE 'exclude' END AS o FROM v)"""

ORACLE = {
    "item_listing": f"""WITH {_O}, f AS (SELECT o_orderkey AS key, version FROM o WHERE o_orderpriority <> '1-URGENT' AND kind = 'book' AND contains('order of ' || o_custkey, 'order of 1') AND version > 9000 AND o_orderstatus <> 'P')
        SELECT key, version, count(*) OVER () AS total, max(version) OVER () AS library_version, CASE WHEN count(*) OVER () > 60 THEN 60 END AS next_start FROM f ORDER BY version DESC, key LIMIT 30 OFFSET 30""",
    "item_children": f"WITH {_L} SELECT key, kind AS \"itemType\" FROM ch WHERE parent = {PARENT} AND kind = 'note' UNION ALL SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'note' ELSE 'book' END FROM orders WHERE o_orderkey = {PARENT}",
    "collection_crawl": f"WITH {_O} SELECT o_orderkey AS key, (SELECT count(*) FROM o WHERE o_custkey = {COLLECTION} AND (o_orderstatus = 'P' OR kind = 'note')) AS skipped FROM o WHERE o_custkey = {COLLECTION} AND o_orderstatus <> 'P' AND kind = 'book'",
    "census_capped": f"WITH {_O}, t AS (SELECT o_orderkey AS key FROM o WHERE o_orderstatus <> 'P' AND kind = 'book') SELECT key, (SELECT count(*) FROM t) <= 5000 AS complete FROM t ORDER BY key LIMIT 5000",
    "scope_gather": f"""WITH {_O}, n AS (SELECT o_orderkey AS key FROM o WHERE kind = 'book' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
            UNION ALL SELECT o_orderkey FROM o WHERE o_custkey = {COLLECTION}) SELECT key, count(*) AS lists FROM n GROUP BY key""",
    "collection_page": "SELECT c_custkey AS key, c_name AS name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 40 OFFSET 40",
    "trash_matches": f"WITH {_O} SELECT o_orderkey AS key, o_orderstatus = 'P' AS trashed FROM o WHERE o_orderpriority = '2-HIGH' AND version > 10000",
    "own_words": f"""WITH {_L}, w AS (SELECT item, key, text FROM ch WHERE kind IN ('note', 'annotation') AND flag <> 'A')
        SELECT item, substr(string_agg(text, chr(10) || chr(10) ORDER BY key), 1, 30) AS text FROM w GROUP BY item""",
    "full_text_source": f"WITH {_L} SELECT item, string_agg(text || '.', chr(10) || chr(10) ORDER BY key) AS text FROM ch WHERE kind = 'attachment' AND flag <> 'A' GROUP BY item",
    "child_versions": f"""WITH {_L}, {_O}, a AS (SELECT parent, version FROM ch WHERE kind IN ('note', 'annotation') AND flag <> 'A' UNION ALL SELECT NULL, version FROM o WHERE kind = 'note' AND o_orderstatus <> 'P')
        SELECT parent AS "parentItem", count(*) AS n, max(version) AS version FROM a WHERE version > 10500 GROUP BY 1""",
    "item_projection": """SELECT s_suppkey AS key, 'book' AS "itemType", CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN 'Case ' || s_name ELSE '(untitled)' END AS title,
        s_name || CASE WHEN s_suppkey % 2 = 0 THEN ', Ann' ELSE '' END || '; Org' AS authors, (s_nationkey + 1990)::VARCHAR AS year, 2 AS n_tags FROM supplier""",
    "annotation_filter": f"""WITH {_L}, f AS (SELECT l_orderkey AS attachment, l_linenumber AS key, part FROM ln WHERE part % 3 <> 1 AND flag IN ('A', 'R'))
        SELECT attachment, key, row_number() OVER (PARTITION BY attachment ORDER BY part, key) AS nth, count(*) OVER (PARTITION BY attachment) AS annotations FROM f""",
    "annotation_digest": """WITH a AS (SELECT l_orderkey AS attachment, l_linenumber AS n, min(l_partkey) AS part FROM lineitem GROUP BY ALL)
        SELECT attachment, '<h1>A &amp; B</h1>' || string_agg('<blockquote><p>&lt;' || part || ' (p. ' || n || ')</p></blockquote>' || CASE WHEN part % 2 = 0 THEN '<p>c</p>' ELSE '' END, '' ORDER BY part, n) AS html FROM a GROUP BY 1""",
    "item_texts": "SELECT p_partkey AS key, p_name || '. ' || p_brand || '. ' || p_type || CASE WHEN p_size > 25 THEN '. ' || p_size ELSE '' END AS text FROM part ORDER BY p_name, p_partkey LIMIT 100",
    "generic_search": f"""WITH {_scores("heron eaux")} SELECT * FROM (SELECT id, round(score, 6) AS score, 'index' AS way FROM bm25 WHERE score > 0 ORDER BY score DESC, id LIMIT 10)
        UNION ALL SELECT * FROM (SELECT doc_id, NULL, 'title' FROM documents WHERE starts_with(doc_id::VARCHAR, '1') ORDER BY 'Document N-' || doc_id, doc_id LIMIT 10)""",
    "text_catch_up": f"WITH {_L} SELECT key FROM ch WHERE kind = 'attachment' AND version > 10500 AND flag <> 'A' AND key % 2 <> 0",
    "schema_validation": """SELECT p_partkey AS key, 'unknown field' AS problem, 'size' AS name FROM part WHERE length(p_brand) = 7
        UNION ALL SELECT p_partkey, 'unknown creator type', 'translator' FROM part WHERE p_size % 7 = 0""",
    "top_of_children": f"WITH {_L} SELECT item AS top, count(*) AS children FROM ch GROUP BY item",
    "document_fetch": """WITH d AS (SELECT doc_id, concat_ws(chr(10), 'Title: (untitled)', 'Type: ' || lang, 'Date: ' || source) || coalesce(chr(10) || chr(10) || text, '') AS t FROM documents WHERE doc_id = 5)
        SELECT doc_id AS key, '(untitled)' AS title, md5(substr(t, 1, 400)) AS text_md5, length(t) > 400 AS cut FROM d""",
    "extraction_newest": f'WITH {_X} SELECT parentKey, schema, noteKey, updated, size, kind FROM x',
    "extraction_columns": f"""WITH {_X}, f AS (SELECT schema, parentKey, CASE WHEN size IS NULL THEN ['kind'] ELSE ['size', 'kind'] END AS names FROM x),
        e AS (SELECT schema, parentKey, unnest(names) AS name, unnest(range(len(names))) AS pos FROM f), g AS (SELECT schema, name, min((parentKey, pos)) AS fst, count(DISTINCT parentKey) AS filled FROM e GROUP BY ALL)
        SELECT schema, name, row_number() OVER (PARTITION BY schema ORDER BY fst) AS place, filled FROM g""",
    "extraction_missing": f"""WITH {_X} SELECT c_custkey AS key, 'all' AS missing FROM customer WHERE c_custkey NOT IN (SELECT parentKey FROM x WHERE schema = '1')
        UNION ALL SELECT parentKey, 'size' FROM x WHERE schema = '1' AND size IS NULL""",
    "extraction_table": f"""WITH {_X}, r AS (SELECT *, CASE WHEN c_custkey % 3 = 1 THEN c_name || ' (2001)' WHEN c_custkey % 3 = 2 THEN c_name WHEN c_custkey % 2 = 0 THEN '=Title|x' ELSE c_custkey::VARCHAR END AS study
            FROM x JOIN customer ON c_custkey = parentKey WHERE schema = '1')
        SELECT parentKey, '| ' || replace(study, '|', '\\|') || ' (' || parentKey || ') | ' || coalesce(size || CASE WHEN chk = 'not-found' THEN ' [quote not found]' ELSE '' END, '(missing)') || ' | ' || kind || ' |' AS markdown,
            parentKey || ',' || CASE WHEN study[1] = '=' THEN '"''' || study || '"' ELSE study END || ',"''=t",' || coalesce(size || ',q,,' || chk, ',,,') AS csv FROM r""",
    "extraction_quotes": f"WITH {_X} SELECT schema, count(*) FILTER (chk = 'verified') AS verified, count(*) FILTER (chk = 'not-found') AS not_found, 0::BIGINT AS unchecked FROM x WHERE size IS NOT NULL GROUP BY schema",
    "extraction_merge": """WITH l AS (SELECT l_orderkey AS key, 'f' || (l_partkey % 4) AS name, l_suppkey AS supp, l_partkey * 10 + l_linenumber AS place, min(l_quantity::VARCHAR) AS value, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
        h AS (SELECT key, name, min(place) AS place, arg_min(value, (place, value)) AS value FROM l WHERE supp % 2 = 0 GROUP BY ALL),
        gv AS (SELECT *, CASE WHEN flag <> 'R' THEN value END AS v FROM l WHERE supp % 2 = 1),
        g AS (SELECT key, name, place, v AS value FROM gv QUALIFY row_number() OVER (PARTITION BY key, name ORDER BY place, coalesce(v, '')) = 1),
        b AS (SELECT coalesce(h.key, g.key) AS key, coalesce(h.name, g.name) AS name, coalesce(g.value, h.value) AS value, h.place AS hp, coalesce(h.place, g.place) AS p,
                CASE WHEN h.key IS NOT NULL AND g.key IS NOT NULL AND g.value IS NULL THEN 'removed' WHEN h.key IS NULL THEN 'added' WHEN g.key IS NOT NULL THEN 'replaced' ELSE 'kept' END AS change
            FROM h FULL JOIN g ON h.key = g.key AND h.name = g.name WHERE h.key IS NOT NULL OR g.value IS NOT NULL)
        SELECT key, name, value, change, CASE WHEN change <> 'removed' THEN row_number() OVER (PARTITION BY key, change = 'removed' ORDER BY hp IS NULL, p, name) END AS place FROM b""",
    "identifiers_in_text": """WITH h AS (SELECT 'doi' AS type, '10.1234/p.' || p_partkey AS value, p_partkey AS doc, 'doi:' AS label, 'high' AS confidence FROM part
            UNION ALL SELECT 'doi', '10.5555/Q' || (p_partkey % 50), p_partkey, '', 'low' FROM part
            UNION ALL SELECT 'arxiv', '2101.' || lpad((p_partkey % 700)::VARCHAR, 5, '0') || 'v2', p_partkey, 'arXiv:', 'high' FROM part)
        SELECT type, value, min(doc) AS doc, 1 AS page, label, confidence, count(*) AS hits FROM h GROUP BY ALL""",
    "ris_records": """SELECT p_size AS doc, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS nth, 'p' || p_partkey AS label, 'article-journal' AS "cslType", p_name || ' of ' || p_brand AS title,
        (p_size + 1950) || '-03' AS issued, '1-9' AS page, 'author|' || p_type || '|' || p_brand AS creators, 'a;b' AS tags, 0 AS n_warnings FROM part""",
    "bibtex_records": """SELECT s_nationkey AS doc, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS nth, 's' || s_suppkey AS label, 'article-journal' AS "cslType", 'The été of ' || s_name AS title,
        (s_nationkey + 1990) || '-03' AS issued, '1-9' AS page, 'author|von ' || s_name || '|Ann;author|Org' AS creators, 'a;b' AS tags, 0 AS n_warnings FROM supplier""",
    "csl_records": """SELECT c_nationkey AS doc, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth, 'c' || c_custkey AS label, 'book' AS "cslType", c_name AS title,
        (c_nationkey + 1990) || '-03' AS issued, '1-9' AS page, 'author|' || c_mktsegment || '|A' AS creators, 'a;b' AS tags, 0 AS n_warnings FROM customer""",
    "review_queue": f"""WITH {_V} SELECT key, 'team' AS why FROM ta WHERE o = 'conflict' UNION ALL SELECT key, 'bob' FROM ta WHERE o = 'include' AND key % 5 <> 0 UNION ALL SELECT key, 'malformed' FROM ta WHERE key % 11 = 0""",
    "reviewer_matrix": f"""WITH {_V}, r AS (SELECT 'ann' AS reviewer, a AS yes FROM v UNION ALL SELECT 'bob', b FROM v)
        SELECT reviewer, 'title-abstract' AS stage, count(*) FILTER (yes) AS include, count(*) FILTER (NOT yes) AS exclude, 0::BIGINT AS maybe FROM r GROUP BY 1""",
    "review_disagreements": f"""WITH {_V} SELECT key, 'title-abstract' AS stage, 'ann:' || CASE WHEN a THEN 'include' ELSE 'exclude' END || ',bob:' || CASE WHEN b THEN 'include' ELSE 'exclude' END AS decisions, key % 7 = 0 AS resolved FROM v WHERE a <> b""",
    "exclusion_reasons": f"""WITH {_V} SELECT 'title-abstract' AS stage, '(none given)' AS reason, count(*) AS n FROM ta WHERE o = 'exclude' HAVING count(*) > 0
        UNION ALL SELECT 'full-text', 'wrong-outcome', count(*) FROM ta WHERE key % 5 = 0""",
    "evidence_coverage": """WITH e AS (SELECT ['passage', 'abstract', 'unavailable'][l_suppkey % 3 + 1] AS coverage, l_linenumber % 2 = 0 AS page, l_partkey % 3 = 0 AS q, l_returnflag = 'R' AS unverified FROM lineitem)
        SELECT coverage, count(*) AS n, count(*) FILTER ((page AND NOT q) OR (coverage = 'passage' AND NOT q) OR (coverage <> 'passage' AND NOT unverified) OR (coverage = 'unavailable' AND q)) AS flagged FROM e GROUP BY 1""",
    "sync_feed": f"""WITH {_L}, {_O}, a AS (SELECT kind, version, flag = 'A' AS gone FROM ch UNION ALL SELECT kind, version, o_orderstatus = 'P' FROM o)
        SELECT kind AS type, CASE WHEN gone THEN 'deleted' ELSE 'changed' END AS change, count(*) AS n FROM a WHERE version > 10000 GROUP BY ALL""",
    "index_upsert": f"WITH {_O} SELECT o_orderkey AS key, version, CASE WHEN version > 10000 THEN 'new' ELSE 'old' END AS mark FROM o WHERE o_orderstatus <> 'P'",
    "stale_own_words": f"""WITH {_L}, l AS (SELECT parent AS item, key, version FROM ch WHERE flag <> 'A'), h AS (SELECT parent AS item, key FROM ch WHERE kind = 'note')
        SELECT DISTINCT coalesce(h.item, l.item) AS item FROM h FULL JOIN l ON h.key = l.key WHERE l.version IS NULL OR l.version > 10900""",
    "vector_reuse": "SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 AND doc_id IN (SELECT vec_id FROM embeddings) THEN 'kept' ELSE 'waits' END AS state FROM documents",
}
