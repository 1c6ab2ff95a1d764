"""Listings of a library: items(key, itemType, title, parentItem, collections, tags, version, deleted, creators, date, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import year_key

#: Item types that belong to another item.
CHILD_TYPES = ["note", "attachment", "annotation"]
#: Characters of an item's own words or full text that are indexed.
MOST_CHARS = 40_000
#: Annotation colours by name, and the content types that can be annotated.
COLOURS = {"yellow": "#ffd400", "red": "#ff6666", "green": "#5fb236", "blue": "#2ea8e5", "purple": "#a28ae5", "magenta": "#e56eee", "orange": "#f19837", "gray": "#aaaaaa", "grey": "#aaaaaa"}
ANNOTATABLE = ["application/pdf", "application/epub+zip", "text/html"]


def live(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce("deleted", F.lit(False)))


def title_of(title: Column, *others: Column) -> Column:
    """The title, else the first other name that is filled, else "(untitled)"."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (title, *others)], F.lit("(untitled)"))


def authors_of(creators: Column) -> Column:
    """"Last, First" or the single name of every creator that has one."""
    named = F.transform(F.coalesce(creators, F.array().cast("array<struct<lastName:string,firstName:string,name:string>>")), lambda c: F.coalesce(F.nullif(F.trim(F.concat_ws(", ", F.nullif(F.trim(c["lastName"]), F.lit("")), F.nullif(F.trim(c["firstName"]), F.lit("")))), F.lit("")), F.nullif(F.trim(c["name"]), F.lit(""))))
    return F.array_compact(named)


def project(items: DataFrame, detailed: bool = False) -> DataFrame:
    """What a listing shows of items; detailed adds the fields of a review record."""
    title = title_of(F.col("title"), *[F.col(c) for c in ("caseName", "subject") if c in items.columns])
    year = F.coalesce(year_key(F.col("date")), F.nullif(F.substring("parsedDate", 1, 4), F.lit("")) if "parsedDate" in items.columns else F.lit(None))
    more = [authors_of(F.col("creators")).alias("authors"), year.alias("year"), F.size("tags").alias("n_tags")] if detailed else []
    return items.select("key", "itemType", title.alias("title"), *more)


def listing(items: DataFrame, sort: str, descending: bool = False, start: int = 0, limit: int = 100) -> DataFrame:
    """A page of items with the number of all of them, the library's version, and where the next page starts (null at the end)."""
    facts = items.agg(F.count("*").alias("total"), F.max("version").alias("library_version"))
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    page = items.orderBy(key, "key").offset(start).limit(limit)
    after = F.when(F.col("total") > start + limit, F.lit(start + limit))
    return page.join(F.broadcast(facts)).withColumn("next_start", after)  # facts is one row


def keys(items: DataFrame) -> DataFrame:
    return items.select("key")


def one(items: DataFrame, key) -> DataFrame:
    """The item with a key; no row if there is none."""
    return items.filter(F.col("key") == key)


def children(items: DataFrame, parent, item_type: str | None = None) -> DataFrame:
    own = items.filter(F.col("parentItem") == parent)
    return own.filter(F.col("itemType") == item_type) if item_type else own


def crawl(items: DataFrame, collection) -> DataFrame:
    """(key, ..., skipped): the collection's records at the top, and how many of its items were no records or trashed."""
    own = items.filter(F.array_contains("collections", collection) & F.col("parentItem").isNull())
    record = ~F.coalesce("deleted", F.lit(False)) & ~F.col("itemType").isin(CHILD_TYPES)
    skipped = own.agg(F.count_if(~record).alias("skipped"))
    return own.filter(record).join(F.broadcast(skipped))  # one row


def capped_census(items: DataFrame, most: int = 5000) -> DataFrame:
    """Live records at the top, the first `most` by key, and whether these are all."""
    top = live(items).filter(F.col("parentItem").isNull() & ~F.col("itemType").isin(CHILD_TYPES))
    return top.orderBy("key").limit(most).withColumn("complete", F.lit(top.count() <= most))


def scope(items: DataFrame, wanted: DataFrame | None = None, collection=None) -> DataFrame:
    """Items of a key list (a table of keys), or of a collection."""
    return items.join(wanted.select("key"), "key", "left_semi") if wanted is not None else items.filter(F.array_contains("collections", collection))


def intersect(*lists: DataFrame) -> DataFrame:
    """Keys that are in all lists."""
    out = lists[0].select("key").distinct()
    for other in lists[1:]:
        out = out.join(other.select("key"), "key", "left_semi")
    return out


def collection_listing(collections: DataFrame, start: int = 0, limit: int = 100) -> DataFrame:
    """A page of collections(key, name, items) by name; a tie goes by key."""
    return collections.orderBy(F.lower("name"), "key").offset(start).limit(limit)


def across_trash(items: DataFrame, where: Column) -> DataFrame:
    """Matches among live and trashed items alike, with the flag: trash is a column, not a table of its own."""
    return items.filter(where).withColumn("trashed", F.coalesce("deleted", F.lit(False)))


def parent_items(items: DataFrame) -> DataFrame:
    """(key, item): the record that each attachment or note belongs to, an annotation by its attachment."""
    up = items.select(F.col("key").alias("_k"), F.col("parentItem").alias("_p"))
    own = items.filter("parentItem is not null").join(up, F.col("parentItem") == F.col("_k"), "left")
    return own.select("key", F.coalesce("_p", "parentItem").alias("item"))


def capped(rows: DataFrame, most: int = MOST_CHARS, gap: str = "\n\n") -> DataFrame:
    """(item, text) of rows(item, key, text): texts in key order joined by a blank line, at most `most` characters of them.

    Only rows that begin before the cap are gathered, so a group is bounded by it, not by the item's rows.
    """
    before = F.coalesce(F.sum(F.length("text") + len(gap)).over(Window.partitionBy("item").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = rows.withColumn("_at", before).filter(F.col("_at") < most + len(gap))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), gap)
    return some.groupBy("item").agg(F.substring(whole, 1, most).alias("text"))


def own_words(items: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(item, text): each record's live notes and annotations, in key order."""
    words = live(items).filter(F.col("itemType").isin("note", "annotation") & (F.trim("text") != ""))
    return capped(words.join(parent_items(items), "key").select("item", "key", "text"), most)


def full_text(items: DataFrame, texts: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(item, text): the texts(key, content) of each record's attachments, in key order."""
    held = texts.filter(F.trim("content") != "").select("key", F.col("content").alias("text"))
    return capped(held.join(parent_items(live(items).filter(F.col("itemType") == "attachment")), "key").select("item", "key", "text"), most)


def child_versions(items: DataFrame) -> DataFrame:
    """(key, parentItem, version) of every live note and annotation."""
    return live(items).filter(F.col("itemType").isin("note", "annotation")).select("key", "parentItem", "version")


def colour(c: Column) -> Column:
    """A colour name or hex code as lower-case hex."""
    names = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    bare = F.lower(F.trim(c))
    return F.coalesce(names[bare], F.concat(F.lit("#"), F.regexp_replace(bare, "^#", "")))


def annotations(rows: DataFrame, kinds: list[str] | None = None, colours: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """rows(key, kind, color, tags, ...) that meet every given filter, all without regard to case."""
    where = F.lit(True)
    if kinds:
        where &= F.lower("kind").isin([k.lower() for k in kinds])
    if colours:
        where &= F.array_contains(F.array(*[colour(F.lit(c)) for c in colours]), colour(F.col("color")))
    if tags:
        where &= F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags]))
    return rows.filter(where)


def annotatable(items: DataFrame) -> DataFrame:
    return items.filter(F.col("contentType").isin(ANNOTATABLE) & (F.col("linkMode") != "linked_url"))


def annotation_digest(rows: DataFrame) -> DataFrame:
    """rows(attachment, key, sortIndex, ...) in reading order, with each attachment's number of annotations."""
    w = Window.partitionBy("attachment").orderBy("sortIndex", "key")
    counts = rows.groupBy("attachment").agg(F.count("*").alias("annotations"))
    return rows.withColumn("nth", F.row_number().over(w)).join(counts, "attachment")


def escaped(c: Column) -> Column:
    """Text as HTML."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def digest_html(rows: DataFrame) -> DataFrame:
    """(attachment, html): a note for each attachment: its title, and its annotations' text, comment and page in reading order.

    rows: attachment, title, sortIndex, key, text, comment, page. An attachment's annotations are one note, so they fit in a row.
    """
    page = F.when(F.coalesce("page", F.lit("")) != "", F.concat(F.lit(" (p. "), escaped(F.col("page")), F.lit(")"))).otherwise("")
    said = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("<blockquote><p>"), escaped(F.col("text")), page, F.lit("</p></blockquote>"))).otherwise("")
    own = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("<p>"), escaped(F.col("comment")), F.lit("</p>"))).otherwise("")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("sortIndex", "key", F.concat(said, own).alias("h")))), lambda x: x["h"])
    return rows.groupBy("attachment").agg(F.concat(F.lit("<h1>"), escaped(F.min("title")), F.lit("</h1>"), F.array_join(parts, "")).alias("html"))


def queue_order(items: DataFrame) -> DataFrame:
    """By title without regard to case or accents, then key."""
    return items.orderBy(F.expr("title COLLATE UNICODE_CI_AI"), "key")


def item_text(d: dict[str, Column]) -> Column:
    """The text an item is found by: title, abstract, surnames, tags, date, container and note, those that are filled, joined by ". "."""
    parts = [d[k] for k in ("title", "abstractNote", "surnames", "tags", "date", "publicationTitle", "bookTitle", "note") if k in d]
    return F.concat_ws(". ", *[F.nullif(c, F.lit("")) for c in parts])


def validate(items: DataFrame, fields: DataFrame, creator_types: DataFrame) -> DataFrame:
    """(key, problem, name): fields that the item's type doesn't have, and creator types it doesn't allow.

    items: key, itemType, fields (map), creatorTypes (array); fields: itemType, name; creator_types: itemType, name.
    """
    used = items.select("key", "itemType", F.explode(F.map_keys("fields")).alias("name")).withColumn("problem", F.lit("unknown field"))
    made = items.select("key", "itemType", F.explode(F.array_distinct("creatorTypes")).alias("name")).withColumn("problem", F.lit("unknown creator type"))
    bad = [a.join(b, ["itemType", "name"], "left_anti") for a, b in ((used, fields), (made, creator_types))]
    return bad[0].unionByName(bad[1]).select("key", "problem", "name")


def related_keys(uris: Column, base: str) -> Column:
    """Keys of the related items that are in the same library."""
    own = F.filter(uris, lambda u: u.startswith(f"{base}/items/") & u.rlike("/items/[A-Z0-9]{8}$"))
    return F.array_distinct(F.transform(own, lambda u: F.right(u, F.lit(8))))


def merged_away(relations: Column) -> Column:
    """How many items the record has taken in: the size of its list of replaced ones."""
    return F.coalesce(F.size(relations), F.lit(0))


def fetch(items: DataFrame, texts: DataFrame, key, most: int = 100_000) -> DataFrame:
    """(key, title, text, cut): a document as a header of its metadata and its body, at most `most` characters of it."""
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), title_of(F.col("title"))), F.concat(F.lit("Type: "), F.col("itemType")), F.concat(F.lit("Date: "), F.col("date")))
    body = one(items, key).join(texts.select("key", "content"), "key", "left")
    whole = F.concat_ws("\n\n", head, F.col("content"))
    return body.select("key", title_of(F.col("title")).alias("title"), F.substring(whole, 1, most).alias("text"), (F.length(whole) > most).alias("cut"))
