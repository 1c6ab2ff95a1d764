"""Citation graph over items(key, doi, related) and works(id, doi, references, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import tasks


def mark_in_library(works: DataFrame, library: DataFrame) -> DataFrame:
    """works with the library key of the same DOI (of several the first by ord) and whether there is one."""
    first = library.filter("doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.min_by("key", "ord").alias("library_key"))
    return works.join(first, F.lower("doi") == F.col("_doi"), "left").withColumn("in_library", F.col("library_key").isNotNull()).drop("_doi")


def citation_pairs(items: DataFrame, works: DataFrame) -> DataFrame:
    """(a, b, citing, mutual, already_related) of items one of which cites the other.

    items: key, doi, ord, related (array of keys); works: doi, id, references. Each unordered pair comes
    once, with the first direction by ord.
    """
    linked = items.join(works.select("doi", "id", "references"), "doi")
    edges = linked.select("key", "doi", "ord", "related", F.explode(F.array_distinct("references")).alias("ref"))
    cited = linked.select(F.col("id").alias("ref"), F.col("key").alias("other"), F.col("doi").alias("other_doi"), F.col("related").alias("other_related"))
    found = edges.join(cited, "ref").filter((F.col("key") != F.col("other")) & (F.col("doi") != F.col("other_doi")))
    near = F.coalesce(F.array_contains("related", F.col("other")) | F.array_contains("other_related", F.col("key")), F.lit(False))
    return found.groupBy(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).agg(F.min_by("key", "ord").alias("citing"), (F.count_distinct("key") > 1).alias("mutual"), F.bool_or(near).alias("already_related"))


def co_occurrence(rows: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """(a, b, n): members that are together in least groups or more; a group is a short list such as a work's references."""
    n = tasks(rows)
    lists = rows.filter(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m")).repartition(n, "g").groupBy("g").agg(F.sort_array(F.collect_set("m")).alias("all"))
    each = lists.select("all", F.posexplode("all").alias("k", "a")).select("a", F.explode(F.slice("all", F.col("k") + 2, F.size("all"))).alias("b"))
    return each.repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def cited_by(edges: DataFrame, works: DataFrame, n: int) -> DataFrame:
    """The n works with most citations. edges: citing, cited."""
    counts = edges.groupBy(F.col("cited").alias("id")).agg(F.count_distinct("citing").alias("citations"))
    return works.join(counts, "id").orderBy(F.desc("citations"), "id").limit(n)


def suggestions(items: DataFrame, works: DataFrame) -> DataFrame:
    """Citation pairs among the items of a scope that aren't related yet, mutual ones first."""
    return citation_pairs(items, works).filter(~F.col("already_related")).orderBy(F.desc("mutual"), "a", "b")


def references_of(edges: DataFrame, work, n: int = 50) -> DataFrame:
    """The first n works that a work cites, with the number of all. edges: citing, cited, ord."""
    own = edges.filter(F.col("citing") == work)
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy("ord", "cited").limit(n).select("cited").join(F.broadcast(total))  # one row


def related_of(works: DataFrame, work, n: int = 20) -> DataFrame:
    """(place, related, title, total): the first n works that a work's record names as related, in its order, with the title where the
    work is known, and the number of all. works: id, title, related (array of ids)."""
    own = works.filter(F.col("id") == work).select(F.posexplode("related").alias("place", "related"), F.size("related").alias("total")).filter(F.col("place") < n)
    known = works.select(F.col("id").alias("related"), "title")
    return own.join(known, "related", "left").select("place", "related", "title", "total")


def relations(values: Column) -> Column:
    """A map of relations whose values are a string or a JSON list, all as lists without repeats."""
    return F.transform_values(values, lambda k, v: F.array_distinct(F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))))


def written_relations(lists: Column) -> Column:
    """The other way: a list of one as a plain string, others as JSON."""
    return F.transform_values(lists, lambda k, v: F.when(F.size(v) == 1, v[0]).otherwise(F.to_json(v)))


def united_relations(a: Column, b: Column) -> Column:
    """Both maps of lists in one, each list without repeats, a's first."""
    none = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda k, x, y: F.array_union(F.coalesce(x, none), F.coalesce(y, none)))


def position(c: Column) -> Column:
    """An annotation's position: its JSON object as a map, else the text under "raw"."""
    return F.when(c.rlike(r"^\s*\{"), F.coalesce(F.from_json(c, "map<string,string>"), F.create_map(F.lit("raw"), c))).otherwise(F.create_map(F.lit("raw"), c))


def joined_issns(linking: Column, others: Column) -> Column:
    """The linking ISSN and the others in one string, each once."""
    filled = F.filter(F.concat(F.array(linking), F.coalesce(others, F.array().cast("array<string>"))), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.nullif(F.array_join(F.array_distinct(filled), ", "), F.lit(""))


def page_range(first: Column, last: Column) -> Column:
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in (first, last))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(a, F.lit("-"), b)).otherwise(F.coalesce(a, b))


def parsed_range(c: Column) -> Column:
    """struct(first, last) of "a-b" or "a"; null for anything else or a range that goes back."""
    first, last = F.regexp_extract(c, r"^\s*([0-9]+)", 1).try_cast("int"), F.regexp_extract(c, r"[-–]\s*([0-9]+)\s*$", 1).try_cast("int")
    return F.when(c.rlike(r"^\s*[0-9]+\s*([-–]\s*[0-9]+\s*)?$") & (F.coalesce(last, first) >= first), F.struct(first.alias("first"), F.coalesce(last, first).alias("last")))


def queryable_doi(c: Column) -> Column:
    """Whether a DOI can stand in a query string as it is."""
    return F.coalesce((c != "") & ~c.rlike(r"[,|#%\s\x00-\x1f\x7f]"), F.lit(False))


def flat_works(works: DataFrame) -> DataFrame:
    """One flat row a work: at most ten authors, the venue, the bare id and DOI. works: the nested rows of a work index."""
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    return works.select(
        F.regexp_extract("id", "([^/]+)$", 1).alias("id"), F.coalesce("display_name", "title").alias("title"), F.lower(F.regexp_replace("doi", r"(?i)^https?://(dx\.)?doi\.org/", "")).alias("doi"),
        F.col("publication_year").alias("year"), F.slice(names, 1, 10).alias("authors"), F.col("cited_by_count").alias("citations"), F.col("primary_location.source.display_name").alias("venue"),
        "type", "is_retracted", page_range(F.col("biblio.first_page"), F.col("biblio.last_page")).alias("pages"), joined_issns(F.col("primary_location.source.issn_l"), F.col("primary_location.source.issn")).alias("issns"), best_pdf(F.col("locations")).alias("pdf"),
    )


def notice_rows(works: DataFrame) -> DataFrame:
    """(doc_doi, direction, type, doi, date): every update notice of works(doi, updated_by, update_to), each an array of
    struct(type, DOI, date-parts); one with neither a type nor a DOI says nothing and goes."""
    sides = [works.select(F.lower("doi").alias("doc_doi"), F.lit(side).alias("direction"), F.explode(side).alias("n")) for side in ("updated_by", "update_to")]
    both = sides[0].union(sides[1])
    return both.filter("n.type is not null or n.DOI is not null").select("doc_doi", "direction", F.coalesce("n.type", F.lit("unspecified")).alias("type"), F.lower("n.DOI").alias("doi"), iso_date(F.col("n.parts")).alias("date"))


def coverage(found: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: how many of the asked DOIs each provider knew, and how many findings and disagreements there are."""
    n = asked.select("doi").distinct().agg(F.count("*").alias("asked"))
    return found.agg(F.count_if("by_flags").alias("by_flags"), F.count_if("by_notices").alias("by_notices"), F.count("*").alias("findings"), F.count_if("disagree").alias("disagree")).join(F.broadcast(n))  # one row


def notice_sweep(dois: DataFrame, flags: DataFrame, notices: DataFrame) -> DataFrame:
    """Findings among dois(doi): flags(doi, is_retracted) of one provider and notices(doi, type) of another, each with
    whether the provider knew the DOI; a finding has a flag or a notice, and says where the two disagree."""
    n = notices.groupBy("doi").agg(F.sort_array(F.collect_set("type")).alias("notices"))
    both = flags.select("doi", "is_retracted", F.lit(True).alias("by_flags")).join(n.withColumn("by_notices", F.lit(True)), "doi", "full_outer")
    out = dois.select("doi").distinct().join(both, "doi").select("doi", F.coalesce("is_retracted", F.lit(False)).alias("flagged"), F.coalesce("notices", F.array().cast("array<string>")).alias("notices"), F.coalesce("by_flags", F.lit(False)).alias("by_flags"), F.coalesce("by_notices", F.lit(False)).alias("by_notices"))
    out = out.withColumn("disagree", F.col("by_flags") & F.col("by_notices") & (F.col("flagged") != F.array_contains("notices", "retraction")))
    return out.filter(F.col("flagged") | (F.size("notices") > 0))


def iso_date(parts: Column) -> Column:
    """[2020, 3, 7] as 2020-03-07, shorter lists as prefixes of it."""
    return F.array_join(F.transform(parts, lambda p, k: F.lpad(p.cast("string"), F.when(k == 0, 4).otherwise(2), F.lit("0"))), "-")


def best_pdf(locations: Column) -> Column:
    """Of open locations with a PDF the published version's, else the accepted one's, else any."""
    has = F.filter(locations, lambda x: x["is_oa"] & x["pdf_url"].isNotNull())
    pick = lambda v: F.get(F.filter(has, lambda x: x["version"] == v), F.lit(0))["pdf_url"]
    return F.coalesce(pick("publishedVersion"), pick("acceptedVersion"), F.get(has, F.lit(0))["pdf_url"])
