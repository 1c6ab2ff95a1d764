"""Data extraction from papers: notes that hold a JSON record, their newest version, tables, merges and quote checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENTITIES, csv_field, markdown_cell

RECORD = "struct<`{marker}`:int,schema:string,itemKey:string,updated:string,fields:array<struct<name:string,value:string,quote:string,page:string,check:string>>>"
#: The format's version, and what a checked quotation can be.
VERSION, CHECKS = 1, ["verified", "not-found", "unchecked"]


def parsed(note: Column, marker: str = "extraction") -> Column:
    """The record in a note's first readable pre block, told by the marker that holds the format's version; null if there is none."""
    blocks = F.regexp_extract_all(note, F.lit(r"(?is)<pre\b[^>]*>(.*?)</pre>"), F.lit(1))
    plain = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))
    decoded = F.transform(plain, lambda b: reduce(lambda x, e: F.replace(x, F.lit(f"&{e};"), F.lit(ENTITIES[e])), ("lt", "gt", "quot", "apos", "nbsp", "amp"), F.replace(b, F.lit("&#39;"), F.lit("'"))))
    records = F.transform(decoded, lambda b: F.from_json(b, RECORD.format(marker=marker)))
    return F.get(F.filter(records, lambda r: (r[marker] == VERSION) & r["schema"].isNotNull() & r["fields"].isNotNull()), F.lit(0))


def extractions(notes: DataFrame, marker: str = "extraction") -> DataFrame:
    """(noteKey, parentKey, schema, updated, fields) of notes(key, parentItem, note, deleted) that hold a record."""
    found = notes.filter(F.col("parentItem").isNotNull() & ~F.coalesce("deleted", F.lit(False))).select(F.col("key").alias("noteKey"), F.col("parentItem").alias("parentKey"), parsed(F.col("note"), marker).alias("r"))
    good = F.filter("r.fields", lambda f: f["name"].isNotNull() & f["value"].isNotNull())
    return found.filter("r is not null").select("noteKey", "parentKey", F.col("r.schema").alias("schema"), F.coalesce("r.updated", F.lit("")).alias("updated"), good.alias("fields"))


def newest(found: DataFrame) -> DataFrame:
    """Of each paper and schema the record updated last; of equal ones the greater note key's."""
    return found.groupBy("parentKey", "schema").agg(F.max_by(F.struct("noteKey", "updated", "fields"), F.struct("updated", "noteKey")).alias("n")).select("parentKey", "schema", "n.*")


def columns(rows: DataFrame, order: str = "parentKey") -> DataFrame:
    """(schema, name, place, filled): the fields of a schema in first-seen order, and how many rows have each."""
    each = rows.select("schema", F.col(order).alias("_o"), F.posexplode("fields").alias("_p", "f"))
    seen = each.groupBy("schema", "f.name").agg(F.min(F.struct("_o", "_p")).alias("first"), F.count_distinct("_o").alias("filled"))
    return seen.select("schema", "name", F.row_number().over(Window.partitionBy("schema").orderBy("first")).alias("place"), "filled")


def missing(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """Papers without a record."""
    return papers.join(rows.select(F.col("parentKey").alias("key")), "key", "left_anti")


def missing_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("parentKey", "schema", F.array_except(F.array(*map(F.lit, names)), F.transform("fields", lambda f: f["name"])).alias("missing"))


def value_of(name: str) -> Column:
    return F.get(F.filter("fields", lambda f: f["name"] == name), F.lit(0))


def study_label(creator: Column, year: Column, title: Column, key: Column) -> Column:
    """First creator and year, else the title, else the key."""
    who = F.concat_ws(" ", F.nullif(creator, F.lit("")), F.concat(F.lit("("), F.nullif(year, F.lit("")), F.lit(")")))
    return F.coalesce(F.nullif(who, F.lit("")), F.nullif(title, F.lit("")), key)


def markdown_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """(parentKey, line): a table row of each record, study first; study is a column of rows."""
    cells = [F.when(value_of(n).isNull(), "(missing)").otherwise(markdown_cell(F.concat(value_of(n)["value"], F.when(value_of(n)["check"] == "not-found", " [quote not found]").otherwise("")))) for n in names]
    return rows.select("parentKey", F.concat(F.lit("| "), F.concat_ws(" | ", markdown_cell(F.concat(F.col("study"), F.lit(" ("), F.col("parentKey").cast("string"), F.lit(")"))), *cells), F.lit(" |")).alias("line"))


def csv_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """(parentKey, line): key, study, title, and of each field value, quotation, page and check."""
    cells = [csv_field(F.coalesce(value_of(n)[p], F.lit(""))) for n in names for p in ("value", "quote", "page", "check")]
    return rows.select("parentKey", F.concat_ws(",", csv_field(F.col("parentKey").cast("string")), csv_field(F.col("study")), csv_field(F.coalesce("title", F.lit(""))), *cells).alias("line"))


def merge_fields(held: DataFrame, given: DataFrame, replace_all: bool = False) -> DataFrame:
    """(key, name, value, change, place) of held and given(key, place, name, value).

    A given value replaces the held one in its place, a given null removes it, new names come after the held ones;
    what isn't mentioned stays, unless replace_all drops it.
    """
    first = lambda df, p: df.groupBy("key", "name").agg(F.min_by(F.struct("place", "value"), "place").alias(p))
    both = first(held, "h").join(first(given, "g"), ["key", "name"], "full_outer")
    gone = F.col("h").isNotNull() & F.when(F.col("g").isNotNull(), F.col("g.value").isNull()).otherwise(F.lit(replace_all))
    change = F.when(gone, "removed").when(F.col("h").isNull(), "added").when(F.col("g").isNotNull(), "replaced").otherwise("kept")
    rows = both.filter("h is not null or g.value is not null").withColumn("change", change)
    order = Window.partitionBy("key", F.col("change") == "removed").orderBy(F.col("h").isNull(), F.coalesce("h.place", "g.place"), "name")
    return rows.select("key", "name", F.coalesce("g.value", "h.value").alias("value"), "change", F.when(F.col("change") != "removed", F.row_number().over(order)).alias("place"))


def quote_counts(rows: DataFrame) -> DataFrame:
    """By schema: how many quotations were found, weren't, and couldn't be checked."""
    each = rows.select("schema", F.explode("fields").alias("f")).filter("f.quote is not null")
    return each.groupBy("schema").agg(*[F.count_if(F.col("f.check") == c).alias(c.replace("-", "_")) for c in CHECKS])


def coverage_counts(rows: DataFrame, flags: Column) -> DataFrame:
    """By coverage: rows, and rows that break a rule."""
    return rows.groupBy("coverage").agg(F.count("*").alias("n"), F.count_if(F.size(flags) > 0).alias("flagged"))
