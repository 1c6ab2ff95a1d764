"""Large bibliography files, read by many tasks.

Spark's text reader cuts a file into byte ranges and reads records that end with a separator of one's own; with the separator
before an entry's begin, a range's records are whole entries. Their order is that of the ranges, then of the rows in one. What an entry
needs of the text before it (BibTeX macros, its number) is carried over as small tables by file and range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import staged
from . import bibliography, bibtex

#: What stands before a record of each format, and how the text behind it goes on if it is one.
BEGINS = {"bibtex": ("\n@", r"^[A-Za-z]+[ \t]*[{(]"), "ris": ("\nTY  -", r"^ ?")}
MACRO = r"(?i)^@string\s*[{(]"


def pieces(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, block, place, text) of all records of the files at path; block and place order the records of a file.

    A piece whose begin is no entry's (an address at the left edge of an abstract) is put back behind the piece before it.
    """
    separator, begin = BEGINS[kind]
    lines = spark.read.option("lineSep", separator).text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    raw = staged(raw, "pieces")
    first = raw.groupBy("file").agg(F.min(F.struct("block", "place")).alias("first"))
    marked = raw.join(first, "file").withColumn("is_first", F.struct("block", "place") == F.col("first"))
    opens = F.col("is_first") | F.col("text").rlike(begin)
    text = F.when(F.col("is_first"), F.col("text")).otherwise(F.concat(F.lit(separator[1:]), F.col("text")))
    marked = staged(marked.select("file", "block", "place", text.alias("text"), opens.alias("opens")), "marked")
    loose = marked.filter(~F.col("opens")).select("file").distinct()
    if loose.isEmpty():
        return marked.drop("opens")
    #: Only files that have such pieces are ordered as a whole.
    some = marked.join(loose, "file", "left_semi")
    head = F.last(F.when(F.col("opens"), F.struct("block", "place")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "place"))
    glued = some.withColumn("head", head).groupBy("file", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "place", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return marked.join(loose, "file", "left_anti").drop("opens").unionByName(glued.select("file", "head.block", "head.place", "text"))


def _numbered(records: DataFrame) -> DataFrame:
    """records (file, block, place, at, ...) with nth, counted from 0 in each file: in its range, after all of the ranges before."""
    held = records.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("place", "at")) - 1
    return records.withColumn("own", own).join(held.select("file", "block", before.alias("before")), ["file", "block"]).withColumn("nth", (F.col("own") + F.col("before")).cast("int"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(doc, nth, record columns) of the files at path, doc being the file, as bibtex.read() gives them of whole texts."""
    own = staged(pieces(spark, path, "bibtex"), "entries")

    @F.pandas_udf("map<string,string>")
    def told(texts: pd.Series) -> pd.Series:
        def macros(text: str) -> dict[str, str]:
            known: dict[str, str] = {}
            bibtex.entries(text, known)
            return known

        return texts.map(macros)

    @F.pandas_udf(f"array<struct<{bibtex.RECORD}>>")
    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([[bibtex.record(*e, nth) for nth, e in enumerate(bibtex.entries(t, dict(k)))] for t, k in zip(texts, known, strict=True)])

    #: A macro counts for what comes after it; of several the last one before an entry. Months stand unless told anew.
    strings = own.filter(F.col("text").rlike(f"(?m){MACRO}")).select("file", "block", "place", told("text").alias("macros"))
    strings = strings.withColumn("macros", F.map_entries(_own_macros(F.col("macros"))))
    told_of = strings.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "place", "macros"))).alias("told"))
    before = F.filter(F.coalesce("told", F.array().cast("array<struct<block:bigint,place:bigint,macros:array<struct<key:string,value:string>>>>")), lambda t: F.struct(t["block"], t["place"]) < F.struct(F.col("block"), F.col("place")))
    pairs = F.flatten(F.transform(before, lambda t: t["macros"]))
    latest = F.map_from_entries(F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.array_append(F.filter(a, lambda y: y["key"] != x["key"]), x)))
    each = staged(own.join(told_of, "file", "left").select("file", "block", "place", "text", latest.alias("known")), "told")
    records = staged(each.select("file", "block", "place", F.posexplode(run("text", "known")).alias("at", "r")), "records")
    out = _numbered(records).select(F.col("file").alias("doc"), "nth", "r.*")
    named = F.col("fields")["citation-key"].isNotNull()
    return out.withColumn("label", F.when(named, F.col("label")).otherwise(F.concat(F.lit("entry "), (F.col("nth") + 1).cast("string"))))


def _own_macros(known: Column) -> Column:
    """Macros without the months as they are from the start."""
    months = F.create_map(*[F.lit(x) for m in bibtex.MONTHS for x in (m[:3].lower(), m)])
    return F.map_filter(known, lambda k, v: ~months[k].eqNullSafe(v))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """(doc, nth, record columns) of the RIS files at path, doc being the file, as bibliography.ris() gives them of whole texts."""
    own = staged(pieces(spark, path, "ris"), "entries")
    read = bibliography.ris(own.select(F.struct("file", "block", "place").alias("doc"), "text"))
    records = staged(read.select("doc.file", "doc.block", "doc.place", F.col("nth").alias("at"), *[c for c in read.columns if c not in ("doc", "nth")]), "records")
    kept = [c for c in records.columns if c not in ("file", "block", "place", "at")]
    return _numbered(records).select(F.col("file").alias("doc"), "nth", *kept)
