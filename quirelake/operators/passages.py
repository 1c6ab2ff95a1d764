"""One table of passages from an item's metadata, full text and own words, each known by where it comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import chunks
from ..functions.text import squash

#: Sources of passages; metadata is one passage, the others are cut.
METADATA, FULL_TEXT, OWN_WORDS = "metadata", "fulltext", "own"


def passage_id(item: Column, source: Column, nth: Column) -> Column:
    """The same for the same item, source and number, whatever else there is."""
    return F.concat_ws(":", item.cast("string"), source, nth.cast("string"))


def of_source(texts: DataFrame, source: str) -> DataFrame:
    """(id, item, source, nth, text) of texts(item, text); blank texts have none. An item's texts are numbered on, by text."""
    whole = texts.select("item", F.explode(F.array(F.struct(F.lit(0).alias("index"), squash(F.col("text")).alias("text"))) if source == METADATA else chunks(F.col("text"))).alias("c"), F.xxhash64("text").alias("part"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy("part", "c.index", "c.text")) - 1
    each = whole.filter(F.trim("c.text") != "").select("item", nth.alias("nth"), F.col("c.text").alias("text"))
    return each.select(passage_id(F.col("item"), F.lit(source), F.col("nth")).alias("id"), "item", F.lit(source).alias("source"), "nth", "text")


def union(metadata: DataFrame, full_text: DataFrame, own_words: DataFrame) -> DataFrame:
    """Passages of all sources of every item; each input has item and text."""
    parts = ((metadata, METADATA), (full_text, FULL_TEXT), (own_words, OWN_WORDS))
    return reduce(DataFrame.unionByName, [of_source(t, s) for t, s in parts])


def replaced(passages: DataFrame, source: str, texts: DataFrame) -> DataFrame:
    """passages with those of one source made anew for the items of texts(item, text); all else stays as it is. A blank text takes its passages away."""
    gone = texts.select("item").distinct().withColumn("source", F.lit(source))
    return passages.join(gone, ["item", "source"], "left_anti").select(passages.columns).unionByName(of_source(texts, source))
