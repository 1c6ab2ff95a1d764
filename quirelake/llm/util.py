"""Helpers shared by the corpus operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components as rooted
from ..operators.components import shared_dir, staged
from ..session import table

__all__ = ["SALTS", "ascii_lower", "components", "free_name", "row_hash", "salt_of", "salted", "salts_seen", "shared_dir", "staged", "table"]

#: Parts that the rows of one key are dealt to in a salted join.
SALTS = 64


def free_name(wanted: str, *taken: str) -> str:
    """wanted, lengthened until it is none of the names taken, case aside."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def row_hash(df: DataFrame, *more: Column) -> Column:
    """A hash of a row's columns, but for maps, which have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()], *more)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in edges(a, b): label is the smallest id reachable."""
    return rooted(edges).withColumnRenamed("root", "label")


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salts_seen(salt: Column) -> Column:
    """Aggregate: which salts the rows of a key have, as the bits of one long; combined before the shuffle."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def salted(groups: DataFrame, mask: str) -> DataFrame:
    """groups with one row for each salt in mask, as column salt: never more rows than the group has members."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col(mask), k) == 1)
    return groups.withColumn("salt", F.explode(bits)).drop(mask)
