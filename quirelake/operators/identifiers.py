"""Identifiers in running text: every DOI and arXiv id with its label and context, and the best occurrence of each.

A text is split at blanks and brackets. Pieces that begin like an identifier, or hold one behind a link or a label, are read by
identifier(); the label is the link's host, or the word that stands before the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier, let, squash

#: Characters around an identifier that are shown as its context.
CONTEXT = 60
#: What introduces an identifier of each kind, as a link or as a word.
LINKS = {"doi": ["doi.org/", "dx.doi.org/"], "arxiv": ["arxiv.org/abs/", "arxiv.org/pdf/"]}
NAMES = {"doi": "doi", "arxiv": "arxiv"}
#: What parts pieces, and what does not belong to the end of one.
PARTS, LOOSE = r"[\s\"'<>(){}\[\]]+", ".,;:"


def _pieces(text: Column) -> Column:
    """array of (raw, at): the pieces of a text that can be identifiers, and where they begin."""
    raw = F.split(text, PARTS)
    candidate = lambda x: x.contains("/") | x.rlike("[0-9]{4}[.][0-9]{4}") | F.lower(x).contains(NAMES["arxiv"])
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<raw:string,at:int,before:string>>").alias("found"), F.lit("").alias("last"))

    def step(a: Column, x: Column) -> Column:
        at = F.call_function("locate", x, text, a["at"])
        own = F.array(F.struct(x.alias("raw"), at.alias("at"), a["last"].alias("before")))
        return F.struct((at + F.length(x)).alias("at"), F.when(candidate(x), F.concat(a["found"], own)).otherwise(a["found"]).alias("found"), x.alias("last"))

    return F.aggregate(F.filter(raw, lambda x: x != ""), zero, step)["found"]


def _read(kind: str, p: Column) -> Column:
    """struct(id, label, at, size) of a piece as this kind of identifier; null if it is none.

    The label is a link's beginning, "name:" in the piece itself, or the word before it.
    """
    low, name = F.lower(p["raw"]), NAMES[kind]
    lead = F.lit(0)
    for link in sorted(LINKS[kind], key=len):
        lead = F.when(F.instr(low, link) > 0, F.instr(low, link) + len(link) - 1).otherwise(lead)
    lead = F.when(lead > 0, lead).when(low.startswith(f"{name}:"), len(name) + 1).otherwise(0)
    if kind == "doi":  # other text may stand before the registrant
        lead = F.when((lead == 0) & (F.instr(low, "10.") > 1) & ~F.substring(low, F.instr(low, "10.") - 1, F.lit(1)).rlike("[a-z0-9.]"), F.instr(low, "10.") - 1).otherwise(lead)
    word = F.rtrim(F.lower(p["before"]), F.lit(":"))

    def known(n: Column) -> Column:
        value = F.rtrim(F.substr(p["raw"], n + 1), F.lit(LOOSE))
        own = F.substr(p["raw"], F.lit(1), n)
        label = F.when(n > 0, own).when(word == name, p["before"]).otherwise("")
        sure = F.lower(own).endswith(f"{name}:") | F.exists(F.array(*map(F.lit, LINKS[kind])), lambda x: F.lower(own).endswith(x)) | ((n == 0) & (word == name))
        return F.struct(identifier(value).alias("id"), F.when(sure, label).otherwise("").alias("label"), (p["at"] - 1 + n).alias("at"), F.length(value).alias("size"))

    fits = lambda x: (x["id"]["type"] == kind) & ((x["label"] != "") if kind == "arxiv" else F.lit(True))
    return let(let(lead, known), lambda x: F.when(fits(x), x))


def scan(texts: DataFrame) -> DataFrame:
    """(doc, page, pos, type, value, label, context, confidence) of every identifier in texts(doc, page, text).

    A DOI is sure (high) if a label introduces it, an arXiv id always has one. pos orders the hits of a kind on a page.
    """
    some = texts.filter(F.col("text").contains("10.") | F.lower("text").contains(NAMES["arxiv"]))
    found = let(_pieces(F.col("text")), lambda ps: F.array(*[F.array_compact(F.transform(ps, lambda p: _read(kind, p))) for kind in NAMES]))
    hit = some.select("doc", "page", "text", F.explode(found).alias("kind")).select("doc", "page", "text", F.posexplode("kind").alias("pos", "x"))
    begin = F.greatest(F.lit(0), F.col("x.at") - CONTEXT)
    context = squash(F.substr("text", begin + 1, F.col("x.at") + F.col("x.size") + CONTEXT - begin))
    label = F.trim("x.label")
    return hit.select("doc", "page", "pos", "x.id.type", "x.id.value", label.alias("label"), context.alias("context"), F.when(label != "", "high").otherwise("low").alias("confidence"))


def best(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each type and value (case aside), within the columns `by`, the surest hit, else the first by document, page and place."""
    order = F.struct((F.col("confidence") != "high").alias("unsure"), "doc", "page", "pos")
    rest = [c for c in hits.columns if c != "type" and c not in (by or [])]
    return hits.groupBy(*(by or []), "type", F.lower("value").alias("_key")).agg(F.min_by(F.struct(*rest), order).alias("h"), F.count("*").alias("hits")).select(*(by or []), "type", "h.*", "hits")
