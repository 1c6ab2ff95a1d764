"""BibTeX entries: a small reader for one file's text, run in Arrow batches, and the records made of its entries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import latex

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
#: Entry types and fields, and what they are called in records.
TYPES = {
    "article": "article-journal", "book": "book", "booklet": "book", "inbook": "chapter", "incollection": "chapter", "inproceedings": "paper-conference",
    "conference": "paper-conference", "proceedings": "book", "manual": "report", "mastersthesis": "thesis", "phdthesis": "thesis", "thesis": "thesis",
    "techreport": "report", "report": "report", "unpublished": "manuscript", "misc": "document", "online": "webpage", "electronic": "webpage", "www": "webpage",
    "patent": "patent", "dataset": "dataset", "software": "software", "video": "motion_picture", "audio": "song", "periodical": "article-magazine",
    "standard": "standard", "legislation": "legislation", "jurisdiction": "legal_case", "artwork": "graphic", "letter": "personal_communication",
    "collection": "book", "suppbook": "chapter", "mvbook": "book",
}
FIELDS = {
    "title": "title", "shorttitle": "title-short", "journal": "container-title", "journaltitle": "container-title", "shortjournal": "journalAbbreviation",
    "volume": "volume", "number": "issue", "issue": "issue", "pages": "page", "publisher": "publisher", "address": "publisher-place", "location": "publisher-place",
    "edition": "edition", "series": "collection-title", "abstract": "abstract", "doi": "DOI", "url": "URL", "isbn": "ISBN", "issn": "ISSN", "language": "language",
    "type": "genre", "institution": "publisher", "school": "publisher", "organization": "publisher", "howpublished": "medium", "chapter": "chapter-number",
    "pagetotal": "number-of-pages", "volumes": "number-of-volumes", "version": "version", "pmid": "PMID", "pmcid": "PMCID",
}
CREATORS = {"author": "author", "editor": "editor", "translator": "translator", "bookauthor": "container-author", "editora": "editor", "director": "director", "commentator": "contributor"}
RECORD = "cslType:string,fields:map<string,string>,creators:array<struct<cslName:string,family:string,given:string,literal:string>>,tags:array<string>,extra:array<string>,label:string,warnings:array<string>"
_ENTRY = re.compile(r"@([A-Za-z]+)\s*([{(])")
_NEXT = re.compile(r"\n[ \t]*(?=@[A-Za-z]+[ \t]*[{(])")
_FIELD = re.compile(r"\s*([^=,\s{}()]+)\s*=")
_BARE = re.compile(r"\s*([^,})#\s]+)")


def _group(text: str, at: int, end: int) -> int:
    """Where the group or quotation that opens at `at` closes, or -1."""
    close = {"{": "}", "(": ")", '"': '"'}[text[at]]
    depth = 0
    for m in re.compile(r'\\.|[{}()"]', re.S).finditer(text, at + 1, end):
        if m[0] == close and depth == 0:
            return m.start()
        if close == ")":
            depth += {"(": 1, ")": -1}.get(m[0], 0)
        else:
            depth += {"{": 1, "}": -1}.get(m[0], 0)
    return -1


def _value(text: str, at: int, end: int, macros: dict[str, str]) -> tuple[str, int, bool]:
    """A value made of groups, quotations and macros joined by "#": what it says, where it ends, whether it was closed."""
    parts = []
    while True:
        while at < end and text[at].isspace():
            at += 1
        if at < end and text[at] in '{"':
            close = _group(text, at, end)
            if close < 0:
                return "".join(parts), end, False
            parts.append(text[at + 1 : close])
            at = close + 1
        elif m := _BARE.match(text, at, end):
            parts.append(macros.get(m[1].lower(), m[1]))
            at = m.end()
        more = re.compile(r"\s*#").match(text, at, end)
        if not more:
            return "".join(parts), at, True
        at = more.end()


def _fields(text: str, at: int, end: int, macros: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    out, warnings = {}, []
    while m := _FIELD.match(text, at, end):
        key = m[1].lower()
        value, at, closed = _value(text, m.end(), end, macros)
        if not closed:
            return out, [*warnings, f'the value of "{key}" is never closed; it and what follows in the entry is lost']
        if key in out:
            joins = " and " if key in CREATORS else ("; " if ";" in out[key] + value else ", ") if key in ("keywords", "keyword") else None
            warnings.append(f'"{key}" comes more than once')
            out[key] = out[key] + joins + value if joins else out[key]
        else:
            out[key] = value
        comma = re.compile(r"\s*,").match(text, at, end)
        if not comma:
            break
        at = comma.end()
    return out, warnings


def entries(text: str, known: dict[str, str] | None = None) -> list[tuple[str, str, dict[str, str], list[str]]]:
    """(type, key, fields as written, warnings) of every entry; a broken one ends where the next begins on a line of its own.

    known: macros of the text before this one; those of this text are added to it.
    """
    macros = {} if known is None else known
    for m in MONTHS:
        macros.setdefault(m[:3].lower(), m)
    out, at = [], 0
    while m := _ENTRY.search(text, at):
        kind, begin = m[1].lower(), m.end()
        following = _NEXT.search(text, begin)
        limit = following.end() if following else len(text)
        close = _group(text, begin - 1, limit)
        end = close if close >= 0 else limit
        at = end + (close >= 0)
        if kind in ("comment", "preamble"):
            continue
        if kind == "string":
            macros.update({k.lower(): v for k, v in _fields(text, begin, end, macros)[0].items()})
            continue
        key = re.compile(r"\s*([^,]*?)\s*(?:,|$)").match(text[begin:end])
        first, warnings = key[1], []
        if re.search(r"[\s=]", first):
            lead = re.compile(r"\s*([^\s=]+)(\s*)(=?)").match(text, begin, end)
            if lead[3] or _FIELD.match(text, lead.end(2), end):  # a key without its comma, or no key at all
                warnings = ["there is no comma after the key"]
                first, start = ("", begin) if lead[3] else (lead[1], lead.end(2))
            else:
                warnings, start = ["the key has a blank"], begin + key.end()
        else:
            start = begin + key.end()
        fields, more = _fields(text, start, end, macros)
        warnings += more + ([] if close >= 0 or more else ["the entry is never closed"])
        out.append((kind, first, fields, warnings))
    return out


def date_of(fields: dict[str, str]) -> str | None:
    """The date, or year and month, as the beginning of an ISO date where the month can be read."""
    told, year, month = (latex.decode(fields.get(k, "")) for k in ("date", "year", "month"))
    if told or not (year and month):
        return told or year or month or None
    number = month if month.isdigit() and len(month) < 3 else next((str(k + 1) for k, m in enumerate(MONTHS) if m[:3].lower() == month[:3].lower()), None)
    return f"{year}-{int(number):02d}" if number else f"{month} {year}"


def record(kind: str, key: str, raw: dict[str, str], warnings: list[str], nth: int) -> dict:
    fields, creators, tags, extra = {}, [], [], []
    for k, v in raw.items():
        if not v.strip() or k in ("year", "month", "date", "subtitle"):
            continue
        if k == "crossref":
            warnings = [*warnings, f"fields inherited from {latex.decode(v)} are missing"]
        elif k in CREATORS:
            names = [n for n in latex.split_outside(v, r"\s+(?i:and)\s+") if n.strip()]
            creators += [dict(zip(("cslName", "family", "given", "literal"), (CREATORS[k], *latex.name(n)), strict=True)) for n in names]
        elif k in ("keywords", "keyword"):
            text = latex.decode(v)
            tags += [t.strip() for t in text.split(";" if ";" in text else ",") if t.strip()]
        elif k in ("booktitle", "maintitle"):
            fields["container-title" if raw.get("title") else "title"] = latex.decode(v)
        elif k in FIELDS:
            fields[FIELDS[k]] = re.sub(r"\s*[-–—]+\s*", "-", latex.decode(v)) if k == "pages" else latex.decode(v)
        else:
            extra.append(f"{k}: {latex.decode(v)}")
    if raw.get("subtitle", "").strip():
        fields["title"] = ": ".join(x for x in (fields.get("title"), latex.decode(raw["subtitle"])) if x)
    issued = date_of(raw)
    fields |= ({"issued": issued} if issued else {}) | ({"citation-key": key} if key else {})
    if kind not in TYPES:
        warnings = [*warnings, f"@{kind} is no known type"]
    return {"cslType": TYPES.get(kind, "document"), "fields": fields, "creators": creators, "tags": tags, "extra": extra, "label": key or f"entry {nth + 1}", "warnings": warnings}


def read(files: DataFrame) -> DataFrame:
    """(doc, nth, record columns) of files(doc, text), a row for each entry."""

    @F.pandas_udf(f"array<struct<{RECORD}>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [record(*e, nth) for nth, e in enumerate(entries(t or ""))])

    return files.select("doc", F.posexplode(run("text")).alias("nth", "r")).select("doc", "nth", "r.*")
