"""The readable text of EPUB books, in spine order: the binary files source, and a small unpacking helper in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text

#: Bytes that are unpacked from one book at most.
MOST_BYTES = 20 << 20


def _attributes(tag: str) -> dict[str, str]:
    return {k: v or w for k, v, w in re.findall(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)}


def chapters(raw: bytes) -> list[str]:
    """The markup of a book's chapters in the order of its spine; none if the file can't be read."""
    try:
        book = zipfile.ZipFile(io.BytesIO(raw))
        package = _attributes(re.search(r"<rootfile\s[^>]*>", book.read("META-INF/container.xml").decode("utf-8", "replace"))[0])["full-path"]
        opf = book.read(package).decode("utf-8", "replace")
        files = {a["id"]: a["href"] for a in map(_attributes, re.findall(r"<(?:\w+:)?item\s[^>]*>", opf)) if "id" in a and "href" in a}
        out, left = [], MOST_BYTES
        for a in map(_attributes, re.findall(r"<(?:\w+:)?itemref\s[^>]*>", opf)):
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(files.get(a.get("idref", ""), ""))))
            if path in book.namelist() and left > 0:
                with book.open(path) as f:
                    out.append(f.read(left).decode("utf-8", "replace"))
                left -= len(out[-1].encode())
        return out
    except (KeyError, TypeError, zipfile.BadZipFile):
        return []


def read(files: DataFrame) -> DataFrame:
    """(path, text) of files(path, content), as spark.read.format("binaryFile") gives them."""

    @F.pandas_udf("array<string>")
    def run(content: pd.Series) -> pd.Series:
        return content.map(chapters)

    parts = files.select("path", run("content").alias("c"))
    return parts.select("path", F.array_join(F.filter(F.transform("c", html_text), lambda t: t != ""), "\n\n").alias("text"))
