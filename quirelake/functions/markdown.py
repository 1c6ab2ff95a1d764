"""Markdown to the HTML of a note, as Column expressions: a fold over lines for blocks, then the text of each block.

Headings, paragraphs, flat lists, block quotes, fenced code and rules; code, strong and emphasised text, strike-through, links and escapes.
Lists inside lists, tables and formulas stay as text. HTML in the text is escaped, and links go to a few schemes only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Schemes that a link may have, and how struck-out text is written.
SCHEMES = r"(?i)^(?:https?|mailto|ftp):"
STRUCK = ('<span style="text-decoration: line-through">', "</span>")
#: Characters that a backslash takes their meaning from, and what stands for them until the marks are read.
ESCAPED = "*_~"
_HELD = "".join(chr(0xFDD0 + k) for k in range(len(ESCAPED)))
_PIECE = r"(?s)`[^`]+`|\\[!-/:-@\[-`{-~]|\[[^\[\]]*\]\([^\s()]*\)|[^`\\\[]+|."


def html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _held(c: Column) -> Column:
    """Text whose marks are no marks."""
    return F.translate(html(c), ESCAPED, _HELD)


def inline(c: Column) -> Column:
    """The HTML of a text without blocks."""

    def piece(x: Column) -> Column:
        label, to = F.regexp_extract(x, r"(?s)^\[([^\[\]]*)\]", 1), F.regexp_extract(x, r"\(([^\s()]*)\)$", 1)
        shown = html(label)
        link = F.when(to.rlike(SCHEMES), F.concat(F.lit('<a href="'), F.replace(_held(to), F.lit('"'), F.lit("&quot;")), F.lit('">'), shown, F.lit("</a>"))).otherwise(shown)
        code = F.concat(F.lit("<code>"), _held(F.substr(x, F.lit(2), F.length(x) - 2)), F.lit("</code>"))
        return F.when(x.startswith("`") & (F.length(x) > 1), code).when(x.startswith("\\") & (F.length(x) == 2), _held(F.substr(x, F.lit(2)))).when(x.rlike(r"(?s)^\[[^\[\]]*\]\([^\s()]*\)$"), link).otherwise(html(x))

    out = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)), piece), "")
    out = F.regexp_replace(out, r"(?s)\*\*(?=\S)((?:(?!\*\*).|\*(?!\*))+?)(?<=\S)\*\*(?!\*)", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?s)\*(?=[^\s*])([^*]+?)(?<=\S)\*", "<em>$1</em>")
    out = F.regexp_replace(out, r"(?s)(?<![\p{L}\p{N}_])__(?=\S)([^_]+?)(?<=\S)__(?![\p{L}\p{N}_])", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?s)(?<![\p{L}\p{N}_])_(?=\S)([^_]+?)(?<=\S)_(?![\p{L}\p{N}_])", "<em>$1</em>")
    out = F.regexp_replace(out, r"(?s)~~(?=\S)([^~]+?)(?<=\S)~~", f"{STRUCK[0]}$1{STRUCK[1]}")
    return F.translate(F.regexp_replace(out, r" {2,}\n", "<br>"), _HELD, ESCAPED)


def note_html(c: Column) -> Column:
    """The HTML of a Markdown text, a line for each block; null counts as empty.

    A line opens a block, goes on with the one that is open (a paragraph, a quote, code, or the item of a list), or closes it. Code that is never closed ends with the text.
    """
    lines = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "\n")
    told = lambda s, **new: F.struct(*[(new[k] if k in new else s[k]).alias(k) for k in ("blocks", "open", "text")])
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("\n"), b))

    def closed(s: Column) -> Column:
        """All blocks, with what is open."""
        kind, text = s["open"], s["text"]
        items = F.array_join(F.transform(F.split(F.substr(text, F.lit(2)), "\u001e"), lambda x: F.concat(F.lit("<li>"), inline(x), F.lit("</li>"))), "\n")
        paragraphs = F.array_join(F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("<p>"), inline(x), F.lit("</p>"))), "\n")
        block = (
            F.when(kind == "p", F.concat(F.lit("<p>"), inline(F.rtrim(text)), F.lit("</p>")))
            .when(kind == "quote", F.concat(F.lit("<blockquote>\n"), paragraphs, F.lit("\n</blockquote>")))
            .when(kind == "code", F.concat(F.lit("<pre>"), html(F.substr(text, F.lit(2))), F.lit("</pre>")))
            .when(kind.isin("ul", "ol"), F.concat(F.lit("<"), kind, F.lit(">\n"), items, F.lit("\n</"), kind, F.lit(">")))
        )
        return F.when(kind == "", s["blocks"]).otherwise(joined(s["blocks"], block))

    def step(s: Column, line: Column) -> Column:
        """The line is read once into its kind and what it says."""
        heading, bullet, number, quote = (F.regexp_extract(line, p, 1) for p in (r"^ {0,3}(#{1,6})(?:\s|$)", r"^ {0,3}([-*+])\s+\S", r"^ {0,3}([0-9]{1,9}[.)])\s+\S", r"^ {0,3}(>)"))
        kind = (
            F.when(line.rlike(r"^ {0,3}(?:```|~~~)"), "fence").when(F.trim(line) == "", "blank").when(heading != "", "heading").when(line.rlike(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$"), "rule")
            .when(quote != "", "quote").when(bullet != "", "ul").when(number != "", "ol").otherwise("p")
        )
        said = F.when(kind == "heading", F.trim(F.regexp_replace(line, r"^ {0,3}#{1,6}\s*|\s+#+\s*$", ""))).when(kind == "quote", F.regexp_replace(line, r"^ {0,3}> ?", "")).when(kind.isin("ul", "ol"), F.regexp_replace(line, r"^ {0,3}(?:[-*+]|[0-9]{1,9}[.)])\s+", "")).otherwise(F.ltrim(line))
        return let(F.struct(kind.alias("kind"), said.alias("said"), F.length(heading).cast("string").alias("level")), lambda x: go(s, x, line))

    def go(s: Column, x: Column, line: Column) -> Column:
        kind, said, open_ = x["kind"], x["said"], s["open"]
        listed = kind.isin("ul", "ol")
        #: The text of code and lists begins with a mark, so that an empty first line or item counts.
        more = F.when(open_ == "code", F.concat(s["text"], F.when(s["text"] == "\u001e", F.lit("")).otherwise("\n"), line)).when(listed, F.concat(s["text"], F.lit("\u001e"), said)).otherwise(F.concat(s["text"], F.lit("\n"), said))
        goes_on = F.when(open_ == "code", kind != "fence").otherwise((open_ == kind) & kind.isin("p", "quote", "ul", "ol") | ((kind == "p") & open_.isin("quote", "ul", "ol")))
        alone = F.when(kind == "heading", F.concat(F.lit("<h"), x["level"], F.lit(">"), inline(said), F.lit("</h"), x["level"], F.lit(">"))).when(kind == "rule", "<hr>")
        start = F.when((kind == "fence") & (open_ != "code"), "code").when(kind.isin("p", "quote", "ul", "ol"), kind).otherwise("")
        text = F.when(start == "code", "\u001e").when(listed, F.concat(F.lit("\u001e"), said)).when(start != "", said).otherwise("")
        before = closed(s)
        fresh = told(s, blocks=F.when(alone.isNotNull(), joined(before, alone)).otherwise(before), open=start, text=text)
        return F.when(goes_on, told(s, text=more)).otherwise(fresh)

    zero = F.struct(F.lit("").alias("blocks"), F.lit("").alias("open"), F.lit("").alias("text"))
    return F.aggregate(lines, zero, step, closed)
