"""Normal forms of Unicode as Column expressions: canonical composition, and tables that give a character several.

The tables are made from the character database of the Python that builds the plan. A table of single characters
is one translate(); where a character stands for several, there is one translate() for each of them. Texts without a mark
or a character that composition changes are left as they are by one test.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with a decomposition, but for Hangul syllables, which have rules of their own.
POINTS = [chr(k) for r in (range(0xA0, 0xAC00), range(0xF900, 0x10000), range(0x10000, 0x20000), range(0x2F800, 0x2FA20)) for k in r if unicodedata.decomposition(chr(k))]


def among(chars: str) -> str:
    """A pattern's class of the characters, as ranges; what lies below the first of them is told apart by one test."""
    points, ranges = sorted({ord(c) for c in chars}), []
    for k in points:
        if ranges and k == ranges[-1][1] + 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    listed = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
    return rf"[[\x{{{points[0]:X}}}-\x{{10FFFF}}]&&[{listed}]]"


def expanded(c: Column, table: dict[str, str]) -> Column:
    """What the table gives for c, one character; c itself if it isn't listed."""
    out = c
    for size in sorted({len(v) for v in table.values()}):
        own = "".join(k for k, v in table.items() if len(v) == size)
        places = [F.translate(c, own, "".join(table[k][at] for k in own)) for at in range(size)]
        out = F.when(F.instr(F.lit(own), c) > 0, F.concat(*places) if places else F.lit("")).otherwise(out)
    return out


def letters(c: Column) -> Column:
    """array of the code points of a text."""
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


@cache
def _tables(keep: str) -> tuple[dict[str, str], dict[str, str], dict[str, tuple[str, str]], str, str]:
    """Of the canonical forms: one character for another, one for several, what each second one makes of the first, marks and their classes."""
    nfc, nfd = (lambda x: unicodedata.normalize("NFC", x)), (lambda x: unicodedata.normalize("NFD", x))
    single = {c: nfc(c) for c in POINTS if c not in keep and nfc(c) != c and len(nfc(c)) == 1}
    apart = {c: nfd(c) for c in POINTS if c not in keep and nfd(c) != c}
    pairs: dict[str, tuple[str, str]] = {}
    for c in apart:
        parts = [chr(int(x, 16)) for x in unicodedata.decomposition(c).split() if not x.startswith("<")]
        if len(parts) == 2 and nfc("".join(parts)) == c and parts[0] not in keep:
            first, made = pairs.get(parts[1], ("", ""))
            pairs[parts[1]] = (first + parts[0], made + c)
    marks = "".join(chr(k) for r in (range(0x300, 0x3100), range(0xA000, 0xAC00), range(0xFB00, 0xFE30), range(0x10000, 0x1F000)) for k in r if unicodedata.combining(chr(k)))
    return single, apart, pairs, marks, "".join(chr(0x100 + unicodedata.combining(c)) for c in marks)


def composed(c: Column, keep: str = "") -> Column:
    """c in the canonical composed form. The characters of keep stay as they are and take no mark.

    A letter with what follows it is taken apart, its marks are sorted by class, and each is joined to the letter that has
    a composed form with it, unless a mark of the same class before it stays. Hangul letters go by their own arithmetic.
    """
    single, apart, pairs, marks, classes = _tables(keep)
    several = {k: v for k, v in apart.items() if unicodedata.normalize("NFC", k) != k and k not in single}
    second = "".join(x for x in pairs if x not in marks)  # letters of some scripts that join the one before them
    joins = rf"[\p{{M}}{second}]"
    odd = among("".join(several)) if several else "(?!)"
    syllable = "[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]"
    #: Latin-1 letters are passed over at once, up to one that a mark follows; no other alternative begins with them.
    piece = rf"(?s)[\x{{0}}-\x{{FF}}]+(?!{joins})|{syllable}|.{joins}+|{odd}|(?:(?!.{joins}|{odd}|{syllable}).)+"

    def join(first: Column, mark: Column, table: dict[str, tuple[str, str]] = pairs) -> Column:
        """The composed form, or null."""
        out = F.lit(None).cast("string")
        for m, (before, made) in sorted(table.items(), reverse=True):  # the last one is asked first: marks of Latin letters
            out = F.when(mark == m, F.when((first != "") & (F.instr(F.lit(before), first) > 0), F.translate(first, before, made))).otherwise(out)
        return out

    def grown(state: Column, x: Column) -> Column:
        """state: done (text before the last letter), first (that letter), rest (its marks that stayed), last (class of the last of these)."""
        mark, kind = x["mark"], x["class"]
        blocked = (state["rest"] != "") & ((state["last"] >= kind) | (kind == chr(0x100)))
        made = F.when(~blocked, join(state["first"], mark))
        whole = F.concat(state["done"], state["first"], state["rest"])
        fresh = F.struct(whole.alias("done"), mark.alias("first"), F.lit("").alias("rest"), F.lit(chr(0x100)).alias("last"))
        stay = F.struct(state["done"].alias("done"), state["first"].alias("first"), F.concat(state["rest"], mark).alias("rest"), kind.alias("last"))
        new = F.struct(state["done"].alias("done"), made.alias("first"), state["rest"].alias("rest"), state["last"].alias("last"))
        return F.when(made.isNotNull(), new).when(kind == chr(0x100), fresh).otherwise(stay)

    def compose(x: Column) -> Column:
        each = letters(F.array_join(F.transform(letters(x), lambda y: expanded(y, apart)), ""))
        each = F.transform(each, lambda m: F.struct(m.alias("mark"), F.when(F.instr(F.lit(marks), m) > 0, F.translate(m, marks, classes)).otherwise(F.lit(chr(0x100))).alias("class")))
        #: Marks are sorted by class between two letters; a letter's number orders them.
        zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<n:int,class:string,at:int,mark:string>>").alias("list"))
        numbered = F.aggregate(each, zero, lambda a, m: _numbered(a, m))["list"]
        ordered = F.transform(F.array_sort(numbered), lambda m: F.struct(m["mark"].alias("mark"), m["class"].alias("class")))
        begin = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("rest"), F.lit(chr(0x100)).alias("last"))
        end = F.aggregate(ordered, begin, grown)
        return F.concat(end["done"], end["first"], end["rest"])

    def hangul(x: Column) -> Column:
        """Leading, vowel and trailing letters as one syllable; a syllable takes a trailing letter."""
        at = lambda k, base: F.ascii(F.substring(x, k, 1)) - base
        whole = F.ascii(x) >= 0xAC00
        lv = F.when(whole, F.ascii(x)).otherwise(0xAC00 + (at(1, 0x1100) * 21 + at(2, 0x1161)) * 28)
        tail = F.substring(x, F.when(whole, 2).otherwise(3), F.lit(1))
        takes = (lv - 0xAC00) % 28 == 0
        code = lv + F.when((tail != "") & takes, F.ascii(tail) - 0x11A7).otherwise(0)
        return F.concat(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32"), F.when(takes, F.lit("")).otherwise(tail))

    #: One mark alone behind a letter of ASCII is told apart by the end of a part; others have no form with such a letter.
    mark = r"\x{300}-\x{343}\x{345}-\x{36F}"
    parts = rf"(?s)[^{mark}]++[{mark}](?!{joins})|[^{mark}]++|[{mark}]+"
    latin = {m: tuple("".join(x for b, x in zip(before, kind, strict=True) if b.isascii()) for kind in (before, made)) for m, (before, made) in pairs.items() if 0x300 <= ord(m) < 0x370}
    latin = {m: own for m, own in latin.items() if own[0]}

    def quick(x: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(x, F.lit(parts), F.lit(0)), lambda y: F.struct(y.alias("part"), F.substring(y, -2, 1).alias("first"), F.substring(y, -1, 1).alias("mark")))
        return F.array_join(F.transform(ends, lambda y: F.coalesce(F.concat(F.substr(y["part"], F.lit(1), F.length(y["part"]) - 2), join(y["first"], y["mark"], latin)), y["part"])), "")

    def slow(x: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(piece), F.lit(0)), lambda x: F.when(x.rlike(rf"^(?:{syllable})$"), hangul(x)).when(x.rlike(f"^[A-Za-z][{mark}]$"), x).when(x.rlike(rf"(?s)^(?:.{joins}+|{odd})$"), compose(x)).otherwise(x)), "")

    #: What composition changes, by one class; what lies below the first mark is told apart by one test.
    left = rf"[[\x{{300}}-\x{{10FFFF}}]&&[\p{{M}}{second}{''.join(several)}ᅡ-ᅵᆨ-ᇂ]]"
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    plain = once(c, lambda x: F.when(x.rlike(among("".join(single))), F.translate(x, "".join(single), "".join(single.values()))).otherwise(x))
    return once(plain, lambda x: F.when(x.rlike(left), once(quick(x), lambda y: F.when(y.rlike(left), slow(y)).otherwise(y))).otherwise(x))


def _numbered(a: Column, m: Column) -> Column:
    n = a["n"] + F.when(m["class"] == chr(0x100), 1).otherwise(0)
    own = F.struct(n.alias("n"), m["class"].alias("class"), F.size(a["list"]).alias("at"), m["mark"].alias("mark"))
    return F.struct(n.alias("n"), F.array_append(a["list"], own).alias("list"))
