"""LaTeX in bibliographies: characters, braces, and lists outside braces. Plain Python, for Arrow functions."""

from __future__ import annotations

import re
import unicodedata

#: Accent commands and the combining marks they stand for.
MARKS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", '"': "\u0308", "r": "\u030a", "H": "\u030b", "v": "\u030c", "d": "\u0323", "c": "\u0327", "k": "\u0328", "b": "\u0331"}
#: Commands that stand for a character.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "dh": "ð", "DH": "Ð", "th": "þ", "TH": "Þ", "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…", "copyright": "©", "pounds": "£", "S": "§", "P": "¶"}
_ACCENT = re.compile(r"\\(?:([`'^~=.\"])\s*|([urHvdckb])(?:\s+|(?=\{)))(?:\{\s*)?(\\[ij](?![A-Za-z])|[^\W\d_])(?(2)\s*\}?|\s*\}?)")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?\s*")
_DASH = [("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"), ("~", " ")]


def _accented(m: re.Match) -> str:
    letter = {"\\i": "i", "\\j": "j"}.get(m[3], m[3])
    closed = m[0].endswith("}") and "{" not in m[0]  # a brace that was opened before the accent
    return unicodedata.normalize("NFC", letter + MARKS[m[1] or m[2]]) + ("}" if closed else "")


def decode(text: str) -> str:
    """Readable text: accents and special characters as such, commands and braces dropped."""
    text = _ACCENT.sub(_accented, text)
    text = _COMMAND.sub(lambda m: LETTERS.get(m[1], ""), text)
    text = re.sub(r"\\([&%$#_{} ])", lambda m: {"{": "\x01", "}": "\x02"}.get(m[1], m[1]), text)
    for plain, mark in _DASH:
        text = text.replace(plain, mark)
    text = text.replace("{", "").replace("}", "").replace("\\", "").replace("\x01", "{").replace("\x02", "}")
    return re.sub(r"\s+", " ", text).strip()


def split_outside(text: str, separator: str) -> list[str]:
    """Parts between separators (a pattern) that are not inside braces."""
    depth, at, parts = 0, 0, []
    for m in re.finditer(rf"\\.|[{{}}]|(?P<cut>{separator})", text, re.S):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif m["cut"] is not None and depth == 0:
            parts.append(text[at : m.start()])
            at = m.end()
    return [*parts, text[at:]]


def is_group(text: str) -> bool:
    """Whether the whole text is one brace group."""
    return text.startswith("{") and text.endswith("}") and len(split_outside("{}" + text[1:-1] + "{}", "(?!)")) == 1 and _balanced(text[1:-1])


def _balanced(text: str) -> bool:
    depth = 0
    for m in re.finditer(r"\\.|[{}]", text, re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth < 0:
            return False
    return depth == 0


def name(text: str) -> tuple[str | None, str | None, str | None]:
    """(family, given, literal) of a name: "von Last, Jr, First", "First von Last", or a braced name as a whole."""
    text = text.strip()
    if is_group(text):
        return None, None, decode(text)
    parts = [decode(p) for p in split_outside(text, ",")]
    if len(parts) > 1:
        return parts[0], " ".join(p for p in reversed(parts[1:]) if p) or None, None
    words = split_outside(text, r"\s+")
    if len(words) == 1:
        return decode(words[0]), None, None
    small = [k for k, w in enumerate(words[:-1]) if re.match("[a-z]", re.sub(r"[{\\]", "", w))]
    cut = small[0] if small else len(words) - 1
    return decode(" ".join(words[cut:])), decode(" ".join(words[:cut])) or None, None
