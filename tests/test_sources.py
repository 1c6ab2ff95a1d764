"""Bibliographies and books, on literals."""

import io
import random
import re
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quirelake.functions import chunks
from quirelake.operators import retrieval
from quirelake.sources import bibliography, bibtex, epub, latex

BIB = r"""% a comment with an @ in it
@string{jml = "Journal of " # "Learning"}
@article{lovelace1843, title = {Notes on the {Analytical} Engine}, author = {Ada Lovelace and {Royal Society} and von Neumann, Jr, John},
  journal = jml, year = 1843, month = sep, pages = {666--731}, keywords = "engine; notes", keywords = {history}, note = {a {nested {brace}} here}}
@book(godel, author = "Kurt G{\"o}del and Jos\'{e} de la Cruz", title = "On \emph{formally} undecidable \& open", publisher = {X}, publisher = {Y}, date={1931-02})
@misc{key title = {No comma}, year = 2001}
@misc{broken, title = {never closed, year = 2000
@inproceedings{after, booktitle = {Proceedings}, title={Last}, subtitle={one}, crossref={godel}}
@comment{@article{no, title={x}}}
"""
RIS = "\ufeffTY  - JOUR\r\nTI  - A title\r\n  that goes on\r\nT1  - Another\r\nAU  - Doe, Jane\r\nAU  - Plato\r\nA2  - John Q Public\r\nPY  - 2020/7/3/\r\nSP  - 1\r\nEP  - 9\r\nSN  - 1234-567X\r\nSN  - 9780262033848\r\nKW  - a; b\r\nKW  - c\r\nID  - doe20\r\nXX  - odd\r\nER  - \r\nlost\r\nTY  - ZZZZ\r\nBT  - Only\r\nDA  - spring"
CSL = '[{"id":"x1","type":"book","title":"T","author":[{"family":"Doe","given":"J"},{"literal":"Org"},"Plain"],"issued":{"date-parts":[[2020,7,3]]},"accessed":{"raw":"now"},"keyword":"a, b","volume":3,"custom2":{"k":1}},{"title":"no type"}]'


def records(df):
    return [r.asDict(recursive=True) for r in df.orderBy("doc", "nth").collect()]


def test_bibtex(spark):
    out = records(bibtex.read(spark.createDataFrame([(1, BIB), (2, None)], "doc int, text string")))
    a, g, m, broken, last = out
    assert [r["label"] for r in out] == ["lovelace1843", "godel", "key", "broken", "after"]
    assert a["fields"] == {"title": "Notes on the Analytical Engine", "container-title": "Journal of Learning", "page": "666-731", "issued": "1843-09", "citation-key": "lovelace1843"}
    assert [(c["family"], c["given"], c["literal"]) for c in a["creators"]] == [("Lovelace", "Ada", None), (None, None, "Royal Society"), ("von Neumann", "John Jr", None)]
    assert a["tags"] == ["engine", "notes", "history"] and a["extra"] == ["note: a nested brace here"] and len(a["warnings"]) == 1
    assert [(c["family"], c["given"]) for c in g["creators"]] == [("Gödel", "Kurt"), ("de la Cruz", "José")]
    assert g["fields"]["title"] == "On formally undecidable & open" and g["fields"]["publisher"] == "X" and g["fields"]["issued"] == "1931-02"
    assert m["fields"] == {"title": "No comma", "issued": "2001", "citation-key": "key"} and broken["fields"] == {"citation-key": "broken"} and broken["warnings"]
    assert last["fields"] == {"title": "Last: one", "container-title": "Proceedings", "citation-key": "after"} and last["cslType"] == "paper-conference"


def test_latex():
    pairs = {r"{\'E}t{\'e}": "Été", r"\c{c}a va": "ça va", r"\v{S}koda \o re": "Škoda øre", r"Stra{\ss}e": "Straße", r"a--b ``q''": "a–b “q”", r"\textbf{x} 5\% \{y\}": "x 5% {y}", r"na{\"\i}ve": "naïve"}
    assert {k: latex.decode(k) for k in pairs} == pairs


def test_ris(spark):
    a, b = records(bibliography.ris(spark.createDataFrame([(1, RIS)], "doc int, text string")))
    assert a["fields"] == {"title": "A title that goes on", "page": "1-9", "issued": "2020-07-03", "ISSN": "1234-567X", "ISBN": "9780262033848"}
    assert [(c["cslName"], c["family"], c["given"], c["literal"]) for c in a["creators"]] == [("author", "Doe", "Jane", None), ("author", None, None, "Plato"), ("editor", "Public", "John Q", None)]
    assert a["tags"] == ["a", "b", "c"] and a["extra"] == ["T1: Another", "Citation Key: doe20", "XX: odd"] and a["label"] == "doe20" and a["warnings"] == []
    assert b["fields"] == {"title": "Only", "issued": "spring"} and b["cslType"] == "document" and len(b["warnings"]) == 2


def test_csl_json(spark):
    files = spark.createDataFrame([(1, CSL), (2, '{"items": ' + CSL + "}"), (3, "no json")], "doc int, text string")
    a, b, c, _ = records(bibliography.csl_json(files))
    assert a["fields"] == {"title": "T", "volume": "3", "issued": "2020-07-03", "accessed": "now", "citation-key": "x1"} == c["fields"]
    assert [(x["family"], x["given"], x["literal"]) for x in a["creators"]] == [("Doe", "J", None), (None, None, "Org"), (None, None, "Plain")]
    assert a["tags"] == ["a", "b"] and a["extra"] == ['custom2: {"k":1}'] and b["cslType"] == "document" and b["label"] == "no type"


def test_sniff(spark):
    got = [spark.range(1).select(bibliography.sniff(F.lit(t)).alias("x")).first()["x"] for t in (BIB, RIS, CSL, "none")]
    assert got == ["bibtex", "ris", "csl-json", None]


def test_items_of_records(spark):
    r = bibliography.csl_json(spark.createDataFrame([(1, CSL)], "doc int, text string")).withColumn("id", F.col("nth"))
    types = spark.createDataFrame([("book", "book", 1), ("book", "manuscript", 2)], "cslType string, itemType string, ord int")
    fields = spark.createDataFrame([("book", "title", "title", 1), ("book", "issued", "date", 1), ("book", "accessed", "date", 2), ("document", "title", "title", 1)], "itemType string, variable string, field string, ord int")
    roles = spark.createDataFrame([("book", "author", "author", True)], "itemType string, cslName string, creatorType string, primary boolean")
    out = {x["id"]: x.asDict(recursive=True) for x in bibliography.to_items(r, types, fields, roles).collect()}
    assert out[0]["itemType"] == "book" and out[0]["fields"] == {"title": "T", "date": "now"} and len(out[0]["creators"]) == 3
    assert out[0]["extra"] == 'custom2: {"k":1}\ncitation-key: x1\nissued: 2020-07-03\nvolume: 3' and out[1]["fields"] == {"title": "no type"}
    assert [x["ok"] for x in r.select(bibliography.has_content(F.col("fields"), F.col("creators"), F.col("extra")).alias("ok")).collect()] == [True, True]


def test_epub(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", '<package><manifest><item id="b" href="two.xhtml"/><item id="a" href="one%20.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="none"/></spine></package>')
        z.writestr("OPS/one .xhtml", "<html><head><title>no</title></head><body><p>First &amp; foremost</p></body></html>")
        z.writestr("OPS/two.xhtml", "<p>Second</p>")
    files = spark.createDataFrame([("x", bytearray(out.getvalue())), ("y", bytearray(b"no zip"))], "path string, content binary")
    assert {r["path"]: r["text"] for r in epub.read(files).collect()} == {"x": "First & foremost\n\nSecond", "y": ""}


def plain_passages(text, size, overlap, words):
    """Passages one by one: the end at the last blank of the second half, the next begin overlap before it."""
    out, at = [], 0
    while at < len(text):
        if words:
            while at < len(text) and text[at].isspace():
                at += 1
            if 0 < at < len(text) and not text[at - 1].isspace():
                rest = at + len(re.match(r"\S+\s*", text[at:])[0])
                at = rest if rest < len(text) and rest - at < size else at
            if at >= len(text):
                break
        end = min(at + size, len(text))
        blanks = [k for k in range(at, end + 1) if k < len(text) and text[k].isspace() and k > at + size / 2] if end < len(text) else []
        end = blanks[-1] if blanks else end
        said = text[at:end].rstrip() if words else text[at:end].strip()
        out.append({"index": len(out), "text": said} | ({"start": at, "end": at + len(said)} if words else {}))
        at = len(text) if end == len(text) else max(end - overlap, at + 1)
    return out


def test_passages(spark):
    text = "one two three\nfour  five sixsix seven " * 40
    whole = " ".join(text.split())
    cut = lambda t, size, overlap, words: chunks._listed(pa.array([t]), size, overlap, words).to_pylist()[0]
    parts = cut(whole, 100, 20, False)
    assert all(len(p["text"]) <= 100 and p["text"] in whole for p in parts) and parts[-1]["text"].endswith("seven")
    placed = cut(text, 100, 20, True)
    assert all(text[p["start"] : p["end"]] == p["text"] for p in placed)
    assert all(p["start"] == 0 or text[p["start"] - 1].isspace() for p in placed)
    covered = set().union(*(range(p["start"], p["end"]) for p in placed))
    assert all(text[k].isspace() for k in range(len(text)) if k not in covered)
    assert cut("x" * 950, 400, 50, True)[-1]["end"] == 950
    r = random.Random(1)
    texts = [None, "", " ", *["".join(r.choice([" ", "\n", *"abé漢😀" * 4]) for _ in range(r.randint(0, 200))) for _ in range(100)]]
    for size, overlap in ((5, 2), (20, 5), (50, 60), (800, 100), (1, 0)):
        for words in (True, False):
            some = [t if words or t is None else " ".join(t.split()) for t in texts]
            assert chunks._listed(pa.array(some), size, overlap, words).to_pylist() == [plain_passages(t or "", size, overlap, words) for t in some]
    s = spark.range(1).select(chunks.snippet(F.lit("word " * 100 + "théorie des jeux " + "more " * 100), ["theorie"], 60).alias("s")).first()["s"]
    assert "théorie" in s and s.startswith("… ") and s.endswith(" …")


def test_rank_within(spark):
    rows = [(1, 0, "heron heron lake"), (1, 1, "lake"), (2, 0, "nothing"), (2, 1, "a heron")]
    out = retrieval.rank_within(spark.createDataFrame(rows, "doc int, id int, text string"), "heron", 1).collect()
    assert {(r["doc"], r["id"]) for r in out} == {(1, 0), (2, 1)}


def test_section_and_page(spark):
    text = "1. First part\nwords here\n\nRESULTS AND MORE\nother words"
    row = spark.range(1).select(chunks.section_before(F.lit(text), F.lit(20)).alias("a"), chunks.section_before(F.lit(text), F.lit(50)).alias("b"), chunks.approximate_page(F.lit(50), F.lit(100), F.lit(4)).alias("p")).first()
    assert (row["a"], row["b"], row["p"]) == ("1. First part", "RESULTS AND MORE", 3)
