"""Bibliographies as records: format, RIS and CSL-JSON with DataFrame functions, and records mapped to items.

A record has cslType, fields (map), creators (cslName, family, given, literal), tags, extra (lines), label and warnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: RIS types and tags, and what they are called in records.
RIS_TYPES = {
    "JOUR": "article-journal", "JFULL": "article-journal", "ABST": "article-journal", "INPR": "article-journal", "SER": "article-journal", "EJOUR": "article-journal",
    "MGZN": "article-magazine", "NEWS": "article-newspaper", "BOOK": "book", "EBOOK": "book", "EDBOOK": "book", "CHAP": "chapter", "ECHAP": "chapter",
    "CONF": "paper-conference", "CPAPER": "paper-conference", "THES": "thesis", "RPRT": "report", "GOVDOC": "report", "UNPB": "manuscript", "MANSCPT": "manuscript",
    "ELEC": "webpage", "WEB": "webpage", "BLOG": "post-weblog", "COMP": "software", "DATA": "dataset", "DBASE": "dataset", "PAT": "patent", "CASE": "legal_case",
    "STAT": "legislation", "BILL": "bill", "HEAR": "hearing", "MAP": "map", "ART": "graphic", "FIGURE": "graphic", "CHART": "graphic", "VIDEO": "motion_picture",
    "MPCT": "motion_picture", "SOUND": "song", "MUSIC": "song", "SLIDE": "speech", "ICOMM": "personal_communication", "PCOMM": "personal_communication",
    "STAND": "standard", "GEN": "document",
}
RIS_FIELDS = {
    "TI": "title", "T1": "title", "CT": "title", "T2": "container-title", "JO": "container-title", "JF": "container-title", "JA": "journalAbbreviation",
    "J1": "journalAbbreviation", "J2": "journalAbbreviation", "T3": "collection-title", "VL": "volume", "IS": "issue", "CP": "issue", "PB": "publisher",
    "CY": "publisher-place", "PP": "publisher-place", "AB": "abstract", "N2": "abstract", "DO": "DOI", "UR": "URL", "ET": "edition", "LA": "language",
    "M3": "genre", "SE": "section", "VO": "volume", "NV": "number-of-volumes",
}
RIS_CREATORS = {"AU": "author", "A1": "author", "A2": "editor", "A3": "editor", "A4": "contributor", "ED": "editor", "TA": "translator"}
RIS_EXTRA = {"AN": "Accession Number", "C1": "Custom 1", "DB": "Database", "DP": "Database Provider", "M1": "Number", "M2": "Start Page", "N1": "Notes", "RN": "Research Notes", "RI": "Reviewed Item", "ID": "Citation Key", "CN": "Call Number"}
RIS_OTHERS = ["TY", "ER", "SP", "EP", "PY", "Y1", "DA", "Y2", "KW", "SN", "BT", "L1", "L2", "L3", "L4"]
#: CSL variables that hold names, dates, or nothing bibliographic.
NAMES = "author chair collection-editor compiler composer container-author contributor curator director editor editorial-director executive-producer guest host illustrator interviewer narrator organizer original-author performer producer recipient reviewed-author script-writer series-creator translator".split()
DATES = "issued accessed submitted original-date event-date available-date".split()
IGNORED = "id type schema citation-key custom categories journalAbbreviation-short".split()
CREATOR = "struct<cslName:string,family:string,given:string,literal:string>"


def sniff(text: Column) -> Column:
    """csl-json, bibtex, ris, or null."""
    return F.when(text.rlike(r"(?s)^\W*?[\[{]") & text.rlike(r"(?s)^\s*\ufeff?\s*[\[{]"), "csl-json").when(text.rlike(r"@\s*[A-Za-z]+\s*[{(]"), "bibtex").when(text.rlike(r"(?m)^\ufeff?[A-Z][A-Z0-9]\s{1,3}-"), "ris")


def keywords(c: Column) -> Column:
    """Keywords between semicolons, else between commas."""
    parts = F.when(c.contains(";"), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda t: t != "")


def iso_prefix(c: Column) -> Column:
    """2020/7/3/ as 2020-07-03, 2020// as 2020; else as it is."""
    parts = F.slice(F.transform(F.split(c, "/"), lambda x: F.trim(x)), 1, 3)
    good = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("on")), lambda a, p: F.struct(F.when(a["on"] & p.rlike("^[0-9]+$"), F.array_append(a["kept"], F.when(F.size(a["kept"]) == 0, p).otherwise(F.lpad(p, 2, "0")))).otherwise(a["kept"]).alias("kept"), (a["on"] & p.rlike("^[0-9]+$")).alias("on")))["kept"]
    return F.when(F.size(good) > 0, F.array_join(good, "-")).otherwise(F.trim(c))


def ris_name(c: Column, variable: Column) -> Column:
    parts, words = F.transform(F.split(c, ","), lambda x: F.trim(x)), F.split(F.trim(c), r"\s+")
    given = F.array_join(F.filter(F.slice(parts, 2, 100), lambda p: p != ""), " ")
    inverted, single = (F.size(parts) > 1) & (parts[0] != ""), F.size(words) < 2
    none = F.lit(None).cast("string")
    family = F.when(inverted, parts[0]).when(~single, F.element_at(words, -1))
    first = F.when(inverted, F.nullif(given, F.lit(""))).when(~single, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.struct(variable.alias("cslName"), family.alias("family"), first.alias("given"), F.when(~inverted & single, F.trim(c)).otherwise(none).alias("literal"))


def _map(entries: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])[key]


def ris(files: DataFrame) -> DataFrame:
    """(doc, nth, record columns) of files(doc, text), a row for each record; a record without its end is kept with a warning."""
    lines = files.select("doc", F.posexplode(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r\n|\r|\n")).alias("pos", "line"))
    pattern = r"^([A-Z][A-Z0-9])\s{1,3}-\s?(.*)$"
    line = lines.select("doc", "pos", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).alias("tag"), F.when(F.col("line").rlike(pattern), F.trim(F.regexp_extract("line", pattern, 2))).otherwise(F.trim("line")).alias("value"))
    order = Window.partitionBy("doc").orderBy("pos")
    before = F.last("tag", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("tag") == "TY") | ((F.col("tag") != "ER") & (before.isNull() | (before == "ER")))
    line = line.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    line = line.withColumns({"rec": F.sum("begins").over(order), "own": F.last(F.when(F.col("tag").isNotNull(), F.struct("pos", "tag")), ignorenulls=True).over(order)})
    #: A line without a tag goes on with the tag before it, but not after a record's first or last line.
    told = line.filter((F.col("rec") > 0) & (F.col("tag").isNotNull() | ((F.col("value") != "") & ~F.col("own.tag").isin("TY", "ER"))))
    values = told.groupBy("doc", "rec", F.col("own.pos").alias("pos"), F.col("own.tag").alias("tag")).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ")).alias("value"))
    by_tag = Window.partitionBy("doc", "rec", "tag")
    rows = values.withColumn("ord", F.struct(F.min("pos").over(by_tag).alias("t"), "pos")).withColumn("variable", _map(RIS_FIELDS, F.col("tag")))
    same = Window.partitionBy("doc", "rec", "variable").orderBy("ord")
    filled = F.when(F.col("value") != "", F.col("value"))
    rows = rows.withColumn("first", F.when(F.col("variable").isNotNull(), F.first(filled, ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).withColumn("is_first", F.when(F.col("variable").isNotNull() & filled.isNotNull(), F.count(filled).over(same) == 1))
    tag, text = F.col("tag"), F.col("value") != ""
    extra = F.when(F.col("variable").isNotNull(), F.when(text & (F.col("value") != F.col("first")), F.concat(tag, F.lit(": "), "value"))).when(~tag.isin(*RIS_CREATORS, *RIS_OTHERS) & text, F.concat(F.coalesce(_map(RIS_EXTRA, tag), tag), F.lit(": "), "value"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("ord").alias("o"), c.alias("v"))))), lambda x: x["v"])
    one = lambda *tags: F.coalesce(*[F.min_by(F.when((tag == t) & text, F.col("value")), F.when((tag == t) & text, F.col("pos"))) for t in tags])
    issn = F.translate("value", " ", "").rlike("^[0-9]{4}-?[0-9]{3}[0-9xX]$")
    number = lambda good: F.min_by(F.when((tag == "SN") & text & good, F.col("value")), F.when((tag == "SN") & text & good, F.col("pos")))
    g = rows.groupBy("doc", "rec").agg(
        F.upper(one("TY")).alias("ty"), (F.count_if(tag == "ER") > 0).alias("closed"),
        F.map_from_entries(F.collect_list(F.when(F.col("is_first"), F.struct("variable", "value")))).alias("plain"),
        listed(F.when(tag.isin(*RIS_CREATORS) & text, ris_name(F.col("value"), _map(RIS_CREATORS, tag)))).alias("creators"),
        F.flatten(listed(F.when(tag == "KW", keywords(F.col("value"))))).alias("tags"), listed(extra).alias("extra"),
        one("BT").alias("bt"), one("SP").alias("sp"), one("EP").alias("ep"), one("DA", "PY", "Y1").alias("date"), number(issn).alias("issn"), number(~issn).alias("isbn"),
        one("ID", "TI", "T1").alias("label"), listed(F.when(tag.isin("L1", "L2", "L4") & text, F.concat(F.lit("points at the file "), "value"))).alias("links"),
    )
    added = {
        "title": F.when(F.col("plain")["title"].isNull(), F.col("bt")),
        "container-title": F.when(F.col("plain")["title"].isNotNull() & F.col("plain")["container-title"].isNull(), F.col("bt")),
        "page": F.when(F.col("sp").isNotNull(), F.concat_ws("-", "sp", "ep")), "issued": iso_prefix(F.col("date")), "ISSN": F.col("issn"), "ISBN": F.col("isbn"),
    }
    more = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in added.items()]), lambda x: x["value"].isNotNull()))
    kind = _map(RIS_TYPES, F.coalesce("ty", F.lit("")))
    warnings = F.array_compact(F.array(F.when(~F.col("closed"), "no ER line"), F.when(kind.isNull(), F.concat_ws("", F.lit("no known type: "), "ty"))))
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("rec")) - 1
    return g.select("doc", nth.alias("nth"), F.coalesce(kind, F.lit("document")).alias("cslType"), F.map_concat("plain", more).alias("fields"), F.col("creators").cast(f"array<{CREATOR}>").alias("creators"), "tags", "extra", F.coalesce("label", F.concat(F.lit("record "), nth + 1)).alias("label"), F.concat(warnings, "links").alias("warnings"))


def csl_date(value: Column) -> Column:
    """A CSL date (parts, raw or literal, or a plain string) as the beginning of an ISO date or as told."""
    d = F.from_json(value, "struct<`date-parts`:array<array<string>>,raw:string,literal:string>")
    parts = F.filter(F.transform(d["date-parts"][0], lambda x: F.trim(x)), lambda p: p != "")
    iso = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.lpad(p, 2, "0"))), "-")
    told = F.coalesce(F.nullif(iso, F.lit("")), F.nullif(F.trim(d["raw"]), F.lit("")), F.nullif(F.trim(d["literal"]), F.lit("")))
    return F.when(value.startswith("{"), told).otherwise(F.nullif(F.trim(value), F.lit("")))


def csl_names(variable: Column, value: Column) -> Column:
    """array of creators; an entry is an object with family and given or literal, or a plain string."""
    def one(x: Column) -> Column:
        o = F.from_json(x, "struct<family:string,given:string,literal:string>")
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        literal = F.when(x.startswith("{"), blank(o["literal"])).otherwise(blank(x))
        return F.struct(variable.alias("cslName"), F.when(literal.isNull(), blank(o["family"])).alias("family"), F.when(literal.isNull(), blank(o["given"])).alias("given"), literal.alias("literal"))

    return F.filter(F.transform(F.from_json(value, "array<string>"), one), lambda c: F.coalesce(c["family"], c["given"], c["literal"]).isNotNull())


def csl_json(files: DataFrame) -> DataFrame:
    """(doc, nth, record columns) of files(doc, text), each an array of items or an object that has one; text that isn't gives no row."""
    listed = F.coalesce(F.from_json("text", "array<map<string,string>>"), F.from_json("text", "struct<items:array<map<string,string>>>")["items"])
    item = files.select("doc", F.posexplode(listed).alias("nth", "m")).filter("m is not null")
    entries = F.map_entries("m")
    is_name, is_date, is_object = (lambda e: e["key"].isin(NAMES)), (lambda e: e["key"].isin(DATES)), (lambda e: e["value"].rlike(r"^[\[{]"))
    plain = lambda e: ~is_name(e) & ~is_date(e) & ~e["key"].isin(*IGNORED, "keyword") & e["value"].isNotNull()
    fields = F.transform(F.filter(entries, lambda e: plain(e) & ~is_object(e) & (F.trim(e["value"]) != "")), lambda e: F.struct(e["key"], F.trim(e["value"])))
    dates = F.filter(F.transform(F.filter(entries, is_date), lambda e: F.struct(e["key"].alias("key"), csl_date(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    key = F.when(F.trim(F.col("m")["id"]) != "", F.array(F.struct(F.lit("citation-key").alias("key"), F.trim(F.col("m")["id"]).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    creators = F.flatten(F.transform(F.filter(entries, is_name), lambda e: csl_names(e["key"], e["value"])))
    word = F.col("m")["keyword"]
    tags = F.when(word.startswith("["), F.from_json(word, "array<string>")).when(word.isNotNull(), keywords(word)).otherwise(F.array().cast("array<string>"))
    extra = F.transform(F.filter(entries, lambda e: plain(e) & is_object(e)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    kind = F.nullif(F.trim(F.col("m")["type"]), F.lit(""))
    label = F.coalesce(F.nullif(F.col("m")["id"], F.lit("")), F.nullif(F.col("m")["title"], F.lit("")), F.concat(F.lit("entry "), F.col("nth") + 1))
    pair = "array<struct<key:string,value:string>>"
    return item.select("doc", "nth", F.coalesce(kind, F.lit("document")).alias("cslType"), F.map_from_entries(F.concat(fields.cast(pair), dates.cast(pair), key)).alias("fields"), creators.cast(f"array<{CREATOR}>").alias("creators"), tags.alias("tags"), extra.alias("extra"), label.alias("label"), F.array_compact(F.array(F.when(kind.isNull(), "no type"))).alias("warnings"))


def has_content(fields: Column, creators: Column, extra: Column) -> Column:
    """Whether a record has anything but a key and keywords."""
    named = F.exists(creators, lambda c: F.coalesce(c["family"], c["given"], c["literal"]).isNotNull())
    lines = F.exists(extra, lambda x: (F.trim(x) != "") & ~F.lower(x).startswith("citation key:"))
    return named | lines | (F.size(F.map_filter(fields, lambda k, v: (k != "citation-key") & (F.trim(v) != ""))) > 0)


def to_items(records: DataFrame, types: DataFrame, fields: DataFrame, roles: DataFrame) -> DataFrame:
    """Records (with a column id) as items: id, itemType, fields (map), creators (creatorType, ...), tags, extra (text).

    types: cslType, itemType, ord. fields: itemType, variable, field, ord. roles: itemType, cslName, creatorType, primary.
    Of several candidates the first by ord is taken. A variable without a field, or whose field is taken, goes to extra as
    "variable: value"; a role that the type doesn't have becomes its primary one. The three tables are a schema's rows.
    """
    kind = types.groupBy("cslType").agg(F.min_by("itemType", "ord").alias("itemType"))
    own = records.join(F.broadcast(kind), "cslType", "left").withColumn("itemType", F.coalesce("itemType", F.lit("document")))
    first = fields.groupBy("itemType", "variable").agg(F.min_by("field", "ord").alias("field"))
    each = own.select("id", "itemType", F.explode("fields").alias("variable", "value")).filter("value <> ''").join(F.broadcast(first), ["itemType", "variable"], "left")
    nth = F.row_number().over(Window.partitionBy("id", "field").orderBy("variable"))
    placed = each.withColumn("lands", F.col("field").isNotNull() & (nth == 1))
    line = F.when(~F.col("lands"), F.concat("variable", F.lit(": "), "value"))
    gathered = placed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("lands"), F.struct("field", "value")))).alias("placed"), F.array_sort(F.collect_list(line)).alias("lines"))
    made = own.select("id", "itemType", F.posexplode("creators").alias("pos", "c")).join(F.broadcast(roles), (F.col("c.cslName") == roles["cslName"]) & (own["itemType"] == roles["itemType"]), "left").select("id", own["itemType"], "pos", "c", "creatorType")
    main = roles.filter("primary").select(F.col("itemType").alias("_t"), F.col("creatorType").alias("_main")).distinct()
    made = made.join(F.broadcast(main), F.col("itemType") == F.col("_t"), "left").select("id", "pos", F.struct(F.coalesce("creatorType", "_main", F.lit("author")).alias("creatorType"), "c.family", "c.given", "c.literal").alias("c"))
    people = made.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]).alias("people"))
    out = own.select("id", "itemType", "tags", "extra").join(gathered, "id", "left").join(people, "id", "left")
    lines = F.concat("extra", F.coalesce("lines", F.array().cast("array<string>")))
    return out.select("id", "itemType", F.coalesce("placed", F.create_map().cast("map<string,string>")).alias("fields"), F.col("people").alias("creators"), F.array_distinct(F.filter(F.transform("tags", lambda x: F.trim(x)), lambda t: t != "")).alias("tags"), F.nullif(F.array_join(lines, "\n"), F.lit("")).alias("extra"))
