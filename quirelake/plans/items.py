"""Structured search, tags, hierarchy, text windows and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import asof, components, graph, incremental, items
from ..session import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items: words of the type as tags."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("itemType"), F.split("p_type", " ").alias("tags"), F.col("p_size").alias("version"), F.lit(None).cast("long").alias("parentItem"))


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("tags"), F.col("o_orderstatus").alias("itemType"))


def item_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 of large parts, by title."""
    found = items.search(_parts(spark, sf_dir), since=25)
    return items.page(found, "title", "key", start=50, limit=50).select("key", "title", "itemType")


def boolean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.search(_order_items(spark, sf_dir), tag=["1-URGENT || 2-HIGH", "-F"], item_type="-P || O").select("key", "itemType")


def top_level_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders that have a returned line."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return o.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


def deletion_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers held by the index that no urgent order mentions."""
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    live = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"))
    return incremental.deleted(held, live)


def missing_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order of a priority that every customer should have."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("o_orderpriority").alias("tags"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(o, "key", "left").select("key", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    tiers = ["urgent", "high", "low"]
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    rows = F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(v).alias("tier")) for k, v in names.items()])
    return items.missing_tiers(c, spark.range(1).select(F.inline(rows)), tiers)


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags after one is added and one taken away, with the boolean language on the result."""
    p = _parts(spark, sf_dir)
    changed = p.withColumn("tags", items.retag(F.col("tags"), F.array(F.lit("NEW")), F.array(F.lit("STEEL"))))
    return items.search(changed, tag=["NEW && -BRASS"]).select("key", F.array_join(F.array_sort("tags"), ",").alias("tags"))


def item_quick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a word of the name; a word that no name has is sought in brand and type as well."""
    p = _parts(spark, sf_dir).withColumn("all_tags", F.array_join("tags", " "))
    hits = items.quick_search(p, "widget", ["title"], ["title", "itemType", "all_tags"])
    more = items.quick_search(p, "economy", ["title"], ["title", "itemType", "all_tags"])
    return hits.select("key", F.lit("narrow").alias("way")).union(more.select("key", F.lit("wide").alias("way")))


def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of a line as related both ways, each once."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return items.symmetric(line)


def parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region and nation of the customer, four hops above the line."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    by_nation = up.groupBy("c_nationkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    named = by_nation.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name", "lines", F.round("revenue", 2).alias("revenue"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.tag_counts(_parts(spark, sf_dir))


def tag_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 tags with an S of parts, words of the type given by readers, the brand and every fifth part's first word by itself."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_type", " ")
    own = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, words).otherwise(F.array().cast("array<string>")).alias("tags"), F.array(F.col("p_brand"), F.when(F.col("p_partkey") % 5 == 0, words[0]).otherwise(F.col("p_brand"))).alias("auto_tags"))
    return items.tag_listing(own, "s", 30)


def item_search_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two languages, trashed ones too, that have both words anywhere."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit("book").alias("itemType"), F.array("lang").alias("tags"), "text", F.col("lang").alias("title"), (F.col("doc_id") % 3 == 0).alias("deleted"))
    found = items.search(d, tag=items.split_conjunction("-fr && de || es"), text="an es", everything=True, trashed=True)
    return found.select("key", "deleted")


def work_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight of the works that part 7's record names: its supplier's other parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    first = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    works = table(spark, sf_dir, "part").join(first, F.col("p_partkey") == F.col("l_partkey")).join(named, "l_suppkey")
    works = works.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array_remove("parts", F.col("p_partkey")).alias("related"))
    return graph.related_of(works, 7, 8)


def off_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit("metal").alias("tier")) for t in ("BRASS", "STEEL", "ECONOMY")])
    return items.off_vocabulary(items.tag_counts(_parts(spark, sf_dir)), spark.range(1).select(F.inline(known)))


def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 characters of every conversation, turn by turn."""
    out = items.text_budget(table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit(""))), "conv_id", ["turn", "role", "text"], 2000)
    return out.select("conv_id", "turn", "role", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its joined conversation each turn begins and ends, and which turn holds character 1,000."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    out = items.page_offsets(c, "conv_id", "turn")
    return out.select("conv_id", "turn", "start", "end", ((F.col("start") <= 1000) & (F.col("end") > 1000)).alias("holds"))


def last_heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each turn the user turn it stands under."""
    c = table(spark, sf_dir, "conversations")
    out = items.last_heading(c, "conv_id", "turn", (F.col("role") == "user") & F.col("text").isNotNull())
    return out.select("conv_id", "turn", F.md5("section").alias("section_md5"))


def events_after_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line the customer's last order of a high price at or before its ship date, within 200 days."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", "o_totalprice", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    own = table(spark, sf_dir, "lineitem")
    n = components.tasks(own)
    lines = own.select("l_orderkey", "l_linenumber", "l_shipdate").repartition(n, "l_orderkey").join(o.select("o_orderkey", "cust").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "cust", F.unix_date(F.to_date("l_shipdate")).alias("day"))
    marks = o.filter("o_totalprice > 200000").groupBy("cust", "day").agg(F.max("o_orderkey").alias("o_orderkey"))
    out = asof.last_before(lines, marks, "cust", "day", within=200)
    return out.select("l_orderkey", "l_linenumber", F.col("mark.o_orderkey").alias("last_order"))


def digest_filter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the number of turns by role and its longest turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0))
    w = Window.partitionBy("conv_id").orderBy(n.desc(), "turn")
    top = c.select("conv_id", "turn", n.alias("chars"), F.row_number().over(w).alias("k")).filter("k = 1").drop("k")
    counts = c.groupBy("conv_id").agg(F.count_if(F.lower("role") == "user").alias("user_turns"), F.count_if(F.lower("role") == "assistant").alias("assistant_turns"))
    return top.join(counts, "conv_id")


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(tx.csv_field(F.col("text"))).alias("field_md5"), F.md5(tx.csv_field(F.concat(F.element_at(F.array(F.lit("="), F.lit("-5"), F.lit("+")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.col("lang")))).alias("guarded_md5"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


QUERIES = {f.__name__: f for f in (item_tags, item_quick_search, related_links, item_filter_page, boolean_tags, top_level_semi, deletion_diff, missing_tier, parent_chain, tag_counts, tag_listing, item_search_everything, work_related, off_taxonomy, text_budget, page_offsets, last_heading_asof, events_after_orders, digest_filter_sort, csv_guard, html_text)}

_TAGS = "(SELECT p_partkey AS key, unnest(list_distinct(string_split(p_type, ' '))) AS tag FROM part)"
_CSV = r"""CASE WHEN regexp_matches({0}, '^[=+@\t\r-]') AND NOT regexp_matches({0}, '^[+-](\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN '"''' || replace({0}, '"', '""') || '"'
    WHEN NOT regexp_matches({0}, '[",\r\n]') AND NOT regexp_matches({0}, '^\s|\s$') THEN {0} ELSE '"' || replace({0}, '"', '""') || '"' END"""

_PIECE = tx.PIECE.replace("'", "''")
_NAMES = ", ".join(f"{k!r}: " + ("chr(160)" if k == "nbsp" else chr(39) * 4 if v == chr(39) else f"'{v}'") for k, v in tx.ENTITIES.items())
_READ = f"""array_to_string(list_transform(regexp_extract_all(coalesce(html, ''), '(?is){_PIECE}'), lambda x:
    CASE WHEN x[1] = '<' AND length(x) > 1 THEN CASE WHEN regexp_matches(x, '(?i)^<\\s*/?\\s*({'|'.join(tx.BLOCKS)})\\b') THEN chr(10) ELSE ' ' END
         WHEN x[1] = '&' AND length(x) > 1 THEN coalesce(MAP {{{_NAMES}}}[lower(x[2:-2])], x) ELSE x END), '')"""

ORACLE = {
    "item_tags": """WITH t AS (SELECT p_partkey AS key, list_sort(list_distinct(list_filter(list_append(string_split(p_type, ' '), 'NEW'), lambda x: x <> 'STEEL'))) AS tags FROM part)
        SELECT key, array_to_string(tags, ',') AS tags FROM t WHERE NOT list_contains(tags, 'BRASS')""",
    "item_quick_search": "SELECT p_partkey AS key, 'narrow' AS way FROM part WHERE contains(p_name, 'widget') UNION ALL SELECT p_partkey, 'wide' FROM part WHERE contains(lower(p_type), 'economy')",
    "related_links": "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem) WHERE a <> b",
    "html_text": rf"""WITH r AS (SELECT page_id, {_READ} AS t FROM pages),
        l AS (SELECT page_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\x{{00a0}}\x{{2007}}\x{{202f}}]+', ' ', 'g'))), chr(10)) AS t FROM r)
        SELECT page_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g') AS text FROM l""",
    "item_filter_page": "SELECT p_partkey AS key, p_name AS title, p_brand AS itemType FROM part WHERE p_size > 25 ORDER BY p_name, p_partkey LIMIT 50 OFFSET 50",
    "boolean_tags": """SELECT o_orderkey AS key, o_orderstatus AS itemType FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
        AND o_orderstatus <> 'F' AND (o_orderstatus <> 'P' OR o_orderstatus <> 'O')""",
    "top_level_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "deletion_diff": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "missing_tier": """SELECT c_custkey AS key, tier FROM customer, (VALUES ('urgent', '1-URGENT'), ('high', '2-HIGH'), ('low', '5-LOW')) t(tier, tag)
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = tag)""",
    "parent_chain": """SELECT r_name, n_name, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "tag_counts": f"SELECT tag, count(*) AS items FROM {_TAGS} GROUP BY 1",
    "tag_listing": """WITH w AS (SELECT p_partkey AS key, unnest(string_split(p_type, ' ')) AS tag, false AS auto FROM part WHERE p_partkey % 2 = 0
            UNION ALL SELECT p_partkey, p_brand, true FROM part UNION ALL SELECT p_partkey, string_split(p_type, ' ')[1], true FROM part WHERE p_partkey % 5 = 0),
        f AS (SELECT tag, count(DISTINCT key) AS items, bool_and(auto) AS automatic, count(*) OVER () AS total FROM w WHERE contains(lower(tag), 's') GROUP BY tag)
        SELECT tag, items, automatic, total FROM f ORDER BY tag LIMIT 30""",
    "item_search_everything": "SELECT doc_id AS key, doc_id % 3 = 0 AS deleted FROM documents WHERE lang <> 'fr' AND lang IN ('de', 'es') AND contains(lower(concat_ws(chr(10), lang, text)), 'an') AND contains(lower(concat_ws(chr(10), lang, text)), 'es')",
    "work_related": """WITH l AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), o AS (SELECT min(s) AS s FROM l WHERE p = 7),
        r AS (SELECT p AS related, row_number() OVER (ORDER BY p) - 1 AS place, count(*) OVER () AS total FROM l JOIN o USING (s) WHERE p <> 7)
        SELECT place::INTEGER AS place, related, p_name AS title, total::INTEGER AS total FROM r LEFT JOIN part ON p_partkey = related WHERE place < 8""",
    "off_taxonomy": f"SELECT tag, count(*) AS items FROM {_TAGS} WHERE tag NOT IN ('BRASS', 'STEEL', 'ECONOMY') GROUP BY 1",
    "text_budget": """WITH b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))
        SELECT conv_id, turn, role, length(substr(text, 1, (2000 - before)::BIGINT)) AS chars, md5(substr(text, 1, (2000 - before)::BIGINT)) AS text_md5 FROM b WHERE before < 2000""",
    "page_offsets": """WITH b AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, '')) + 2)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)
        SELECT conv_id, turn, start, start + n AS "end", start <= 1000 AND start + n > 1000 AS holds FROM b""",
    "last_heading_asof": """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)
        SELECT c.conv_id, c.turn, CASE WHEN c.turn - u.turn <= 200 THEN md5(u.text) END AS section_md5 FROM conversations c ASOF LEFT JOIN u ON c.conv_id = u.conv_id AND c.turn >= u.turn""",
    "events_after_orders": """WITH o AS (SELECT o_custkey AS cust, o_orderkey, o_totalprice, o_orderdate::DATE AS day FROM orders),
        m AS (SELECT cust, day, max(o_orderkey) AS last FROM o WHERE o_totalprice > 200000 GROUP BY ALL),
        l AS (SELECT l_orderkey, l_linenumber, cust, l_shipdate::DATE AS day FROM lineitem JOIN o ON o_orderkey = l_orderkey)
        SELECT l_orderkey, l_linenumber, CASE WHEN l.day - m.day <= 200 THEN m.last END AS last_order FROM l ASOF LEFT JOIN m ON l.cust = m.cust AND l.day >= m.day""",
    "digest_filter_sort": """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) AS k FROM conversations),
        n AS (SELECT conv_id, count(*) FILTER (lower(role) = 'user') AS user_turns, count(*) FILTER (lower(role) = 'assistant') AS assistant_turns FROM conversations GROUP BY 1)
        SELECT t.conv_id, turn, chars, user_turns, assistant_turns FROM t JOIN n USING (conv_id) WHERE k = 1""",
    "csv_guard": f"""SELECT doc_id, md5({_CSV.format("text")}) AS field_md5, md5({_CSV.format("g")}) AS guarded_md5
        FROM (SELECT *, ['=', '-5', '+'][doc_id % 3 + 1] || lang AS g FROM documents)""",
}
