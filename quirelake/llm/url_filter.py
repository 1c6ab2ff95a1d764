"""URL filter: a blocked Bloom filter of listed URLs screens candidates, an exact hash join decides.

Listed are prefix rules (host with its subdomains, start of the path) and, optionally, canonical
URLs as a whole. Every distinct URL is first asked by the suffixes of its host: a Bloom filter and an
exact join tell which are listed, and which lengths of path their rules have. Only for these lengths
a path prefix is made; its key is looked up in 512-bit Bloom blocks, and possible hits go on to the
exact join, which removes false positives. A URL gives no more keys than it has host labels and
characters, and plans don't grow with the list. DataFrame functions only.

A canonical URL is its lower-case host, without user, trailing dots and the ports 80 and 443, and its
path, "/" if it has none. Hosts and paths that are returned, and that rules are held against, are as
they stand in the URL.

Pages are joined with their URL's verdict by URL and a salt (a hash of the row, whatever kinds its ids are of; long texts
count by their length), so pages of one URL, or without a URL, don't meet in one task.

Cases: a null URL, or one without "://", has empty host and path, fits no rule and gets the default
verdict. Repeated pages each get a row. Of equal rules with different verdicts, block stands. An
empty list or page table gives every page the default, or no rows. Columns of pages that are called
host, path, rule or verdict are replaced; all others are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bounded, possible
from .util import SALTS, ascii_lower, free_name, salted, salts_seen, staged


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, verdict) rows from strings such as ("example.com/en/", "block"); literals, so no Python runs for them."""
    rows = F.array(*[F.struct(F.lit(r).cast("string").alias("rule"), F.lit(v).cast("string").alias("verdict")) for r, v in rules]).cast("array<struct<rule:string,verdict:string>>")
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def _key(host: Column, path: Column, kind: str) -> Column:
    return F.concat(F.lit(kind), host, F.lit("\n"), path)


def canonical(url: Column) -> tuple[Column, Column]:
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r"\.*(:(80|443)?)?$", "")
    return F.regexp_replace(host, r"\.+$", ""), F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/"))


def listing(rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Rules and listed URLs as one table: key, rule, verdict, and of rules their host and length of path; of equal keys, block stands."""
    cut = F.coalesce(F.nullif(F.instr("rule", "/"), F.lit(0)) - 1, F.length("rule"))
    host, path = ascii_lower(F.substr("rule", F.lit(1), cut)), F.substr("rule", cut + 1)
    out = rules.filter(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).select(_key(host, path, "p").alias("key"), "rule", "verdict", host.alias("host"), F.length(path).alias("chars"))
    if listed is not None:
        none = F.lit(None).cast("string")
        out = out.union(listed.filter(F.col("url").contains("://")).select(_key(*canonical(F.col("url")), "x"), none, F.lit("block"), none, none.cast("int")))
    return out.groupBy("key").agg(F.max_by("rule", F.struct("verdict", "rule")).alias("rule"), F.max("verdict").alias("verdict"), F.max("host").alias("host"), F.max("chars").alias("chars"))


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages with host, path, the longest fitting rule and the verdict.

    The verdict is the rule's; without one, block for a listed canonical URL, else default.
    """
    entries = staged(listing(rules, listed), "listing")
    hosts = entries.filter("host is not null").groupBy(F.col("host").alias("key")).agg(F.collect_set("chars").alias("lengths"))
    facts = entries.agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"), F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("rule"), F.lit(0)) + 64), F.lit(0)).alias("bytes")).first()
    salt = F.pmod(F.xxhash64(*[_short(c, kind) for c, kind in pages.dtypes if c != "url" and "map<" not in kind and "variant" not in kind], F.lit(0)), F.lit(SALTS)).cast("int")
    urls = pages.filter(F.col("url").contains("://")).groupBy("url").agg(salts_seen(salt).alias("salts"))
    urls = urls.select("url", "salts", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda d: F.array_join(F.slice(labels, -d, d), "."))
    asked = possible(urls.select("*", F.explode(suffixes).alias("key")), hosts, facts["hosts"]).join(bounded(hosts, facts["bytes"]), "key")
    fitting = F.filter("lengths", lambda c: c <= F.length("p"))
    keys = F.transform(fitting, lambda c: _key(F.col("key"), F.substr("p", F.lit(1), c), "p"))
    probes = asked.select("url", "salts", F.explode(keys).alias("key"))
    if listed is not None:
        probes = probes.union(urls.select("url", "salts", _key(*canonical(F.col("url")), "x")))
    hits = possible(probes, entries.select("key"), facts["n"]).join(bounded(entries.select("key", "rule", "verdict"), facts["bytes"]), "key")
    longest = F.struct(F.length("rule"), F.col("rule"))
    best = hits.groupBy("url", "salts").agg(F.max_by("rule", longest).alias("rule"), F.max_by("verdict", longest).alias("fit"), F.max("verdict").alias("any"))
    other = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own, theirs = free_name("salt_of_page", *pages.columns), {c: free_name(f"{c}_found", *pages.columns) for c in ("url", "salt", "rule", "verdict")}
    best = salted(best.select("url", "salts", "rule", F.when(F.col("rule").isNotNull(), F.col("fit")).otherwise(F.col("any")).alias("verdict")), "salts")
    best = best.select(*[F.col(c).alias(n) for c, n in theirs.items()])
    joined = pages.select(*[F.col(f"`{c}`") for c in other], salt.alias(own)).join(best, (F.col("url") == F.col(theirs["url"])) & (F.col(own) == F.col(theirs["salt"])), "left")
    return joined.select(*[F.col(f"`{c}`") for c in other], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col(theirs["rule"]).alias("rule"), F.coalesce(F.col(theirs["verdict"]), F.lit(default)).alias("verdict"))


def _short(name: str, kind: str) -> Column:
    """What a column adds to the salt: of a text that may be a whole page its length and begin."""
    c = F.col(f"`{name}`")
    return F.xxhash64(F.length(c), F.substring(c, 1, 64)) if kind in ("string", "binary") else c
