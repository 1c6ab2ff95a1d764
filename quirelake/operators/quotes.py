"""Quotations looked for in documents: whole in order, or nearly, by postings of their rarest words.

Documents are read as match_key() has them. Only words and runs of words that quotations have are taken from them, each quotation
is sought where its rarest ones stand, and the documents found are then compared with it as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import found_in_order, let, match_key, place, quote_key, segments, similarity
from .components import TASK_ROWS, staged

#: Similarity of a close match, share of a quotation's words that must meet, starts that are tried, words more or less.
CLOSE, SHARE, STARTS, SLACK = 0.85, 0.3, 10, [0, -2, -1, 1, 2]
#: Votes that a place needs of the rarer words.
SURE = 3
#: Words of a run, and characters of one where a quotation has no whole word that is sure.
RUN, LETTERS = 3, 8
#: What quotations have of words or runs is broadcast only up to this number.
BROADCAST_WORDS = 500_000


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of size words."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(F.lit(size), *[F.get(words, k + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _letters(key: Column, size: int) -> Column:
    """Hashes of all runs of size characters."""
    return F.transform(F.regexp_extract_all(key, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)), lambda x: F.xxhash64(F.lit(-size), x))


def _own_runs(parts: Column) -> Column:
    """(kind, run) of a quotation: runs of the words inside its segments, whose first and last word may be parts of longer ones;
    without any, runs of the characters of the longest segment. kind is the words of a run, or less the characters."""
    inner = F.transform(parts, lambda p: let(_words(p), lambda w: F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 2))))
    longest = F.element_at(F.array_sort(parts, lambda a, b: F.length(a) - F.length(b)), -1)

    def kind(n: int, runs: Column) -> Column:
        return F.transform(runs, lambda r: F.struct(F.lit(n).alias("kind"), r.alias("run")))

    def of_words(n: int) -> Column:
        fitting = F.filter(inner, lambda w: (F.size(w) == n) if n < RUN else (F.size(w) >= n))
        return kind(n, F.flatten(F.transform(fitting, lambda w: _runs(w, n))))

    listed, chars = [of_words(n) for n in range(1, RUN + 1)], F.lit(None)
    for n in range(1, LETTERS + 1):
        chars = F.when((F.length(longest) == n) if n < LETTERS else (F.length(longest) >= n), kind(-n, _letters(longest, n))).otherwise(chars)
    return let(F.concat(*listed), lambda x: F.when(F.size(x) > 0, x).otherwise(chars))


def contained(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote, doc, start, end): documents that hold a quotation's segments in order, and where. quotes: quote, text; docs: doc, text.

    Of all runs of a quotation the one that the fewest documents have is its seed; only documents with the seed are compared.
    """
    q = quotes.select("quote", segments(F.col("text")).alias("parts")).filter(F.size("parts") > 0)
    own = staged(q.select("quote", F.explode(_own_runs(F.col("parts"))).alias("r")).select("quote", "r.*").distinct(), "runs")
    kinds = [r["kind"] for r in own.select("kind").distinct().collect()]  # RUN + LETTERS at most

    def runs(words: Column, key: Column) -> Column:
        return F.array_distinct(F.flatten(F.array(*[_runs(words, k) if k > 0 else _letters(key, -k) for k in kinds]))) if kinds else F.array().cast("array<bigint>")

    every = let(match_key(F.col("text")), lambda key: let(_words(key), lambda words: runs(words, key)))
    held = docs.select("doc", F.explode(every).alias("run")).join(_few(own.select("run").distinct()), "run")
    held = staged(held, "held")
    seed = own.join(held.groupBy("run").agg(F.count("*").alias("n")), "run", "left").groupBy("quote").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    met = held.join(seed, "run").select("quote", "doc")
    both = docs.select("doc", "text").join(_few(met), "doc").join(q, "quote")  # texts stay in their tasks where few documents are met
    place_of = let(found_in_order(match_key(F.col("text")), F.col("parts")), lambda f: F.when(f.isNotNull(), place(F.col("text"), f["start"], f["end"])))
    return both.select("quote", "doc", F.explode(F.array_compact(F.array(place_of))).alias("p")).select("quote", "doc", "p.start", "p.end")


def close_matches(quotes: DataFrame, docs: DataFrame, least: float = CLOSE) -> DataFrame:
    """(quote, doc, start, end, similarity): in each document the window that is most like a quotation, and its place in the text.

    Each word that both have at one distance votes for the place where the window would begin. A window needs the votes of SHARE of the
    quotation's words. All but SURE of these, or half where that is more, may come from the commonest ones, so without those it still has
    the others: only the rarer words are looked up, and all votes are counted where these suffice. A document's votes are counted in the
    task that has it. The STARTS best places are compared by edit distance, with windows of about the quotation's number of words.
    """
    q = quotes.select("quote", F.array_join(segments(F.col("text")), " ").alias("key")).filter("key <> ''").withColumn("words", _words(F.col("key")))
    q = staged(q.withColumns({"n": F.size("words"), "need": F.greatest(F.lit(2), F.floor(F.size("words") * SHARE)).cast("int")}), "quotes")
    asked = q.select("quote", "n", "need", F.posexplode("words").alias("qi", "word"))
    counts = _spread(docs).join(_few(asked.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("quote").orderBy(F.coalesce("df", F.lit(0)), "qi"))
    left_out = F.greatest(F.expr("(need - 1) div 2"), F.col("need") - SURE)
    kept = asked.join(counts, "word", "left").withColumn("k", rare).withColumn("out", left_out).filter("k <= n - out")
    seeds = staged(kept.select("quote", "qi", "word", (F.col("need") - F.col("out")).alias("sure"), "df"), "seeds")
    begins = _begins(docs, seeds).groupBy("quote", "doc").agg(F.collect_list("start").alias("starts"))
    both = begins.join(q, "quote").join(docs.select("doc", "text"), "doc")
    window = let(_words(match_key(F.col("text"))), lambda held: let(_window(held), lambda w: F.when(w["similarity"] >= least, _placed(held, w))))
    return both.select("quote", "doc", F.explode(F.array_compact(F.array(window))).alias("w")).select("quote", "doc", "w.*")


def _spread(docs: DataFrame) -> DataFrame:
    """(doc, p, word): the words of each document's key by their number."""
    return docs.select("doc", F.posexplode(_words(match_key(F.col("text")))).alias("p", "word"))


def _begins(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(quote, doc, start): places with votes enough of seeds (quote, qi, word, sure, df). Documents are dealt to tasks by the
    number of votes, which count them without another shuffle."""
    votes = seeds.agg(F.sum("df")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), votes // TASK_ROWS)
    posted = _spread(docs.repartition(parts, "doc")).join(_few(seeds.drop("df")), "word").filter("p >= qi")
    begins = posted.groupBy("quote", "doc", "sure", (F.col("p") - F.col("qi")).alias("start")).agg(F.count("*").alias("votes"))
    return begins.filter("votes >= sure").select("quote", "doc", "start")


def _window(held: Column) -> Column:
    """struct(similarity, nth, start, n): of the windows that begin at column starts in the words of a text the one most like column key."""

    def votes(s: Column) -> Column:
        return F.size(F.filter(F.transform("words", lambda w, k: F.get(held, s + k).eqNullSafe(w)), lambda same: same))

    def tries(best: Column) -> Column:
        slack = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(SLACK)])
        return F.flatten(F.transform(best, lambda x, k: F.transform(slack, lambda y: F.struct(x["start"].alias("start"), (F.col("n") + y["d"]).alias("n"), (k * len(SLACK) + y["i"]).alias("nth")))))

    def scored(t: Column) -> Column:
        return F.struct(similarity(F.col("key"), F.array_join(F.slice(held, t["start"] + 1, t["n"]), " ")).alias("similarity"), (-t["nth"]).alias("nth"), t["start"].alias("start"), t["n"].alias("n"))

    voted = F.filter(F.transform("starts", lambda s: F.struct((-votes(s)).alias("votes"), s.alias("start"))), lambda x: -x["votes"] >= F.col("need"))
    fits = F.filter(tries(F.slice(F.array_sort(voted), 1, STARTS)), lambda t: (t["n"] > 0) & (t["start"] + t["n"] <= F.size(held)))
    return F.array_max(F.transform(fits, scored))


def _placed(held: Column, w: Column) -> Column:
    """struct(start, end, similarity) of a window of words in column text."""
    begin = F.when(w["start"] == 0, 0).otherwise(F.length(F.array_join(F.slice(held, F.lit(1), w["start"]), " ")) + 1)
    size = F.length(F.array_join(F.slice(held, w["start"] + 1, w["n"]), " "))
    at = let(begin, lambda b: place(F.col("text"), b, b + size))
    return let(at, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), w["similarity"].alias("similarity")))


def pages_of(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """matches (quote, doc, start, ...) with page: the one that start falls on. pages: doc, page, start, end of each page in its document's text."""
    p = pages.select(F.col("doc").alias("_doc"), "page", F.col("start").alias("_from"), F.col("end").alias("_to"))
    return matches.join(p, (F.col("doc") == F.col("_doc")) & (F.col("start") >= F.col("_from")) & (F.col("start") < F.col("_to")), "left").drop("_doc", "_from", "_to")


def best_of(results: DataFrame, ranks: list[str]) -> DataFrame:
    """Of results(quote, source, status) of several sources the first by rank of status, then by source."""
    place = F.array_position(F.array(*map(F.lit, ranks)), F.col("status"))
    return results.groupBy("quote").agg(F.min_by(F.struct("source", "status"), F.struct(place, "source")).alias("b")).select("quote", "b.*")


def page_of(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote, page): where a quotation stands: the page that holds it, else one that holds its first 60, 40 or 20 characters,
    nearest to the hint. quotes: quote, doc, text, hint; pages: doc, page, text."""
    needles = F.array(*[F.struct(F.lit(k).alias("nth"), x.alias("needle")) for k, x in enumerate([F.col("key"), *[F.substring("key", 1, n) for n in (60, 40, 20)]])])
    q = quotes.select("quote", "doc", "hint", quote_key(F.col("text")).alias("key")).select("quote", "doc", "hint", F.inline(needles))
    p = pages.select("doc", "page", quote_key(F.col("text")).alias("held"))
    found = q.join(p, "doc").filter(F.col("held").contains(F.col("needle")))
    return found.groupBy("quote").agg(F.min_by("page", F.struct("nth", F.abs(F.col("page") - F.coalesce("hint", F.lit(1))), "page")).alias("page"))
