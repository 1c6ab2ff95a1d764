"""Systematic-review statistics over screening tags: records(key, tags)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages, decisions and outcomes.
STAGES = ["title-abstract", "full-text"]
DECISIONS = ["include", "exclude", "maybe"]
OUTCOMES = [*DECISIONS, "conflict", "pending"]
TAG = r"^screen/(title-abstract|full-text)/(include|exclude|maybe)(?::([a-z0-9][a-z0-9-]*))?(?:@([a-z0-9][a-z0-9._-]*))?$"
NO_REASON = "(none given)"


def parsed(tag: Column) -> Column:
    """struct(stage, decision, reason, reviewer); null for other tags and for a reason without an exclusion."""
    part = lambda k: F.nullif(F.regexp_extract(tag, TAG, k), F.lit(""))
    good = tag.rlike(TAG) & (part(3).isNull() | (part(2) == "exclude"))
    return F.when(good, F.struct(part(1).alias("stage"), part(2).alias("decision"), part(3).alias("reason"), part(4).alias("reviewer")))


def malformed(tag: Column) -> Column:
    return tag.startswith("screen/") & parsed(tag).isNull()


def votes(records: DataFrame) -> DataFrame:
    """(key, pos, stage, decision, reason, reviewer) of every tag that can be read."""
    each = records.select("key", F.posexplode("tags").alias("pos", "tag")).select("key", "pos", parsed(F.col("tag")).alias("v"))
    return each.filter("v is not null").select("key", "pos", "v.*")


def outcomes(records: DataFrame) -> DataFrame:
    """(key, stage, outcome, reason, final) of each record in each stage's population.

    A final tag decides; else the reviewers do if they agree, with a reason only if all give the same;
    full text holds records included on title and abstract, or with a full-text tag.
    """
    v = votes(records)
    first = F.min_by(F.struct("decision", "reason"), F.when(F.col("reviewer").isNull(), F.col("pos")))
    own = v.groupBy("key", "stage").agg(
        first.alias("final"),
        F.collect_set(F.when(F.col("reviewer").isNotNull(), F.col("decision"))).alias("ds"),
        F.collect_set(F.when(F.col("reviewer").isNotNull(), F.coalesce("reason", F.lit("")))).alias("rs"),
        F.count_if(F.col("reviewer").isNull()).alias("finals"),
    )
    decided = F.when(F.col("finals") > 0, F.col("final.decision")).when(F.size("ds") > 1, "conflict").when(F.size("ds") == 1, F.col("ds")[0]).otherwise("pending")
    reason = F.when(F.col("finals") > 0, F.col("final.reason")).when(F.size("rs") == 1, F.nullif(F.col("rs")[0], F.lit("")))
    own = own.select("key", "stage", decided.alias("outcome"), reason.alias("reason"), (F.col("finals") > 0).alias("final"))
    keys = records.select("key").distinct()
    ta = keys.join(own.filter(F.col("stage") == STAGES[0]).drop("stage"), "key", "left").select("key", F.lit(STAGES[0]).alias("stage"), F.coalesce("outcome", F.lit("pending")).alias("outcome"), "reason", F.coalesce("final", F.lit(False)).alias("final"))
    ft = ta.filter("outcome = 'include'").select("key").join(own.filter(F.col("stage") == STAGES[1]).drop("stage"), "key", "full_outer")
    ft = ft.select("key", F.lit(STAGES[1]).alias("stage"), F.coalesce("outcome", F.lit("pending")).alias("outcome"), "reason", F.coalesce("final", F.lit(False)).alias("final"))
    return ta.unionByName(ft)


def tally(result: DataFrame) -> DataFrame:
    """By stage: records and each outcome's count."""
    return result.groupBy("stage").agg(F.count("*").alias("records"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def reasons(result: DataFrame) -> DataFrame:
    return result.filter("outcome = 'exclude'").groupBy("stage", F.coalesce("reason", F.lit(NO_REASON)).alias("reason")).agg(F.count("*").alias("n"))


def in_population(v: DataFrame, result: DataFrame) -> DataFrame:
    return v.join(result.select("key", "stage"), ["key", "stage"], "left_semi")


def by_reviewer(v: DataFrame) -> DataFrame:
    return v.filter("reviewer is not null").groupBy("reviewer", "stage").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS])


def disagreements(v: DataFrame) -> DataFrame:
    """(key, stage, decisions, resolved) where reviewers differ."""
    g = v.groupBy("key", "stage").agg(F.sort_array(F.collect_list(F.when(F.col("reviewer").isNotNull(), F.struct("reviewer", "decision")))).alias("decisions"), F.size(F.collect_set(F.when(F.col("reviewer").isNotNull(), F.col("decision")))).alias("_n"), (F.count_if(F.col("reviewer").isNull()) > 0).alias("resolved"))
    return g.filter("_n > 1").drop("_n")


def half_up(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def agreement(v: DataFrame) -> DataFrame:
    """(stage, a, b, both, agreement, kappa) of every pair of reviewers with a record in common; kappa is null
    where chance alone would agree always. Self-join by record and stage: a record has few reviewers."""
    one = v.filter("reviewer is not null").select("key", "stage", "reviewer", "decision")
    x, y = one.alias("x"), one.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.stage") == F.col("y.stage")) & (F.expr("x.reviewer COLLATE UNICODE < y.reviewer COLLATE UNICODE")))
    return kappa(pairs.select(F.col("x.stage").alias("stage"), F.col("x.reviewer").alias("a"), F.col("y.reviewer").alias("b"), F.col("x.decision").alias("p"), F.col("y.decision").alias("q")), ["stage", "a", "b"], DECISIONS)


def kappa(pairs: DataFrame, by: list[str], values: list) -> DataFrame:
    """Percent agreement and Cohen's kappa of paired ratings p, q."""
    n = F.count("*")
    g = pairs.groupBy(*by).agg(n.alias("both"), (F.count_if(F.col("p") == F.col("q")) / n).alias("po"), sum((F.count_if(F.col("p") == F.lit(d)) / n * F.count_if(F.col("q") == F.lit(d)) / n for d in values), F.lit(0.0)).alias("pe"))
    return g.select(*by, "both", half_up(F.col("po")).alias("agreement"), F.when(F.col("pe") != 1, half_up((F.col("po") - F.col("pe")) / (1 - F.col("pe")))).alias("kappa"))


def awaiting(records: DataFrame, result: DataFrame, stage: str, reviewer: str | None = None) -> DataFrame:
    """Keys without a final tag that the team (or the reviewer) has still to decide."""
    left = result.filter((F.col("stage") == stage) & ~F.col("final"))
    if reviewer is None:
        return left.filter(F.col("outcome").isin("pending", "conflict")).select("key")
    done = votes(records).filter((F.col("stage") == stage) & (F.col("reviewer") == reviewer)).select("key")
    return left.select("key").join(done, "key", "left_anti")


def prisma(records: DataFrame, result: DataFrame, identified: int | None = None, sources: dict[str, int] | None = None, removed: int | None = None, merged: int = 0, still: int = 0) -> DataFrame:
    """The flow's numbers in one row."""
    t = result.groupBy().agg(*[F.count_if((F.col("stage") == s) & (F.col("outcome") == o)).alias(f"{p}_{o}") for s, p in zip(STAGES, ("ta", "ft"), strict=True) for o in OUTCOMES], F.count_if(F.col("stage") == STAGES[0]).alias("n"), F.count_if(F.col("stage") == STAGES[1]).alias("sought"))
    given = identified if identified is not None else sum(sources.values()) if sources else None
    n = F.col("n")
    gone = F.lit(removed).cast("long") if removed is not None else F.greatest(F.lit(0), F.lit(given).cast("long") - n) if given is not None else F.lit(merged or None).cast("long")
    return t.select(
        (F.lit(given).cast("long") if given is not None else n + F.coalesce(gone, F.lit(0))).alias("records_identified"),
        gone.alias("duplicates_removed"),
        F.lit(still).alias("duplicates_still"),
        (F.col("ta_include") + F.col("ta_exclude")).alias("records_screened"),
        F.col("ta_exclude").alias("records_excluded"),
        (F.col("ta_pending") + F.col("ta_conflict") + F.col("ta_maybe")).alias("records_awaiting"),
        F.col("sought").alias("reports_sought"),
        (F.col("ft_include") + F.col("ft_exclude")).alias("reports_assessed"),
        F.col("ft_exclude").alias("reports_excluded"),
        (F.col("ft_pending") + F.col("ft_conflict") + F.col("ft_maybe")).alias("reports_awaiting"),
        F.col("ft_include").alias("studies_included"),
    )


def reason_lines(reason_counts: DataFrame) -> Column:
    """Aggregate over reasons(reason, n): "reason (n = 3)" lines, the most frequent first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reason", "n")))
    return F.transform(rows, lambda r: F.concat(F.replace(r["reason"], F.lit("-"), F.lit(" ")), F.lit(" (n = "), r["n"].cast("string"), F.lit(")")))


#: What the flow's numbers are called, in order.
FLOW = {
    "records_identified": "Records identified", "duplicates_removed": "Duplicate records removed", "records_screened": "Records screened (title and abstract)", "records_excluded": "Records excluded",
    "reports_sought": "Reports sought for retrieval", "reports_assessed": "Reports assessed for eligibility (full text)", "reports_excluded": "Reports excluded", "studies_included": "Studies included in review",
}
#: What is still open, by the number that says so.
OPEN = {"records_awaiting": "record(s) still await title and abstract screening", "reports_awaiting": "report(s) still await full-text assessment", "duplicates_still": "duplicate record(s) are still in the collection"}


def flow_text(flow: DataFrame, reason_counts: DataFrame) -> DataFrame:
    """(text, diagram): the flow as lines, and as a Mermaid flowchart. reason_counts: stage, reason, n."""
    lines = reason_counts.filter(F.col("stage") == STAGES[1]).agg(reason_lines(reason_counts).alias("why"))
    f = flow.join(F.broadcast(lines))  # one row each
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    told = [F.concat(F.lit(f"{name}: n = "), number(c)) for c, name in FLOW.items()]
    told.insert(7, F.nullif(F.array_join(F.transform("why", lambda x: F.concat(F.lit("  "), x)), "\n"), F.lit("")))
    still = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}"))) for c, what in OPEN.items()])
    text = F.concat_ws("\n", *told, F.when(still != "", F.concat(F.lit("Not final: "), still, F.lit("."))))
    box = lambda node, c, more=F.lit(""): F.concat(F.lit(f'{node}["{FLOW[c].split(" (")[0]} (n = '), number(c), F.lit(")"), more, F.lit('"]'))
    reasons = F.when(F.size("why") > 0, F.concat(F.lit("<br/>"), F.replace(F.array_join("why", "<br/>"), F.lit('"'), F.lit("'")))).otherwise("")
    edges = [("id1", "records_identified", "id2", "duplicates_removed"), ("id1", None, "s1", "records_screened"), ("s1", None, "x1", "records_excluded"), ("s1", None, "r1", "reports_sought"), ("r1", None, "a1", "reports_assessed"), ("a1", None, "x2", "reports_excluded"), ("a1", None, "i1", "studies_included")]
    drawn = [F.concat(F.lit("  "), box(a, first) if first else F.lit(a), F.lit(" --> "), box(b, c, reasons if b == "x2" else F.lit(""))) for a, first, b, c in edges]
    return f.select(text.alias("text"), F.concat_ws("\n", F.lit("flowchart TD"), *drawn).alias("diagram"))


def rescreened(tags: Column, stage: str, reviewer: str | None, new: str) -> Column:
    """The tags with those of this stage and reviewer replaced by the new one."""
    same = lambda t: (parsed(t)["stage"] == stage) & parsed(t)["reviewer"].eqNullSafe(F.lit(reviewer))
    return F.array_union(F.filter(tags, lambda t: ~F.coalesce(same(t), F.lit(False))), F.array(F.lit(new)))


def evidence_flags() -> Column:
    """Names of the rules that an evidence row (page, quotation, coverage, support) breaks."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    cover, support = F.col("coverage"), F.col("support")
    rules = {
        "page_without_quotation": filled("page") & ~filled("quotation"),
        "passage_without_quotation": (cover == "passage") & ~filled("quotation"),
        "judged_without_passage": (cover != "passage") & (support != "unverified"),
        "quotation_of_unread_source": (cover == "unavailable") & filled("quotation"),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
