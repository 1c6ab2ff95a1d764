"""Temperature mixing of sources under a token budget.

Source token shares p become weights p**a / sum(p**a). The exponent a is bisected: to the largest
with at least a target entropy (in nats), or to the smallest (most even) under which no source is
repeated more than a limit. A target that no exponent meets is an error. Every round evaluates the next
five halvings at once, as one aggregate over the table of sources. Weights become token budgets; a source
is passed over in whole epochs, and of the last one it gets as many blocks of that epoch's block
permutation as its budget holds, then the documents of the next block, in hashed order, while they fit.
DataFrame functions only.

A source's documents are dealt by hash to at most BLOCKS blocks; running sums go over block totals, and
document by document only inside the one block that the budget cuts, over narrow rows (hash, id, tokens)
from which one cut for each source is found. So no task holds a source, and no text is sorted.

Tokens are estimated as a quarter of the code points, rounded up, unless a column is given. Cases: a
null source is a source of its own; a null or empty text has no tokens and goes with its source's
whole epochs; a source without tokens has weight 0 and each of its rows comes once. Rows with a null
doc_id are dealt by all their columns. Rows equal in hash, doc_id and tokens are drawn all or none in
the cut block. An empty table gives no rows. Columns of docs stay, whatever they are called, but for those of
the four names that mix() adds, which are replaced. Map columns don't count in the hash of a row without doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import free_name, row_hash, staged

BLOCKS, LEVELS, ROUNDS = 1024, 5, 6
#: Beyond it the largest source has all the weight, or the largest ones are equal and no exponent parts them.
MOST_EXPONENT = 1024.0
#: The tables of sources and of blocks are broadcast only up to this many bytes.
BROADCAST_BYTES = 64 << 20


def token_estimate(text: Column) -> Column:
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)


def _facts(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent: entropy, and largest and smallest p**(a - 1) / sum(p**a): epochs for a budget of all tokens."""
    grid = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("p", "a")
    rows = grid.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("hi"), F.min(F.pow("p", F.col("a") - 1)).alias("lo")).collect()
    return {r["a"]: (math.log(r["z"]) - r["a"] * r["s"] / r["z"], r["hi"] / r["z"], r["lo"] / r["z"]) for r in rows}


def _bisect(shares: DataFrame, low: float, high: float, good_high: bool, ok) -> float:
    """The end of the good side of [low, high]; ok is monotone, and the good side is the high or the low one."""
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / 2**LEVELS for k in range(2**LEVELS + 1)]
        facts = _facts(shares, grid)
        good = [ok(facts[a]) for a in grid]
        if good_high:
            k = good.index(True) if True in good else len(grid) - 1
            low, high = grid[max(k - 1, 0)], grid[k]
        else:
            k = len(good) - 1 - good[::-1].index(True) if True in good else 0
            low, high = grid[k], grid[min(k + 1, len(grid) - 1)]
    return high if good_high else low


def plan(docs: DataFrame, source: str, tokens: Column, target_entropy: float | None, repetition_limit: float | None, budget: float | None) -> DataFrame:
    """One row a source: source, total, weight, epochs. budget None: as many tokens as give every source one epoch at least."""
    totals = staged(docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("total")), "totals")
    all_tokens = totals.agg(F.sum("total")).first()[0] or 0
    shares = totals.filter("total > 0").select((F.col("total") / F.lit(float(all_tokens or 1))).alias("p"))
    if not all_tokens:
        return totals.select("source", "total", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    if target_entropy is not None:
        most = _facts(shares, [0.0])[0.0][0]
        if not 0 <= target_entropy <= most + 1e-9:
            raise ValueError(f"the entropy of {target_entropy} is out of reach: it lies between 0 and {most}")
        #: The entropy falls as the exponent grows, so the bracket is doubled until its end is below the target.
        high = 8.0
        while high < MOST_EXPONENT and _facts(shares, [high])[high][0] >= target_entropy:
            high *= 2
        a = _bisect(shares, 0.0, high, False, lambda f: f[0] >= min(target_entropy, most))
    else:
        def within(f: tuple[float, float, float]) -> bool:
            most = f[1] / f[2] if budget is None else f[1] * budget / all_tokens
            return most <= repetition_limit * (1 + 1e-9)

        if not within(_facts(shares, [1.0])[1.0]):
            raise ValueError("the budget can't be met within the repetition limit")
        a = _bisect(shares, 0.0, 1.0, True, within)
    entropy, _, least = _facts(shares, [a])[a]
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    spend = all_tokens / least if budget is None else budget
    p = F.col("total") / F.lit(float(all_tokens))
    weight = F.when(F.col("total") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    out = totals.select("source", "total", weight.alias("weight"))
    #: Rounded, so that an epoch that is whole up to the last digits counts as whole.
    return out.select("*", F.when(F.col("total") > 0, F.round(F.col("weight") * F.lit(float(spend)) / F.col("total"), 9)).otherwise(F.lit(1.0)).alias("epochs"))


def mix(docs: DataFrame, source: str = "source", tokens: Column | None = None, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """docs with one row for each time a row is drawn, and columns mix_tokens, mix_weight, mix_epoch (from 1) and
    mix_block_rank (sort key of the row's block in that epoch's permutation)."""
    tokens = tokens if tokens is not None else token_estimate(F.col("text"))
    planned = staged(plan(docs, source, tokens, target_entropy, repetition_limit, budget), "plan")
    held = planned.count() * BLOCKS * 128
    small = (lambda df: F.broadcast(df)) if held <= BROADCAST_BYTES else (lambda df: df)
    names = ["source", "weight", "full", "n", "rest", "h", "tokens", "block", "t", "run", "s", "b", "take", "room", "spent", "c", "cut", "fits"]
    _ = {n: free_name(f"_mix_{n}", *docs.columns) for n in names}  # names of the working columns, none of them a column of docs
    n = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.col("total"))).cast("int")
    full = F.floor("epochs")
    planned = planned.select(F.col("source").alias(_["source"]), F.col("weight").alias(_["weight"]), full.alias(_["full"]), n.alias(_["n"]), F.round((F.col("epochs") - full) * F.col("total")).cast("long").alias(_["rest"]))
    h = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(row_hash(docs, F.lit(seed)))
    keyed = docs.withColumns({_["tokens"]: tokens, _["h"]: h}).join(small(planned), F.col(source).eqNullSafe(F.col(_["source"]))).withColumn(_["block"], F.pmod(_["h"], _["n"]).cast("int"))
    #: The partial epoch: running sums over the source's block totals, in that epoch's order.
    blocks = keyed.groupBy(_["source"], _["block"]).agg(F.sum(_["tokens"]).alias(_["t"]), F.first(_["rest"]).alias(_["rest"]), F.first(_["full"]).alias(_["full"]))
    order = _order(_["source"], _["block"], F.col(_["full"]) + 1, seed)
    run = F.sum(_["t"]).over(Window.partitionBy(_["source"]).orderBy(order, _["block"]))
    before = F.col(_["run"]) - F.col(_["t"])
    take = F.when(F.col(_["run"]) <= F.col(_["rest"]), 1).when(before < F.col(_["rest"]), 0).otherwise(-1)
    blocks = blocks.withColumn(_["run"], run).select(F.col(_["source"]).alias(_["s"]), F.col(_["block"]).alias(_["b"]), take.alias(_["take"]), (F.col(_["rest"]) - before).alias(_["room"]))
    drawn = keyed.join(small(blocks), F.col(_["source"]).eqNullSafe(F.col(_["s"])) & (F.col(_["block"]) == F.col(_["b"])))
    #: A source has one block at most that its budget cuts; the place of the last row that fits is its cut.
    place = F.struct(F.col(_["h"]).alias("h"), "doc_id", F.col(_["tokens"]).alias("tokens"))
    spent = F.sum(_["tokens"]).over(Window.partitionBy(_["source"]).orderBy(_["h"], "doc_id", _["tokens"]).rangeBetween(Window.unboundedPreceding, 0))
    narrow = drawn.filter(F.col(_["take"]) == 0).select(_["source"], _["h"], "doc_id", _["tokens"], _["room"]).withColumn(_["spent"], spent)
    cuts = narrow.filter(F.col(_["spent"]) <= F.col(_["room"])).groupBy(F.col(_["source"]).alias(_["c"])).agg(F.max(place).alias(_["cut"]))
    met = drawn.join(small(cuts), F.col(_["source"]).eqNullSafe(F.col(_["c"])), "left")
    both = met.withColumn(_["fits"], (F.col(_["take"]) == 1) | ((F.col(_["take"]) == 0) & F.coalesce(place <= F.col(_["cut"]), F.lit(False))))
    epochs = F.sequence(F.lit(1), (F.col(_["full"]) + F.col(_["fits"]).cast("int")).cast("int"))
    epoch = free_name("_mix_epoch", *docs.columns)
    some = both.filter((F.col(_["full"]) > 0) | F.col(_["fits"])).withColumn(epoch, F.explode(epochs))
    rank = F.pmod(_order(_["source"], _["block"], F.col(epoch), seed), F.lit(1 << 31)).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("mix_tokens", "mix_weight", "mix_epoch", "mix_block_rank")]
    return some.select(*kept, F.col(_["tokens"]).alias("mix_tokens"), F.col(_["weight"]).alias("mix_weight"), F.col(epoch).alias("mix_epoch"), rank.alias("mix_block_rank"))


def _order(source: str, block: str, epoch: Column, seed: int) -> Column:
    return F.xxhash64(source, block, epoch.cast("int"), F.lit(seed))
