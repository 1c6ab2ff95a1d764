"""A blocked Bloom filter as a table of 512-bit blocks, with DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block, bits set for each key, bits of filter for each key.
WORDS, PROBES, BITS_PER_KEY = 8, 7, 16
#: The filter's blocks are broadcast only up to this many bytes.
BROADCAST_BYTES = 64 << 20


def positions(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(511).cast("int") for i in range(PROBES)]


def blocks_for(n_keys: int) -> int:
    return max(1, math.ceil(n_keys * BITS_PER_KEY / (64 * WORDS)))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, words) rows: the filter of keys(key), built by or-ing bits per block before the shuffle."""
    at = keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), F.array(*positions(F.col("key"))).alias("at"))
    own = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("at")[i].bitwiseAND(448) == 64 * w, F.expr(f"shiftleft(1L, at[{i}] & 63)")).otherwise(F.lit(0)) for i in range(PROBES)]) for w in range(WORDS)]
    words = at.select("block", *[x.alias(f"w{w}") for w, x in enumerate(own)])
    return words.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]).select("block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("words"))


def bounded(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def possible(rows: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """The rows whose column key may be among keys(key); false positives stay, nothing listed goes."""
    n = blocks_for(n_keys)
    blocks = bounded(bloom_blocks(keys, n), n * (8 * WORDS + 64))
    set_bits = [F.expr(f"shiftrightunsigned(words[at[{i}] div 64], at[{i}] & 63) & 1") == 1 for i in range(PROBES)]
    probed = rows.withColumns({"block": F.pmod(F.xxhash64("key"), F.lit(n)), "at": F.array(*positions(F.col("key")))})
    return probed.join(blocks, "block").filter(reduce(lambda a, b: a & b, set_bits)).select(*rows.columns)


def fits(n_keys: int) -> bool:
    """Whether a filter of so many keys is small enough to be broadcast."""
    return blocks_for(n_keys) * (8 * WORDS + 64) <= BROADCAST_BYTES
