"""Blocked Bloom filters as columns.

A filter is one array of 64-bit words, each of them a block: a key's hash picks
one word and four bits in it.  The array is built by a grouped ``bit_or`` and
enters later plans as one scalar subquery, so a probe is one array read and one
mask inside generated code.  Its size has a fixed bound (``max_blocks`` words,
8 MB by default): beyond it more keys pass that are not in the list, none that
is in it is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20
MIN_BLOCKS = 1 << 8
_SEED = 0x5EED
#: Words that travel together while the array is put in order.
_TOGETHER = 4


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _mask(h: Column) -> Column:
    one, mask = F.lit(1).cast("long"), F.lit(0).cast("long")
    for j in range(4):
        bit = F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, bit))
    return mask


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(_SEED))


@dataclass(frozen=True)
class Bloom:
    blocks: int
    words: Column

    def might_contain(self, key: Column) -> Column:
        """False only for keys that are not in the list; false for null."""
        h = _hash(key)
        mask = _mask(h)
        return key.isNotNull() & (F.get(self.words, _block(h, self.blocks)).bitwiseAND(mask) == mask)


def build(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> Bloom:
    """Filter of the non-null values of ``key``; the frame is read twice."""
    keys = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull())
    n, blocks = keys.count(), MIN_BLOCKS
    while blocks < max_blocks and blocks * 64 < n * BITS_PER_KEY:
        blocks *= 2
    h = _hash(F.col("key"))
    at, none = _block(h, blocks), F.lit(0).cast("long")
    names = [f"w{j}" for j in range(_TOGETHER)]
    bits = keys.select(
        (at / _TOGETHER).cast("int").alias("block"), *[F.when(at % _TOGETHER == j, _mask(h)).otherwise(none).alias(w) for j, w in enumerate(names)]
    )
    zeros = keys.sparkSession.range(blocks // _TOGETHER).select(F.col("id").cast("int").alias("block"), *[none.alias(w) for w in names])
    table = bits.unionByName(zeros).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in names])
    rows = table.agg(F.sort_array(F.collect_list(F.struct("block", *names))).alias("rows"))
    words = F.flatten(F.transform("rows", lambda x: F.array(*[x[w] for w in names])))
    return Bloom(blocks, rows.select(words.alias("words")).scalar())
