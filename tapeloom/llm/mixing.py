"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks.  With weight w, a source's block
number j is released at slot floor(j / w) and due before slot
ceil((j + 1) / w); in every slot the released block with the earliest deadline
goes next.  The share of every source then stays within one block of its
weight at every slot.

Weights are exact fractions, so the schedule repeats after their common
denominator.  One period, or less where a source runs out before, is all that
is worked out by hand; it turns block numbers into slots by arithmetic.  When a source runs out, the others share its weight
from there on (a new phase), so every row gets a place.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 64
BUCKET_ROWS = 2_500
OTHER = "other"
MAX_SOURCES = 500
#: Slots of a plan that are sent to every task; a longer plan is joined by block.
MAX_SLOTS_SENT = 500_000
_RESULTS = ("mix_group", "mix_phase", "mix_slot", "mix_rank")


def _fraction(weight: float | Fraction) -> Fraction:
    """The simplest fraction that is this number: 1/20 for 0.05, 1/3 for 1 / 3."""
    if isinstance(weight, float):
        near = (Fraction(weight).limit_denominator(10**digits) for digits in range(1, 18))
        return next((f for f in near if float(f) == weight), Fraction(weight))
    return Fraction(weight)


def exact_weights(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Weights as the smallest integers in the same proportions; their sum is the period."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {k: _fraction(w) for k, w in weights.items()}
    unit = math.lcm(*(f.denominator for f in exact.values()))
    whole = {k: int(f * unit) for k, f in exact.items()}
    common = math.gcd(*whole.values())
    return {k: n // common for k, n in whole.items()}


def one_period(whole: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots of every source's blocks in one period, earliest deadline first.

    Ends before that where a source has used up the blocks it has ``left``.
    """
    period = sum(whole.values())
    slots: dict[str, list[int]] = {k: [] for k in whole}
    waiting = [(0, k) for k in sorted(whole)]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * period // whole[k]), k))
        due, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[k].append(slot)
        if left is not None and len(slots[k]) == left[k]:
            break
        if len(slots[k]) < whole[k]:
            heapq.heappush(waiting, (len(slots[k]) * period // whole[k], k))
    return slots


@dataclass(frozen=True)
class Stretch:
    """Blocks ``first`` to ``last`` - 1 of a source, all in one phase."""

    source: str
    phase: int
    first: int
    last: int
    base: int
    slots: list[int]
    period: int


def phases(blocks: dict[str, int], weights: dict[str, float | Fraction]) -> list[Stretch]:
    """The plan: at most (number of sources)² stretches."""
    left, done = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    out, base, phase = [], 0, 0
    while left:
        slots = one_period(exact_weights({k: weights[k] for k in left}), left)
        period = sum(map(len, slots.values()))  # or up to where a source runs out

        def slot_of(k: str, j: int) -> int:
            return j // len(slots[k]) * period + slots[k][j % len(slots[k])]

        length = min(slot_of(k, n - 1) for k, n in left.items() if slots[k]) + 1
        for k, n in list(left.items()):
            turns, rest = divmod(length, period)
            taken = turns * len(slots[k]) + bisect_left(slots[k], rest)
            if taken:
                out.append(Stretch(k, phase, done[k], done[k] + taken, base, slots[k], period))
            done[k] += taken
            left[k] = n - taken
            if not left[k]:
                del left[k]
        base, phase = base + length, phase + 1
    return out


_PLAN = T.StructType(
    [
        T.StructField("_source", T.StringType()),
        T.StructField("phase", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("slots", T.ArrayType(T.IntegerType())),
        T.StructField("_period", T.LongType()),
    ]
)


def _slot_at(j: Column) -> Column:
    return F.get("slots", (j % F.size("slots")).cast("int"))


def _parts(docs: DataFrame, weights: dict[str, float | Fraction], source: str, other: float | Fraction) -> dict[str, Fraction]:
    """Equal parts of ``other`` for the sources found without a weight; what is joint is named ``OTHER``."""
    found = docs.select(F.col(source).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    unnamed = found.where(F.col("s").isNull() | ~F.col("s").isin(*weights))
    members = unnamed.count()
    if not members:
        return {}
    part = _fraction(other) / members
    own = unnamed.where(F.col("s") != OTHER).orderBy(F.desc("n"), "s").limit(MAX_SOURCES - len(weights)).collect()
    parts = {r["s"]: part for r in own}
    if members > len(parts):
        parts[OTHER] = part * (members - len(parts))
    return parts


def schedule(
    docs: DataFrame,
    weights: dict[str, float],
    key: str = "doc_id",
    source: str = "source",
    other: float = 1.0,
    block_rows: int = BLOCK_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    every_source: bool = False,
) -> DataFrame:
    """All rows with ``mix_group``, ``mix_phase``, ``mix_slot`` and ``mix_rank``.

    ``weights`` names at most ``MAX_SOURCES`` sources; all others and null make
    up one group with the weight ``other``.  With ``every_source`` each of those
    found is a group of its own with an equal part of that weight; only null,
    and what lies beyond ``MAX_SOURCES``, smallest first, stays in the joint
    group, which has the parts of all its members.  ``mix_slot`` is the block's place
    in the mixture, ``mix_rank`` the row's place in its block; sorting by both
    gives the mixture, in which no row is lost or repeated.  Within a group
    rows stand in the order of a hash over all their columns, which deals a
    group of any size out to buckets of about ``bucket_rows`` rows; repeated
    rows follow each other.  Columns named like the results are replaced.
    """
    others = [c for c in docs.columns if c not in _RESULTS]
    placed_rows = _schedule(docs.select(*others), weights, key, source, other, block_rows, bucket_rows, every_source)
    return placed_rows.select(*[F.col("row")[c].alias(c) for c in others], *_RESULTS)


def _schedule(
    docs: DataFrame, weights: dict[str, float], key: str, source: str, other: float, block_rows: int, bucket_rows: int, every_source: bool
) -> DataFrame:
    """Every row as one struct ``row`` with its place, so that no column of it can clash."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weighted sources")
    spark = docs.sparkSession
    share = {**weights, OTHER: other}
    if every_source:
        share = {**weights, **_parts(docs, weights, source, other)}
    group = F.when(F.col(source).isin(*(share.keys() - {OTHER} | weights.keys())), F.col(source)).otherwise(F.lit(OTHER))
    rows = docs.select(F.struct(*docs.columns).alias("row"), group.alias("mix_group"), F.xxhash64(*docs.columns, F.lit(1)).alias("_h"))

    # one row per group comes to the driver, at most MAX_SOURCES + 1
    counts = {x["mix_group"]: x["n"] for x in rows.groupBy("mix_group").agg(F.count("*").alias("n")).collect()}
    pieces = {k: max(1, -(-n // bucket_rows)) for k, n in counts.items()}
    lookup = F.create_map(*[F.lit(x) for kv in pieces.items() for x in kv]) if pieces else F.create_map(F.lit(OTHER), F.lit(1))
    rows = rows.withColumn("_bucket", F.pmod(F.col("_h"), F.element_at(lookup, F.col("mix_group")).cast("long")))

    sizes = rows.groupBy("mix_group", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("mix_group").alias("_sg"), F.col("_bucket").alias("_sb"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("mix_group", "_bucket").orderBy("_h", F.col("row")[key])
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1).join(
        starts, (F.col("mix_group") == F.col("_sg")) & (F.col("_bucket") == F.col("_sb"))
    )
    numbered = numbered.withColumn("_n", F.col("_n") + F.col("_start"))
    numbered = numbered.withColumn("_block", F.floor(F.col("_n") / block_rows)).withColumn(
        "mix_rank", (F.col("_n") % block_rows).cast("int")
    )

    plan = phases({k: -(-n // block_rows) for k, n in counts.items()}, share)
    table = spark.createDataFrame([(x.source, x.phase, x.first, x.last, x.base, x.slots, x.period) for x in plan], _PLAN)
    in_group = F.col("mix_group") == F.col("_source")
    if sum(len(x.slots) for x in plan) <= MAX_SLOTS_SENT:
        # at most MAX_SLOTS_SENT numbers in (MAX_SOURCES + 1)² / 2 rows
        joined = numbered.join(F.broadcast(table), in_group & (F.col("_block") >= F.col("first")) & (F.col("_block") < F.col("last")))
    else:
        # a row per block of the table, so that blocks meet rows by an equal key
        blocks = table.withColumn("_at", F.explode(F.sequence("first", F.col("last") - 1)))
        slim = blocks.select("_source", "_at", "phase", "first", "base", "_period", F.size("slots").alias("_turns"), _slot_at(F.col("_at") - F.col("first")).alias("_s"))
        joined = numbered.join(slim, in_group & (F.col("_block") == F.col("_at")))
        slot = F.col("base") + F.floor((F.col("_at") - F.col("first")) / F.col("_turns")) * F.col("_period") + F.col("_s")
        return joined.select("row", "mix_group", F.col("phase").alias("mix_phase"), slot.cast("long").alias("mix_slot"), "mix_rank")
    j = F.col("_block") - F.col("first")
    slot = F.col("base") + F.floor(j / F.size("slots")) * F.col("_period") + _slot_at(j)
    return joined.select("row", "mix_group", F.col("phase").alias("mix_phase"), slot.cast("long").alias("mix_slot"), "mix_rank")


def _places(docs: DataFrame, weights: dict[str, float], key: str, source: str, **options) -> DataFrame:
    chosen = {"other": 1.0, "block_rows": BLOCK_ROWS, "bucket_rows": BUCKET_ROWS, "every_source": False} | options
    return _schedule(docs, weights, key, source, **chosen)


def mixed(docs: DataFrame, weights: dict[str, float], key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows in the order of the mixture, columns unchanged.

    Nulls, repeated rows, extra columns and empty tables as in :func:`schedule`.
    """
    return _places(docs, weights, key, source, **options).orderBy("mix_slot", "mix_rank").select("row.*")


def placed(docs: DataFrame, weights: dict[str, float], key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows in any order, with the ``mix_slot`` and ``mix_rank`` that :func:`mixed` sorts by.

    Places depend on the rows alone, so they can be worked out again where
    the order was lost, as in files.
    """
    others = [c for c in docs.columns if c not in ("mix_slot", "mix_rank")]
    return _places(docs, weights, key, source, **options).select(*[F.col("row")[c].alias(c) for c in others], "mix_slot", "mix_rank")
