"""Ordered computations over groups of any size.

Rows are cut into ranges of (group, order) by Spark's range partitioning and
staged with the number of their range, so a group that holds most rows is
spread over many ranges.  Ranges are summarised in parallel, only the short list
of a group's range summaries is ordered, and every row is finished inside its
own range.  Equal keys never straddle a border and nulls are keys like others,
so results do not depend on the number of ranges.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.runtime import TASK_ROWS, bucket_count, dealt, stage, with_row

_BUCKET = "_bucket"


def bucketed(df: DataFrame, group: list[str], order: list[str | Column], buckets: int | None = None) -> DataFrame:
    """The staged rows with the number of their range of (group, order)."""
    cut = df.repartitionByRange(buckets or bucket_count(df), *group, *order)
    return stage(cut.withColumn(_BUCKET, F.spark_partition_id()))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the left keys stay."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_same_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])


def _summary_window(group: list[str]) -> Window:
    # at most one row per bucket and group, so a short ordered list
    return Window.partitionBy(*group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    sums: dict[str, Column],
    *,
    peaks: dict[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums over an ordered group of any size.

    ``peaks`` adds running maxima of running sums (name -> name of the sum).
    """
    peaks = peaks or {}
    keys = [*group, _BUCKET]
    placed = bucketed(df, group, order, buckets)
    for name, expr in sums.items():
        placed = placed.withColumn(f"_v_{name}", expr)
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed
    if peaks:
        # a bucket's highest point needs its running sums first
        for name in sums:
            local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(inner))
    totals = local.groupBy(*keys).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_l_{src}").alias(f"_h_{n}") for n, src in peaks.items()],
    )
    w = _summary_window(group)
    before = totals.select(
        "*", *[F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    before = before.select(
        *keys,
        *[f"_b_{n}" for n in sums],
        *[F.max(F.col(f"_b_{src}") + F.col(f"_h_{n}")).over(w).alias(f"_p_{n}") for n, src in peaks.items()],
    )
    joined = join_same(local, before, keys)
    for name in sums:
        part = F.col(f"_l_{name}") if peaks else F.sum(f"_v_{name}").over(inner)
        joined = joined.withColumn(name, F.col(f"_b_{name}") + part)
    for name, src in peaks.items():
        joined = joined.withColumn(name, F.greatest(F.max(src).over(inner), F.col(f"_p_{name}")))
    return joined.select(*df.columns, *sums, *peaks)


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per distinct value: its count, rows at or below it, and the average-tie rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_ties"))
    scanned = running(counts, group, [F.col(value)], {"n_upto": F.col("n_ties")})
    rank = F.col("n_upto") - F.col("n_ties") + (F.col("n_ties") + 1) / 2
    return scanned.withColumn("avg_rank", rank)


def with_average_ranks(df: DataFrame, group: list[str], names: dict[str, str]) -> DataFrame:
    """Average-tie rank of each value column (``names``: value -> rank) in its group.

    Rows with a null value are dropped.  A rank moves the rows once: groups that
    fit a task go there whole, larger ones are cut by value, and what lies below
    a cut travels as one more row of it.  ``df`` is read a few times, so it
    should be a stored table or little work above one.
    """
    known = df.dropna(subset=list(names))
    sizes = known.groupBy(*group).agg(F.count("*").alias("_n"))
    rows, most = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    ranked = known
    for value, name in names.items():
        ranked = _ranked(ranked, known, group, value, name, rows, most)
    return ranked


def _ranked(df: DataFrame, source: DataFrame, group: list[str], value: str, name: str, rows: int, most: int) -> DataFrame:
    """``df`` with the rank of ``value``; ``source`` has the same rows and is cheaper to read."""
    if most <= TASK_ROWS:
        near = Window.partitionBy(*group).orderBy(value)
        placed = dealt(df, group, rows) if group else df
        return placed.withColumn(name, (F.rank().over(near) + _upto(near)) / 2)
    keys = [*group, _BUCKET]
    bounds = _bounds(source, value, -(-most // TASK_ROWS))
    counts = _cut(source, value, bounds).groupBy(*keys).agg(F.count("*").alias("_n"))
    below = counts.select(*keys, F.coalesce(F.sum("_n").over(_summary_window(group)), F.lit(0)).alias("_below"))
    # the row of a cut has no value, so it comes first and counts as one row below
    both = _cut(df, value, bounds).unionByName(below, allowMissingColumns=True)
    near = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.max("_below").over(whole) + (F.rank().over(near) + _upto(near)) / 2 - 1
    return dealt(both, keys, rows).withColumn(name, rank).where(F.col("_below").isNull()).select(*df.columns, name)


def _upto(near: Window) -> Column:
    """Rows at or below the current value; with the rank, half way gives the average of ties."""
    return F.count("*").over(near.rangeBetween(Window.unboundedPreceding, Window.currentRow))


def _bounds(df: DataFrame, value: str, parts: int) -> list[float]:
    """Values that cut the rows into about equal parts; a frequent one is a bound once."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(_plain(value), shares, max(10_000, 10 * parts))).first()[0]
    return sorted({v for v in found if math.isfinite(v)})


def _plain(value: str) -> Column:
    """The value as a double with one zero; equal values stay equal and the order stays."""
    return F.when(F.col(value) == 0, F.lit(0.0)).otherwise(F.col(value).cast("double"))


def _cut(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """``df`` with the number of the part each value falls into; equal values share one."""
    if not bounds:
        return df.withColumn(_BUCKET, F.lit(0))
    split = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_plain", outputCol=_BUCKET)
    placed = split.transform(df.withColumn("_plain", _plain(value))).drop("_plain")
    return placed.withColumn(_BUCKET, F.col(_BUCKET).cast("int"))


def exact_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group from value counts; null for a group of nulls."""
    ranks = value_ranks(df, group, value)
    totals = df.groupBy(*group).agg(F.count(value).alias("_n"))
    joined = join_same(totals, ranks, group, "left") if group else with_row(ranks, totals)
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    first = F.col("n_upto") - F.col("n_ties")

    def at(pos: Column) -> Column:
        return F.max(F.when((first < pos) & (F.col("n_upto") >= pos), F.col(value)))

    picked = joined.groupBy(*group).agg(at(low).alias("_lo"), at(high).alias("_hi"))
    return picked.select(*group, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def path_summary(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    ret: str,
    *,
    buckets: int | None = None,
) -> DataFrame:
    """Compounded path statistics of an ordered sequence of returns.

    Equity is kept as a log sum, so a bucket needs only its total, its lowest
    and highest point and its own drawdown; buckets then combine like numbers.
    Gives ``max_drawdown`` (peak starts at 1), ``max_consecutive_loss`` and
    ``total_return`` per group.
    """
    keys = [*group, _BUCKET]
    step = F.log(F.greatest(1 + F.col(ret), F.lit(1e-300)))
    base = bucketed(df, group, order, buckets)
    placed = base.select(
        *keys, step.alias("_step"), (F.col(ret) > 0).alias("_win"), *_order_cols(order, keys)
    )
    inner = Window.partitionBy(*keys).orderBy(*_order_names(order))
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    level = placed.select(
        *keys,
        "_win",
        F.sum("_step").over(upto).alias("_level"),
        F.row_number().over(inner).alias("_rn"),
        *_order_names(order),
    )
    level = level.select(
        *keys,
        "_win",
        "_level",
        "_rn",
        F.max("_level").over(upto).alias("_peak"),
        F.coalesce(F.max(F.when(F.col("_win"), F.col("_rn"))).over(upto), F.lit(0)).alias("_last_win"),
        F.when(F.col("_rn") == F.max("_rn").over(Window.partitionBy(*keys)), F.col("_level")).alias("_end"),
    )
    parts = level.groupBy(*keys).agg(
        F.max("_end").alias("total"),
        F.max("_peak").alias("high"),
        F.min("_level").alias("low"),
        F.max(F.col("_peak") - F.col("_level")).alias("fall"),
        F.count("*").alias("n"),
        F.max(F.col("_rn") - F.col("_last_win")).alias("streak"),
        F.min(F.when(F.col("_win"), F.col("_rn"))).alias("first_win"),
        F.max(F.when(F.col("_win"), F.col("_rn"))).alias("last_win"),
    )
    before = _summary_window(group)
    offset = F.coalesce(F.sum("total").over(before), F.lit(0.0))
    seen = F.coalesce(F.sum("n").over(before), F.lit(0))
    placed_parts = parts.select("*", offset.alias("off"), seen.alias("seen"))
    carried = placed_parts.select(
        "*",
        F.greatest(
            F.lit(0.0), F.coalesce(F.max(F.col("off") + F.col("high")).over(before), F.lit(0.0))
        ).alias("peak_before"),
        (
            F.col("seen") - F.coalesce(F.max(F.col("seen") + F.col("last_win")).over(before), F.lit(0))
        ).alias("losing"),
    )
    fall = F.greatest(F.col("fall"), F.col("peak_before") - F.col("off") - F.col("low"))
    head = F.col("losing") + F.coalesce(F.col("first_win") - 1, F.col("n"))
    return carried.groupBy(*group).agg(
        (1 - F.exp(-F.greatest(F.lit(0.0), F.max(fall)))).alias("max_drawdown"),
        F.max(F.greatest(F.col("streak"), head)).cast("long").alias("max_consecutive_loss"),
        (F.exp(F.sum("total")) - 1).alias("total_return"),
    )


def _order_names(order: list[str | Column]) -> list[str]:
    return [o for o in order if isinstance(o, str)]


def _order_cols(order: list[str | Column], taken: list[str]) -> list[str]:
    return [o for o in _order_names(order) if o not in taken]
