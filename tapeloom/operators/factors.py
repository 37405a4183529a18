"""Factor observations and their rank statistics.

A cross-section or pooled table too large for one task is ranked in parts cut by
value (see :mod:`ordered`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.operators.ordered import join_same, running, value_ranks, with_average_ranks
from tapeloom.runtime import dealt, stage, with_row

# Validation thresholds.
THRESHOLDS = {
    "min_ic_abs": 0.02,
    "min_ir": 0.3,
    "min_monthly_win_rate": 0.5,
    "max_turnover": 0.8,
    "max_cross_correlation": 0.7,
}
MIN_CROSS_SECTION = 4
# fixed values: below these many rows a rate is 0
MIN_WIN_ROWS, MIN_TURNOVER_ROWS = 20, 10


def forward_return(bars: DataFrame, horizon: int = 5, *, name: str = "r") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    later = F.lead("close", horizon).over(w)
    return bars.withColumn(name, later / F.nullif(F.col("close"), F.lit(0.0)) - 1)


def observations(bars: DataFrame, factor: Column, horizon: int = 5) -> DataFrame:
    return forward_return(bars, horizon).select("symbol", "date", factor.cast("double").alias("f"), "r")


def _complete(obs: DataFrame) -> DataFrame:
    ok = F.col("f").isNotNull() & F.col("r").isNotNull() & ~F.isnan("f") & ~F.isnan("r")
    return obs.where(ok)


def _rank_corr(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    ranked = with_average_ranks(df.select(*group, a, b), group, {a: "_ra", b: "_rb"})
    # merged deviations of equal ranks differ from 0 in the last bit, so equal ranks are told by their ends
    varied = (F.min("_ra") < F.max("_ra")) & (F.min("_rb") < F.max("_rb"))
    corr = F.covar_pop("_ra", "_rb") / F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))
    return ranked.groupBy(*group).agg(F.when(varied, corr).alias("ic"), F.count("*").alias("n"))


def daily_ic(obs: DataFrame) -> DataFrame:
    """Rank IC per date with enough symbols."""
    clean = _complete(obs)
    # observations hold one row per (symbol, date), so rows count symbols
    return _rank_corr(clean, ["date"], "f", "r").where(
        (F.col("n") >= MIN_CROSS_SECTION) & F.col("ic").isNotNull()
    )


def positions(obs: DataFrame) -> DataFrame:
    """Number the rows by (date, symbol) without one global sort."""
    order = ["date", "symbol"]
    return running(obs, [], order, {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1)


def in_chunks(obs: DataFrame, parts: int, least: int) -> DataFrame:
    """The rows by (date, symbol) in ``parts`` runs of ``size`` rows, ``least`` at least, numbered by ``chunk``.

    Counts per date place all rows of a date that lies in one run; only dates
    across a border are numbered by symbol.  Adds ``size`` and ``rows`` too.
    """
    counts = obs.groupBy("date").agg(F.count("*").alias("_n"))
    # one row per calendar day
    start = F.sum("_n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    days = counts.select("date", "_n", F.coalesce(start, F.lit(0)).alias("_start"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    size = F.greatest(F.floor(F.col("rows") / parts), F.lit(least))
    days = with_row(days, total).withColumn("size", size).withColumns(
        {"chunk": F.floor(F.col("_start") / F.col("size")), "_last": F.floor((F.col("_start") + F.col("_n") - 1) / F.col("size"))}
    )
    placed = join_same(obs, stage(days.drop("_n")), ["date"])
    across = running(placed.where("chunk < _last"), ["date"], ["symbol"], {"_at": F.lit(1)})
    across = across.withColumn("chunk", F.floor((F.col("_start") + F.col("_at") - 1) / F.col("size"))).drop("_at")
    return placed.where("chunk = _last").unionByName(across).drop("_start", "_last")


def pooled_ic(obs: DataFrame) -> DataFrame:
    """Pooled rank correlation with the spread of five positional chunks."""
    clean = _complete(obs)
    chunked = in_chunks(clean, 5, 10).where((F.col("chunk") + 1) * F.col("size") <= F.col("rows"))
    chunks = _rank_corr(chunked.select("chunk", "f", "r"), ["chunk"], "f", "r").where(F.col("ic").isNotNull())
    spread = chunks.agg(
        F.when(F.count("*") > 1, F.stddev_pop("ic")).otherwise(1.0).alias("chunk_std")
    )
    whole = _rank_corr(clean.select("f", "r"), [], "f", "r")
    poor = (F.col("n") < 10) | F.col("ic").isNull()
    return with_row(whole, spread).select(
        F.when(poor, 0.0).otherwise(F.col("ic")).alias("ic_mean"),
        F.when(poor, 1.0).otherwise(F.col("chunk_std")).alias("ic_std"),
    )


def ic_summary(daily: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Mean and spread of the daily IC; the pooled values below three dates."""
    agg = daily.agg(
        F.count("*").alias("ic_dates"),
        F.avg("ic").alias("_m"),
        F.when(F.stddev_pop("ic") > 1e-10, F.stddev_pop("ic")).otherwise(1.0).alias("_s"),
    )
    if pooled is None:
        few_m, few_s = F.lit(0.0), F.lit(1.0)
    else:
        agg = with_row(agg, pooled)
        few_m, few_s = F.col("ic_mean"), F.col("ic_std")
    enough = F.col("ic_dates") >= 3
    out = agg.select(
        "ic_dates",
        F.when(enough, F.col("_m")).otherwise(few_m).alias("ic_mean"),
        F.when(enough, F.col("_s")).otherwise(few_s).alias("ic_std"),
    )
    return out.withColumn("ir", F.when(F.col("ic_std") > 1e-10, F.col("ic_mean") / F.col("ic_std")).otherwise(0.0))


def _none_below(result: DataFrame, rows: DataFrame, least: int, name: str) -> DataFrame:
    """The result with 0 in ``name`` where ``rows`` has fewer than ``least`` rows."""
    n = with_row(result, rows.agg(F.count("*").alias("_rows")))
    return n.withColumn(name, F.when(F.col("_rows") < least, 0.0).otherwise(F.col(name))).drop("_rows")


def _positive(value: Column) -> Column:
    """Share of positive values; an exact zero counts as zero whatever its last bit says."""
    return F.avg((F.round(value, 12) > 0).cast("double"))


def monthly_win_rate(daily: DataFrame, *, sign: int = 1, obs: DataFrame | None = None) -> DataFrame:
    """Share of months whose mean daily IC has the expected sign.

    With the observations at hand, fewer than 20 complete ones give 0.
    """
    month = daily.groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("ic").alias("m"))
    out = month.agg(
        F.coalesce(_positive(F.col("m") * sign), F.lit(0.0)).alias("monthly_win_rate"),
        F.count("*").alias("months"),
    )
    return out if obs is None else _none_below(out, _complete(obs), MIN_WIN_ROWS, "monthly_win_rate")


def monthly_pooled_ic(obs: DataFrame, *, sign: int = 1) -> DataFrame:
    """The variant without symbols: one rank IC per month of at least five rows."""
    clean = _complete(obs).select(F.trunc("date", "month").alias("month"), "f", "r")
    ics = _rank_corr(clean, ["month"], "f", "r").where((F.col("n") >= 5) & F.col("ic").isNotNull())
    out = ics.agg(
        F.coalesce(_positive(F.col("ic") * sign), F.lit(0.0)).alias("monthly_win_rate"),
        F.count("*").alias("months"),
    )
    return _none_below(out, clean, MIN_WIN_ROWS, "monthly_win_rate")


def bucket_win_rate(obs: DataFrame, *, sign: int = 1) -> DataFrame:
    """The variant without dates: twelve positional buckets of at least five rows."""
    clean = _complete(obs)
    ics = _rank_corr(in_chunks(clean, 12, 5), ["chunk"], "f", "r")
    ics = ics.where((F.col("n") >= 5) & F.col("ic").isNotNull())
    out = ics.agg(
        F.coalesce(_positive(F.col("ic") * sign), F.lit(0.0)).alias("monthly_win_rate"),
        F.count("*").alias("months"),
    )
    return _none_below(out, clean, MIN_WIN_ROWS, "monthly_win_rate")


def turnover(obs: DataFrame) -> DataFrame:
    """Mean rank change of the symbols shared by consecutive usable dates."""
    known = obs.where(F.col("f").isNotNull() & ~F.isnan("f")).select("symbol", "date", "f")
    sizes = known.groupBy("date").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CROSS_SECTION)
    # one row per calendar day
    days = stage(sizes.select("date", F.row_number().over(Window.orderBy("date")).alias("day_no")))
    ranked = with_average_ranks(known, ["date"], {"f": "rank"}).join(days, "date")
    slim = ranked.where(F.col("symbol").isNotNull()).select("symbol", "day_no", "rank")
    # the symbol's ranks of the day before, one where it has one row a day
    before = F.collect_list("rank").over(Window.partitionBy("symbol").orderBy("day_no").rangeBetween(-1, -1))
    moved = F.aggregate("_before", F.lit(0.0), lambda total, x: total + F.abs(F.col("rank") - x))
    steps = dealt(slim, "symbol", known.count()).withColumn("_before", before).where(F.size("_before") > 0)
    pairs = steps.groupBy("day_no").agg(
        (F.sum(moved) / F.sum(F.size("_before"))).alias("move"), F.sum(F.size("_before")).alias("common")
    )
    kept = pairs.where(F.col("common") >= MIN_CROSS_SECTION)
    out = kept.agg(
        F.coalesce(F.avg(F.col("move") / F.col("common")), F.lit(0.0)).alias("turnover"),
        F.count("*").alias("steps"),
    )
    return _none_below(out, known, MIN_TURNOVER_ROWS, "turnover")


def half_split_turnover(obs: DataFrame) -> DataFrame:
    """The variant without dates: ranks of the first against the second half."""
    known = obs.where(F.col("f").isNotNull() & ~F.isnan("f"))
    total = known.agg(F.floor(F.count("*") / 2).alias("half"), F.count("*").alias("rows"))
    placed = with_row(positions(known), total)
    part = F.floor(F.col("pos") / F.greatest("half", F.lit(1)))
    halves = stage(placed.withColumn("part", part).where(F.col("part") < 2).select("part", "pos", "f", "half", "rows"))
    ranked = with_average_ranks(halves, ["part"], {"f": "rank"})
    first = ranked.where("part = 0").select("pos", F.col("rank").alias("r1"), "half", "rows")
    second = ranked.where("part = 1").select((F.col("pos") - F.col("half")).alias("pos"), F.col("rank").alias("r2"))
    return first.join(second, "pos").agg(
        F.when(F.max("rows") < 10, 0.0)
        .otherwise(F.coalesce(F.avg(F.abs(F.col("r1") - F.col("r2"))) / F.max("half"), F.lit(0.0)))
        .alias("turnover")
    )


def cross_correlation(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pooled rank correlation of two factors; 0 below ten rows."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    whole = _rank_corr(both, [], a, b)
    return whole.select(
        F.when(F.col("n") < 10, 0.0).otherwise(F.coalesce("ic", F.lit(0.0))).alias("correlation"), "n"
    )


def validate(
    obs: DataFrame, *, sign: int = 1, others: dict[str, Column] | None = None, thresholds: dict[str, float] = THRESHOLDS
) -> DataFrame:
    """One row: IC, IR, monthly win rate, turnover, failed gates.

    ``others`` names further factor columns of ``obs`` to test for overlap.
    """
    daily = stage(daily_ic(obs))
    row = ic_summary(daily, pooled_ic(obs))
    row = with_row(row, monthly_win_rate(daily, sign=sign, obs=obs).select("monthly_win_rate"))
    row = with_row(row, turnover(obs).select("turnover"))
    limits = thresholds
    reasons = [
        F.when(F.col("ic_mean") * sign < limits["min_ic_abs"], "ic_mean"),
        F.when(F.col("ir") * sign < limits["min_ir"], "ir"),
        F.when(F.col("monthly_win_rate") < limits["min_monthly_win_rate"], "monthly_win_rate"),
        F.when(F.col("turnover") > limits["max_turnover"], "turnover"),
    ]
    for name, column in (others or {}).items():
        corr = cross_correlation(obs.select(F.col("f").alias("a"), column.alias("b")))
        row = with_row(row, corr.select(F.col("correlation").alias(f"corr_{name}")))
        reasons.append(F.when(F.abs(f"corr_{name}") > limits["max_cross_correlation"], f"correlated_{name}"))
    row = row.withColumn("reasons", F.filter(F.array(*reasons), lambda x: x.isNotNull()))
    return row.withColumn("passed", F.size("reasons") == 0)


# ── user factors ─────────────────────────────────────────────────────────────


def grouped_factor(bars: DataFrame, factor: Callable[[pd.DataFrame], pd.Series], name: str) -> DataFrame:
    """Run a pandas factor inside each symbol's bars (one row per calendar day).

    The result must have one value per bar; a value that is not finite is 0.
    """
    schema = T.StructType([*bars.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        values = pd.Series(factor(pdf.copy()))
        if len(values) != len(pdf):
            raise ValueError(f"factor {name} gave {len(values)} values for {len(pdf)} bars")
        numbers = pd.to_numeric(values, errors="coerce").to_numpy(dtype=float)
        pdf[name] = np.where(np.isfinite(numbers), numbers, 0.0)
        return pdf

    return bars.groupBy("symbol").applyInPandas(run, schema)


def leak_check(bars: DataFrame, factor: Callable[[DataFrame], DataFrame], name: str, cut: Column) -> DataFrame:
    """Rows whose factor value changes when later bars are removed.

    ``cut`` is the last date kept.  A factor that looks only back gives no row.
    """
    full = factor(bars).where(F.col("date") <= cut).select("symbol", "date", F.col(name).alias("with_future"))
    past = factor(bars.where(F.col("date") <= cut)).select("symbol", "date", F.col(name).alias("without_future"))
    joined = full.join(past, ["symbol", "date"])
    same = F.col("with_future").eqNullSafe(F.col("without_future"))
    near = F.abs(F.col("with_future") - F.col("without_future")) <= 1e-9
    return joined.where(~(same | F.coalesce(near, F.lit(False))))


def sector_strength(bars: DataFrame, value: str, *, name: str = "intra_sector_strength_rank_pct") -> DataFrame:
    """Percent rank (0 = strongest) inside each date and sector, from value counts."""
    group = ["date", "sector"]
    ranks = value_ranks(bars, group, value)
    sizes = bars.groupBy(*group).agg(F.count("*").alias("_n"))
    # rows strictly above a value = rows in the group minus rows at or below it
    place = ranks.join(sizes, group).select(
        *group, value, ((F.col("_n") - F.col("n_upto")) / F.nullif(F.col("_n") - 1, F.lit(0))).alias(name)
    )
    return bars.join(place, [*group, value], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
