"""Market regimes from an index or from a symbol's own bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RegimeLimits:
    trend_slope: float = 0.001
    volatility: float = 0.03
    crash_slope: float = -0.003
    ma_short: int = 20
    ma_long: int = 60
    atr_period: int = 20


def with_regime(
    bars: DataFrame, keys: list[str], limits: RegimeLimits = RegimeLimits(), *, name: str = "regime"
) -> DataFrame:
    """Regime of each bar from the last 80 bars of its series.

    Fewer than 20 bars give null; up to the long average plus five bars give
    ``range_bound``.  A series is one symbol or one index: at most one bar a day.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    n, long = limits.ma_short, limits.ma_long
    df = bars.withColumns(
        {
            "_n": F.row_number().over(w),
            "_before": F.lag("close", 1).over(w),
            "_ms": F.avg("close").over(w.rowsBetween(1 - n, 0)),
            "_ms4": F.avg("close").over(w.rowsBetween(-n - 3, -4)),
            "_ml": F.avg("close").over(w.rowsBetween(1 - long, 0)),
            "_top": F.max("close").over(w.rowsBetween(1 - n, 0)),
        }
    )
    spread = F.col("high") - F.col("low")
    df = df.withColumn(
        "_tr",
        F.greatest(spread, F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before"))),
    ).withColumn("_atr", F.avg("_tr").over(w.rowsBetween(1 - limits.atr_period, 0)))
    slope = F.coalesce((F.col("_ms") - F.col("_ms4")) / F.nullif(F.col("_ms4") * 5, F.lit(0.0)), F.lit(0.0))
    vol = F.when(F.col("close") > 0, F.col("_atr") / F.col("close")).otherwise(0.0)
    fall = F.when(F.col("_top") > 0, (F.col("_top") - F.col("close")) / F.col("_top")).otherwise(0.0)
    above = (F.col("close") > F.col("_ml")) & (F.col("_ml") > 0)
    label = (
        F.when(F.col("_n") < 20, F.lit(None).cast("string"))
        .when(F.col("_n") < long + 5, "range_bound")
        .when((slope < limits.crash_slope) & (fall > 0.10), "panic")
        .when(vol > limits.volatility, "volatile")
        .when(
            (slope > limits.trend_slope * 4) & (vol < limits.volatility * 0.5) & above,
            "euphoria",
        )
        .when((slope > limits.trend_slope) & above, "trending_up")
        .when((slope < -limits.trend_slope) & ~above, "trending_down")
        .otherwise("range_bound")
    )
    return df.withColumn(name, label).drop("_n", "_before", "_ms", "_ms4", "_ml", "_top", "_tr", "_atr")


def regime_periods(
    bars: DataFrame,
    keys: list[str],
    limits: RegimeLimits = RegimeLimits(),
    *,
    window: int = 60,
    step: int = 20,
) -> DataFrame:
    """Periods of equal regime from windows of fixed size moved by ``step`` bars."""
    w = Window.partitionBy(*keys).orderBy("date")
    df = with_regime(bars, keys, limits).withColumns(
        {"_i": F.row_number().over(w), "_start": F.lag("date", window - 1).over(w)}
    )
    if window < limits.ma_long + 5:
        df = df.withColumn("regime", F.lit("range_bound"))
    ends = df.where((F.col("_i") >= window) & ((F.col("_i") - window) % step == 0))
    changed = F.coalesce((F.lag("regime", 1).over(w) != F.col("regime")).cast("int"), F.lit(1))
    runs = ends.withColumn("_changed", changed).withColumn(
        "period", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return runs.groupBy(*keys, "period").agg(
        F.min("_start").alias("start_date"), F.max("date").alias("end_date"), F.first("regime").alias("regime")
    )


def coarse_regime(move: Column, breadth: Column) -> Column:
    """Regime from the index move and the share of rising symbols."""
    m, width = F.coalesce(move, F.lit(0.0)), F.coalesce(breadth, F.lit(0.5))
    return (
        F.when(move.isNull() & breadth.isNull(), F.lit(None).cast("string"))
        .when((m <= -0.025) & (width <= 0.25), "panic")
        .when((m >= 0.02) & (width >= 0.75), "euphoria")
        .when((m >= 0.008) & (width >= 0.55), "trending_up")
        .when((m <= -0.008) & (width <= 0.45), "trending_down")
        .when(F.abs(m) >= 0.018, "volatile")
        .otherwise("range_bound")
    )
