"""Trade tables aggregated into performance metrics and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.indicators import EVENT_INDICATORS
from tapeloom.operators.ordered import (
    exact_median,
    path_summary,
    running,
)

TRADE_ORDER = ["symbol", "signal_idx"]

METRIC_COLUMNS = (
    "win_rate",
    "avg_return",
    "avg_win_return",
    "avg_loss_return",
    "median_return",
    "profit_loss_ratio",
    "max_drawdown",
    "sharpe_ratio",
    "signal_count",
    "avg_holding_days",
    "max_consecutive_loss",
    "total_return",
)


def win() -> Column:
    return F.col("return_pct") > 0


def win_share() -> Column:
    return F.avg(win().cast("double"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def basic_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free metrics: one hash aggregation with map-side partials."""
    r = F.col("return_pct")
    agg = trades.groupBy(*keys).agg(
        F.count("*").alias("n"),
        win_share().alias("wr"),
        F.avg(r).alias("mean"),
        F.avg(F.when(r > 0, r)).alias("win"),
        F.avg(F.when(r <= 0, r)).alias("loss"),
        F.stddev_samp(r).alias("std"),
        F.avg(F.when(F.col("holding_days") > 0, F.col("holding_days"))).alias("hold"),
    )
    avg_win = F.coalesce(F.col("win"), F.lit(0.0))
    avg_loss = F.coalesce(F.abs(F.col("loss")), F.lit(0.001))
    ratio = F.coalesce(avg_win / F.nullif(avg_loss, F.lit(0.0)), F.lit(0.0))
    sharpe = F.coalesce(
        F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) * F.sqrt(F.least(F.col("n"), F.lit(250))),
        F.lit(0.0),
    )
    return agg.select(
        *keys,
        F.round("wr", 4).alias("win_rate"),
        F.round("mean", 6).alias("avg_return"),
        F.round(avg_win, 6).alias("avg_win_return"),
        F.round(F.coalesce(F.col("loss"), F.lit(0.0)), 6).alias("avg_loss_return"),
        F.round(ratio, 4).alias("profit_loss_ratio"),
        F.round(sharpe, 4).alias("sharpe_ratio"),
        F.col("n").alias("signal_count"),
        F.round(F.coalesce("hold", F.lit(0.0)), 1).alias("avg_holding_days"),
    )


def median_return(trades: DataFrame, keys: list[str]) -> DataFrame:
    med = exact_median(trades, keys, "return_pct", "median_return")
    # returns have six digits, so the mean of the two middle ones is often an exact
    # half; the nudge decides it upward whatever the last bit of the double is
    return med.withColumn("median_return", F.round(F.col("median_return") + 1e-12, 6))


def path_metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the trade sequence, in symbol then bar order."""
    # the rows are cut into ranges and written, so only what the path needs goes along
    slim = trades.select(*dict.fromkeys([*keys, *TRADE_ORDER, "return_pct"]))
    path = path_summary(slim, keys, TRADE_ORDER, "return_pct")
    return path.select(
        *keys,
        F.round("max_drawdown", 4).alias("max_drawdown"),
        "max_consecutive_loss",
        F.round("total_return", 6).alias("total_return"),
    )


def overall_metrics(trades: DataFrame, keys: list[str], roster: DataFrame | None = None) -> DataFrame:
    """All trade metrics, one row per key.

    ``roster`` lists keys that must appear even without trades (zeros).
    """
    parts = [
        basic_metrics(trades, keys),
        median_return(trades, keys),
        path_metrics(trades, keys),
    ]
    joined = reduce(lambda a, b: a.join(b, keys), parts)
    if roster is not None:
        joined = roster.select(*keys).join(joined, keys, "left").fillna(0, subset=list(METRIC_COLUMNS))
    return joined.select(*keys, *METRIC_COLUMNS)


def by_regime(trades: DataFrame, keys: list[str]) -> DataFrame:
    known = trades.where(F.col("regime").isNotNull())
    return basic_metrics(known, [*keys, "regime"]).select(
        *keys, "regime", "win_rate", "avg_return", "signal_count"
    )


def by_sector(trades: DataFrame, keys: list[str]) -> DataFrame:
    known = trades.where(F.coalesce(F.col("sector"), F.lit("")) != "")
    return overall_metrics(known, [*keys, "sector"])


# The takeaway texts, in the order in which at most PATTERN_LINES of them are kept.
PATTERN_TEXTS = {
    "best_regime": "Best regime fit: %s (win_rate=%.1f%%, signals=%d)",
    "weak_regime": "Weak regime: %s (win_rate=%.1f%%, signals=%d)",
    "sector_edge": "Sector edge: %s (win_rate=%.1f%%, signals=%d)",
    "benchmark": "Buy-and-hold %s by %.2f%%",
    "events": "Event-aware indicators active with %.1f%% provider coverage",
}
PATTERN_LINES = 5


def _tenths(share: Column, digits: int) -> Column:
    """A share in percent, decimal halves rounded up, as any engine can repeat it."""
    return F.round(share.cast("decimal(20,6)") * 100, digits).cast("double")


def top_patterns(
    regimes: DataFrame, sectors: DataFrame, keys: list[str], *, excess: DataFrame | None = None, events: DataFrame | None = None
) -> DataFrame:
    """Best and worst regime and best sector per key, by (return, win rate), and what the baselines say.

    ``excess`` (one row, ``excess_return``) adds the comparison with buy and
    hold; ``events`` (one row of :func:`event_coverage`) the provider coverage
    where the strategy uses event indicators.
    """

    def pick(df: DataFrame, kind: str, name: str, best: bool) -> DataFrame:
        rank = F.struct("avg_return", "win_rate")
        row = F.struct(F.col(name).alias("label"), "win_rate", "signal_count")
        chosen = F.max_by(row, rank) if best else F.min_by(row, rank)
        text = F.format_string(PATTERN_TEXTS[kind], "label", _tenths(F.col("win_rate"), 1), "signal_count")
        return df.groupBy(*keys).agg(chosen.alias("_r")).select(*keys, F.lit(kind).alias("kind"), "_r.*").withColumn("text", text)

    best = pick(regimes, "best_regime", "regime", True)
    weak = pick(regimes, "weak_regime", "regime", False)
    differs = best.select(*keys, F.col("label").alias("_best"))
    weak = weak.join(differs, keys).where(F.col("label") != F.col("_best")).drop("_best")
    rows = best.unionByName(weak).unionByName(pick(sectors, "sector_edge", "sector", True))
    none = {"label": F.lit(None).cast("string"), "win_rate": F.lit(None).cast("double"), "signal_count": F.lit(None).cast("long")}
    subjects = regimes.select(*keys).union(sectors.select(*keys)).distinct()
    if excess is not None:
        gap = F.col("_row.excess_return")
        said = F.format_string(PATTERN_TEXTS["benchmark"], F.when(gap > 0, "outperformed").otherwise("lagged"), _tenths(F.abs(gap), 2))
        line = subjects.withColumn("_row", excess.select(F.struct("excess_return")).scalar())
        rows = rows.unionByName(line.select(*keys, F.lit("benchmark").alias("kind"), *[v.alias(k) for k, v in none.items()], said.alias("text")))
    if events is not None:
        line = subjects.withColumn("_row", events.select(F.struct("provider_coverage", "relevant_indicators")).scalar())
        said = F.format_string(PATTERN_TEXTS["events"], _tenths(F.col("_row.provider_coverage"), 1))
        used = line.where(F.size("_row.relevant_indicators") > 0)
        rows = rows.unionByName(used.select(*keys, F.lit("events").alias("kind"), *[v.alias(k) for k, v in none.items()], said.alias("text")))
    return rows


def worst_trades(trades: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Lowest returns; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy("return_pct", *TRADE_ORDER)
    return trades.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def confidence_score(complexity: float | Column = 0.0, *, anti_fit: bool = True) -> Column:
    """Weighted score in [0, 1] over metric columns (and anti-fit columns)."""
    n = F.col("signal_count")
    zero, one = F.lit(0.0), F.lit(1.0)
    consistency, sensitivity, penalty = F.lit(0.5), F.lit(0.5), F.lit(0.0)
    if anti_fit:
        consistency = F.greatest(zero, F.col("yearly_consistency"))
        sensitivity = F.greatest(zero, 1 - F.col("param_sensitivity"))
        penalty = F.when(F.col("train_val_gap") > 0.10, 0.15).otherwise(0.0) + F.when(
            F.col("val_test_gap") > 0.08, 0.10
        ).otherwise(0.0)
    trust = F.when(n < 10, 0.3).when(n < 30, F.greatest(F.lit(0.5), n / 30)).otherwise(1.0)
    raw = (
        0.25 * F.least(one, F.col("win_rate") / 0.7)
        + 0.15 * clamp(F.col("avg_return") / 0.05)
        + 0.15 * F.least(one, F.col("profit_loss_ratio") / 2.5)
        + 0.15 * F.greatest(zero, 1 - F.col("max_drawdown") / 0.30)
        + 0.10 * clamp(F.col("sharpe_ratio") / 2.0)
        + 0.10 * consistency
        + 0.10 * sensitivity
        - penalty
        - (F.lit(complexity) if not isinstance(complexity, Column) else complexity) * 0.10
    ) * trust
    return F.round(clamp(F.when(n < 10, F.least(raw, F.lit(0.15))).otherwise(raw)), 4)


def exit_reasons(trades: DataFrame, keys: list[str]) -> DataFrame:
    reason = F.coalesce(F.col("exit_reason"), F.lit("unknown"))
    return trades.groupBy(*keys, reason.alias("exit_reason")).agg(F.count("*").alias("trades"))


def return_histogram(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Equal-width bins of percent returns; bin count follows the trade count."""
    pct = trades.where(F.col("exit_date").isNotNull()).select(*keys, (F.col("return_pct") * 100).alias("pct"))
    edges = pct.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("pct").alias("low"), F.max("pct").alias("high")
    )
    bins = F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 3)))
    edges = edges.withColumn("bins", bins.cast("int")).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    placed = pct.join(edges, keys)
    number = F.least(
        F.col("bins") - 1,
        F.floor(F.coalesce((F.col("pct") - F.col("low")) / F.nullif(F.col("width"), F.lit(0.0)), F.lit(0.0))),
    )
    return placed.groupBy(*keys, number.cast("int").alias("bin")).agg(
        F.count("*").alias("trades"),
        F.first(F.col("low")).alias("_low"),
        F.first(F.col("width")).alias("_width"),
    ).select(
        *keys,
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_end"),
        "trades",
    )


def event_coverage(sources: DataFrame, indicators: Sequence[str] = ()) -> DataFrame:
    """Per-symbol event source labels counted as provider, mixed or proxy.

    ``relevant_indicators`` are those of ``indicators`` that look at events.
    """
    label = F.coalesce(F.col("event_source"), F.lit("proxy"))
    plain = sources.groupBy("symbol").agg(F.max(label).alias("label"))
    label = F.col("label")
    mixed = label.contains("+proxy")
    proxy = label == "proxy"
    agg = plain.agg(
        F.count("*").alias("total_symbols"),
        F.count_if(~proxy & ~mixed).alias("provider_symbols"),
        F.count_if(mixed).alias("mixed_symbols"),
        F.count_if(proxy).alias("proxy_symbols"),
    )
    total = F.nullif(F.col("total_symbols"), F.lit(0))
    return agg.withColumns(
        {
            "provider_coverage": F.round((F.col("provider_symbols") + F.col("mixed_symbols")) / total, 4),
            "proxy_only_coverage": F.round(F.col("proxy_symbols") / total, 4),
            "relevant_indicators": F.array(*[F.lit(n) for n in sorted(set(indicators) & set(EVENT_INDICATORS))]).cast("array<string>"),
        }
    )


def event_source_breakdown(sources: DataFrame) -> DataFrame:
    plain = sources.groupBy("symbol").agg(F.max(F.coalesce(F.col("event_source"), F.lit("proxy"))).alias("label"))
    named = plain.where(F.col("label") != "proxy")
    provider = F.nullif(F.regexp_extract("label", r"^(.*?)(\+proxy.*)?$", 1), F.lit(""))
    return named.groupBy(F.coalesce(provider, F.lit("provider")).alias("provider")).agg(F.count("*").alias("symbols"))


def equity_series(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Per trade in exit order: cumulative percent return and drawdown.

    The running sum and the running peak both come from bucketed scans.
    """
    done = trades.where(F.col("exit_date").isNotNull()).select(
        *keys, "symbol", "signal_idx", "exit_date", F.log(F.greatest(1 + F.col("return_pct"), F.lit(1e-300))).alias("step")
    )
    order = ["exit_date", "symbol", "signal_idx"]
    walked = running(
        done, keys, order, {"trade_no": F.lit(1), "level": F.col("step")}, peaks={"peak": "level"}
    )
    value, top = F.exp("level") * 100, F.exp("peak") * 100
    return walked.select(
        *keys,
        "symbol",
        "signal_idx",
        "trade_no",
        (value - 100).alias("cum_return_pct"),
        F.coalesce((value - top) / F.nullif(top, F.lit(0.0)) * 100, F.lit(0.0)).alias("drawdown_pct"),
    )
