"""Choosing the symbols of a study from a universe.

Random steps use a seeded hash of the symbol, so a sample is the same on every
run and cluster.  Samples are small by definition; universes are not, so quotas
and positions come from distributed numbering.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.spec import _OPS
from tapeloom.operators.ordered import running
from tapeloom.runtime import stage, with_row

UNKNOWN = "__unknown__"

# Preferred log10 market cap per regime and category shift.
REGIME_LOG_CAP = {
    "trending_up": 10.6,
    "euphoria": 10.9,
    "range_bound": 10.3,
    "volatile": 10.0,
    "trending_down": 9.9,
    "panic": 9.6,
}
CATEGORY_CAP_BIAS = {"trend": 0.15, "rotation": 0.1, "reversal": -0.1, "event": -0.2, "framework": 0.0}
BULLISH = ("trending_up", "euphoria")
STRESS = ("trending_down", "panic", "volatile")
CALM_OR_STRESSED = ("volatile", "panic", "range_bound")


@dataclass(frozen=True)
class Limits:
    max_symbols: int = 30
    min_symbols: int = 10
    seed: int = 42


def hashed(seed: int) -> Column:
    """A seeded order of symbols that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("symbol").cast("string")))


def clamp_target(available: Column, limits: Limits) -> Column:
    return F.greatest(F.lit(limits.min_symbols), F.least(F.lit(limits.max_symbols), available))


def random_pick(universe: DataFrame, n: int, seed: int) -> DataFrame:
    return universe.orderBy(hashed(seed), "symbol").limit(n)


def apply_filters(universe: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Apply (field, op, value) filters in turn.

    A field that is null for the whole current pool is not applied; otherwise
    null never matches.
    """
    wanted = [(field, op, value) for field, op, value in filters if field in universe.columns]
    if not wanted:
        return universe
    pool = stage(universe)
    passed: list[Column] = []
    for field, op, value in wanted:
        match = F.coalesce(_OPS[op](F.col(field), F.lit(value)), F.lit(False)) if op in _OPS else F.lit(False)
        # over the rows that all filters before let through, each applied or not
        left = F.lit(True)
        for ok in passed:
            left = left & ok
        any_known = pool.agg(F.coalesce(F.bool_or(left & F.col(field).isNotNull()), F.lit(False))).first()[0]  # one flag
        passed.append(match if any_known else F.lit(True))
    for ok in passed:
        pool = pool.where(ok)
    return pool


def _eligible(universe: DataFrame) -> DataFrame:
    return universe.where(~F.coalesce(F.col("is_st"), F.lit(False))).withColumn(
        "_sector", F.coalesce(F.nullif(F.col("sector"), F.lit("")), F.lit(UNKNOWN))
    )


def _placed(df: DataFrame, value: Column) -> DataFrame:
    """Position within the sector by ``value`` descending (0-based) and sector size."""
    scored = df.withColumn("_value", value)
    order = [F.col("_value").desc(), F.col("symbol")]
    pos = running(scored, ["_sector"], order, {"_pos": F.lit(1)})
    sizes = df.groupBy("_sector").agg(F.count("*").alias("_size"))
    return pos.withColumn("_pos", F.col("_pos") - 1).join(sizes, "_sector")


def evenly_spaced(pos: Column, size: Column, n: Column) -> Column:
    """Whether a position is one of n evenly spaced picks out of ``size``."""
    step = size / n
    guess = F.floor(pos / step)
    hit = F.lit(False)
    for i in (guess, guess + 1, guess - 1):  # the division may be off by one either way
        hit = hit | ((i >= 0) & (i < n) & (F.floor(i * step) == pos))
    return (n >= size) | hit


def sector_picks(universe: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pool with ``_picked`` marking each sector's evenly spaced share."""
    pool = _eligible(universe)
    totals = pool.agg(F.count("*").alias("_total"), F.countDistinct("_sector").alias("_sectors"))
    totals = totals.withColumn("_target", clamp_target(F.col("_total"), limits))
    df = with_row(_placed(pool, F.coalesce(F.col("market_cap"), F.lit(0.0))), totals)
    share = F.greatest(F.lit(1), F.bround(F.col("_size") / F.col("_total") * F.col("_target"), 0).cast("int"))
    spaced = evenly_spaced(F.col("_pos"), F.col("_size"), share)
    return df.withColumn("_picked", F.when(F.col("_sectors") <= 1, F.lit(False)).otherwise(spaced))


def representative(universe: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Sector shares, evenly spaced by market cap, trimmed or padded by hash."""
    return _trim_or_pad(sector_picks(universe, limits), hashed(limits.seed), limits, universe.columns)


def _trim_or_pad(df: DataFrame, order: Column, limits: Limits, columns: list[str]) -> DataFrame:
    """Cut a sample to its target, or fill it to the minimum, in ``order``.

    A top-n over (picked first, order): too many picks lose their tail, too few
    are followed by others.
    """
    count = df.agg(F.count_if("_picked").alias("_n"), F.first("_sectors").alias("_k"), F.first("_target").alias("_t"), F.first("_total").alias("_all"))
    single = (F.col("_k") <= 1).alias("_single")
    wanted = (
        F.when(F.col("_k") <= 1, F.col("_t"))
        .when(F.col("_n") > F.col("_t"), F.col("_t"))
        .when((F.col("_n") < limits.min_symbols) & (F.col("_all") >= limits.min_symbols), F.lit(limits.min_symbols))
        .otherwise(F.col("_n"))
        .alias("_wanted")
    )
    top = df.withColumn("_order", order).orderBy(F.col("_picked").desc(), "_order", "symbol").limit(
        max(limits.max_symbols, limits.min_symbols)
    )
    w = Window.orderBy(F.col("_picked").desc(), "_order", "symbol")  # at most max_symbols rows
    ranked = with_row(top.withColumn("symbol_rank", F.row_number().over(w)), count.select(single, wanted))
    return ranked.where(F.col("symbol_rank") <= F.col("_wanted")).select(*columns, "symbol_rank")


def fit_score(category: str, regime: str, preferred: tuple[str, ...] = ()) -> Column:
    """How well a stock suits the regime, for a strategy category."""
    target = REGIME_LOG_CAP[regime] + CATEGORY_CAP_BIAS.get(category, 0.0)
    cap = F.col("market_cap")
    near = F.greatest(F.lit(0.0), 1 - F.abs(F.log10(cap) - target) / 1.5)
    score = F.when(cap > 0, near).otherwise(0.5)
    score = score + F.when(F.coalesce(F.col("sector"), F.lit("")) != "", 0.15).otherwise(0.0)
    bonus = 0.0
    if preferred:
        bonus += 0.2 if regime in preferred else -0.1
    if category in ("trend", "rotation"):
        bonus += 0.2 if regime in BULLISH else -0.05 if regime in STRESS else 0.0
    if category in ("reversal", "event"):
        bonus += 0.2 if regime in CALM_OR_STRESSED else 0.0
        bonus -= 0.1 if regime == "euphoria" else 0.0
    return F.when(F.coalesce(F.col("is_st"), F.lit(False)), -10.0).otherwise(score + bonus)


def sector_weights(universe: DataFrame, fit: Column) -> DataFrame:
    pool = _eligible(universe).withColumn("fit", fit)
    per = pool.groupBy("_sector").agg(F.count("*").alias("n"), F.avg("fit").alias("avg_fit"))
    bonus = F.when(F.col("_sector") != UNKNOWN, 0.15).otherwise(0.0)
    weight = F.greatest(F.lit(0.1), F.col("n") * (F.col("avg_fit") + 1 + bonus))
    return per.select("_sector", weight.alias("weight"))


def regime_fit(universe: DataFrame, fit: Column, limits: Limits = Limits()) -> DataFrame:
    """Sector quotas by fit weight, best fits first, trimmed or padded by fit."""
    pool = _eligible(universe).withColumn("fit", fit)
    totals = pool.agg(F.count("*").alias("_total")).withColumn("_target", clamp_target(F.col("_total"), limits))
    weights = sector_weights(universe, fit)
    whole = weights.agg(F.sum("weight").alias("_all_weight"))
    df = with_row(with_row(_placed(pool, F.col("fit")).join(weights, "_sector"), totals), whole)
    quota = F.greatest(F.lit(1), F.bround(F.col("weight") / F.col("_all_weight") * F.col("_target"), 0).cast("int"))
    df = df.withColumns({"_picked": F.col("_pos") < quota, "_sectors": F.lit(2)})
    return _trim_or_pad(df, -F.col("fit"), limits, [*universe.columns, "fit"])


def strategy_scoped(
    universe: DataFrame,
    filters: list[tuple[str, str, object]],
    *,
    fit: Column | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    filtered = apply_filters(universe, filters)
    return representative(filtered, limits) if fit is None else regime_fit(filtered, fit, limits)


# ── expansion ────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Ladder:
    """How a sample grows while signals are too few: more symbols, earlier days, another order."""

    steps: int = 3
    symbols: int = 30
    more_symbols: int = 20
    more_days: int = 180
    signals: int = 30

    def size(self, step: int) -> int:
        return max(1, self.symbols) + step * max(1, self.more_symbols)


def spread_order(universe: DataFrame) -> DataFrame:
    """The pool with ``spread``: a place between 0 and 1 that mixes the sectors in proportion, large caps first."""
    placed = _placed(_eligible(universe), F.coalesce(F.col("market_cap"), F.lit(0.0)))
    return placed.withColumn("spread", (F.col("_pos") + 0.5) / F.col("_size"))


def admitted(pool: DataFrame, orders: list[Column], ladder: Ladder) -> DataFrame:
    """(symbol, step): the first step whose sample holds each symbol.

    ``orders`` gives the order of each step, the last one for all further
    steps.  A later sample keeps what an earlier one had, so the samples are
    nested and one number says in which of them a symbol is.
    """
    by_order: dict[int, list[int]] = {}
    for step in range(ladder.steps + 1):
        by_order.setdefault(min(step, len(orders) - 1), []).append(step)
    parts = []
    for which, steps in by_order.items():
        # the first steps share an order where the same column is given again
        ordered = pool.select("symbol", orders[which].alias("_o")).orderBy("_o", "symbol").limit(ladder.size(steps[-1]))
        rank = F.row_number().over(Window.orderBy("_o", "symbol"))  # at most the size of the largest sample
        first = F.lit(None).cast("int")
        for step in reversed(steps):
            first = F.when(F.col("_rank") <= ladder.size(step), step).otherwise(first)
        parts.append(ordered.withColumn("_rank", rank).select("symbol", first.alias("step")))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined.groupBy("symbol").agg(F.min("step").alias("step"))


def expand(pool: DataFrame, signals: DataFrame, orders: list[Column], start: date, end: date, ladder: Ladder = Ladder()) -> DataFrame:
    """One row per step of the ladder, the first sufficient one marked as ``chosen``, the last one where none is.

    ``signals`` (symbol, signal_date) are those of all symbols and days at once.
    Every signal carries the first step that admits both its symbol and its
    day, so one count per step, summed up along the ladder, answers all tries.
    """
    symbols = stage(admitted(pool, orders, ladder))
    before = F.datediff(F.lit(start), F.col("signal_date"))
    day_step = F.greatest(F.lit(0), F.ceil(before / ladder.more_days)).cast("int")
    seen = (
        signals.where(F.col("signal_date") <= F.lit(end))
        .select("symbol", day_step.alias("day_step"))
        .where(F.col("day_step") <= ladder.steps)
        .join(symbols, "symbol")
        .groupBy(F.greatest("step", "day_step").alias("step"))
        .agg(F.count("*").alias("signals"))
    )
    new = symbols.groupBy("step").agg(F.count("*").alias("symbols"))
    plan = [(k, ladder.size(k), start - timedelta(days=k * max(1, ladder.more_days))) for k in range(ladder.steps + 1)]
    rungs = pool.sparkSession.createDataFrame(plan, "step int, max_symbols int, start_date date")
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    counted = rungs.join(new, "step", "left").join(seen, "step", "left").fillna(0, ["symbols", "signals"])
    summed = counted.select(
        "step", "max_symbols", "start_date", F.sum("symbols").over(upto).alias("symbols"), F.sum("signals").over(upto).alias("signals")
    ).withColumn("reached", F.col("signals") >= ladder.signals)
    first = F.min(F.when(F.col("reached"), F.col("step"))).over(Window.partitionBy())
    return summed.withColumn("chosen", F.col("step") == F.coalesce(first, F.lit(ladder.steps)))


def expanded_sample(pool: DataFrame, ladder_rows: DataFrame, orders: list[Column], ladder: Ladder = Ladder()) -> DataFrame:
    """(symbol, step) of the symbols in the chosen sample."""
    chosen = ladder_rows.where("chosen").agg(F.max("step").alias("_chosen"))
    return with_row(admitted(pool, orders, ladder), chosen).where(F.col("step") <= F.col("_chosen")).select("symbol", "step")
