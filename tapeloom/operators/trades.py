"""Trades from entry flags and exit rules, as table operations.

Every flagged bar gets the exit it would have, independently of all others: the
bars up to its holding limit travel with it in one bounded window array.  A
short fold per symbol then keeps the trades actually taken, one position at a
time.  All of it runs on a single partitioning by symbol.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.indicators import with_indicators
from tapeloom.functions.spec import (
    Condition,
    Exit,
    Strategy,
    buy_allowed,
    entry_column,
    group_column,
    regime_gate,
    sell_allowed,
    warmup_bars,
)

# Indicators added to every entry snapshot, and target averages.
SNAPSHOT_EXTRAS = ("rsi_14", "volume_ratio_1d_5d", "atr", "momentum_10d", "ma20_slope")
TARGET_AVERAGES = {"ma5": 5, "ma10": 10, "ma20": 20, "ma60": 60}

# Other names of the fill policies.
FILL_ALIASES = {
    "stop_first": "conservative",
    "take_profit_first": "optimistic",
    "tp_first": "optimistic",
}
FILL_POLICIES = ("conservative", "optimistic", "close_first")


@dataclass(frozen=True)
class Costs:
    slippage: float = 0.001
    commission: float = 0.0003
    min_data_days: int = 30
    fill_policy: str = "conservative"

    def __post_init__(self) -> None:
        for name in ("slippage", "commission"):
            if not 0 <= getattr(self, name) <= 0.1:
                raise ValueError(f"{name} must be in [0, 0.1]")
        if self.policy not in FILL_POLICIES:
            raise ValueError(f"fill_policy must be one of {', '.join((*FILL_POLICIES, *FILL_ALIASES))}")

    @property
    def policy(self) -> str:
        name = self.fill_policy.strip().lower()
        return FILL_ALIASES.get(name, name)


def value(v: object) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))  # type: ignore[arg-type]


def _window() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def _atr_name(ex: Exit) -> str:
    period = ex.stop.atr_period
    return f"atr_{period}" if period and period != 14 else "atr"


def entry_flags(
    bars: DataFrame,
    strategy: Strategy,
    costs: Costs = Costs(),
    *,
    flag: Column | None = None,
    extra: list[str] | None = None,
) -> DataFrame:
    """Bars with indicators, bar number and the ``entry`` flag of the strategy.

    Symbols with less than the minimum history are dropped; warm-up bars never
    signal.  A strategy with preferred regimes needs a column ``regime``.
    """
    names = [*strategy.indicators, *(extra or [])]
    df = with_indicators(bars, list(dict.fromkeys(names)), keep_index=True)
    df = df.withColumn("_bars", F.count("*").over(Window.partitionBy("symbol")))
    return df.withColumn("entry", entry_flag(strategy, costs, df.columns, flag))


def entry_flag(strategy: Strategy, costs: Costs, columns: list[str], flag: Column | None = None) -> Column:
    """Whether a bar with indicators, ``idx`` and the symbol's number of bars ``_bars`` signals."""
    first = max(costs.min_data_days, warmup_bars(strategy.indicators))
    ok = (F.col("idx") >= first) & (F.col("_bars") >= costs.min_data_days)
    ok = ok & buy_allowed(strategy.market_rules, columns)
    if strategy.preferred_regimes:
        if "regime" not in columns:
            raise ValueError("preferred regimes need a column regime")
        ok = ok & regime_gate(strategy.preferred_regimes, F.col("regime"))
    return ok & (entry_column(strategy.entry) if flag is None else flag)


def _bar_struct(df: DataFrame, strategy: Strategy) -> DataFrame:
    """Per-bar facts an exit rule can ask for, packed for the look-ahead."""
    ex, rules = strategy.exit, strategy.market_rules
    w = _window()
    ahead = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    df = df.withColumn("_sell", sell_allowed(rules, df.columns))
    place = F.struct("idx", "date", "close")
    df = df.withColumn(
        "_next_sell",
        F.last(F.when(F.col("_sell"), place), ignorenulls=True).over(
            ahead.rowsBetween(Window.unboundedPreceding, 0)
        )
        if rules.limit_up_down or rules.suspension
        else place,
    )
    df = df.withColumn("_last", F.max_by(place, "idx").over(Window.partitionBy("symbol")))
    fields = ["idx", "date", "high", "low", "close"]
    items = [*fields, F.col("_sell").alias("sell"), F.col("_next_sell").alias("next_sell")]
    if ex.stop.type == "atr":
        items.append(F.col(_atr_name(ex)).alias("atr"))
    if ex.stop.type == "composite":
        items.append(group_column(ex.stop.conditions, "or").alias("stop_signal"))
    if ex.stop.type == "price_level" and ex.stop.value is None and ex.stop.reference in df.columns:
        items.append(F.col(ex.stop.reference).cast("double").alias("level"))
    if ex.target.type == "target_ma":
        period = TARGET_AVERAGES.get((ex.target.target or "").lower().strip())
        if period is None:
            df = df.withColumn("_goal", F.lit(None).cast("double"))
        else:
            mean = F.avg("close").over(w.rowsBetween(1 - period, 0))
            df = df.withColumn("_goal", F.when(F.col("idx") + 1 >= period, mean))
        items.append(F.col("_goal").alias("goal"))
    if ex.triggers:
        items.append(group_column(ex.triggers, "or").alias("trigger"))
    return df.withColumn("_bar", F.struct(*items))


def _horizon(ex: Exit) -> int:
    if isinstance(ex.max_holding_days, Column):
        if ex.horizon is None:
            raise ValueError("horizon is required when max_holding_days is a column")
        return ex.horizon
    return int(ex.max_holding_days)  # type: ignore[call-overload]


def _entry_fill(df: DataFrame, strategy: Strategy, costs: Costs) -> DataFrame:
    """Entry bar, date and price of every bar seen as a signal bar."""
    w = _window()
    timing = strategy.entry.timing
    slip = costs.slippage if strategy.entry.slippage is None else strategy.entry.slippage
    here = F.struct("idx", "date", "open", "low", "close")
    df = df.withColumn("_here", here).withColumn("_next", F.lead(here, 1).over(w))
    if timing == "close":
        df = df.withColumn("_at", F.col("_here")).withColumn("_raw", F.col("close"))
    else:
        df = df.withColumn("_at", F.coalesce("_next", "_here")).withColumn("_raw", F.col("_at.open"))
    if timing == "breakout_high":
        df = df.withColumn("entry", F.col("entry") & F.coalesce(F.col("_next.open") >= F.col("high"), F.lit(False)))
    return df.withColumn("entry_price", F.col("_raw") * (1 + slip))


def _levels(df: DataFrame, strategy: Strategy) -> DataFrame:
    """Stop and target prices that do not depend on the bar looked at.

    They are plain columns, so the look-ahead only compares against them.
    """
    st, tp = strategy.exit.stop, strategy.exit.target
    at, price = F.col("_at"), F.col("entry_price")
    none = F.lit(None).cast("double")
    stop = none
    ref = (st.reference or "").strip()
    if st.type == "pct" and st.value is not None:
        stop = price * (1 - value(st.value))
    elif st.type == "price_level" and st.value is not None:
        stop = value(st.value)
    elif st.type == "price_level" and ref in ("entry", "entry_price"):
        stop = price
    elif st.type == "price_level" and ref in ("signal_low", "entry_low"):
        stop = at["low"]
    elif st.type == "price_level" and ref in ("signal_close", "entry_close"):
        stop = at["close"]
    risk = price * 0.05
    if st.type in ("pct", "pct_from_low") and st.value is not None:
        risk = F.abs(price * value(st.value))
    goal = none
    if tp.type == "pct" and tp.value is not None:
        goal = price * (1 + value(tp.value))
    elif tp.type == "rr" and tp.value is not None and st.type != "atr":
        goal = price + risk * value(tp.value)
    return df.withColumns({"_stop_at": stop, "_goal_at": goal})


def _rules(strategy: Strategy, columns: list[str]):
    """Stop and target of one look-ahead bar ``b``: (hit, price) for each, or None."""
    ex = strategy.exit
    st, tp = ex.stop, ex.target
    look, s, at, price = F.col("_look"), F.col("idx"), F.col("_at"), F.col("entry_price")

    def peak(b: Column, first: Column) -> Column:
        highs = F.slice(F.transform(look, lambda x: x["high"]), first - s, b["idx"] - first + 1)
        return F.array_max(highs)

    def stop(b: Column) -> tuple[Column, Column] | None:
        ref = (st.reference or "").strip()
        if st.type == "atr":
            level = price - b["atr"] * value(st.multiplier or 2.0)
            return b["low"] <= level, level
        if st.type == "pct_from_low" and st.value is not None:
            top = peak(b, F.least(at["idx"] + 1, b["idx"]))
            fall = (b["low"] - top) / F.nullif(top, F.lit(0.0))
            return (top > 0) & (fall <= -value(st.value)), top * (1 - value(st.value))
        if st.type == "composite" and st.conditions:
            return b["stop_signal"], b["close"]
        fixed = ("entry", "entry_price", "signal_low", "entry_low", "signal_close", "entry_close")
        if st.type == "price_level" and st.value is None and ref not in fixed:
            return (b["low"] <= b["level"], b["level"]) if ref and ref in columns else None
        if st.type == "price_level" or (st.type == "pct" and st.value is not None):
            return b["low"] <= F.col("_stop_at"), F.col("_stop_at")
        return None

    def target(b: Column) -> tuple[Column, Column] | None:
        if tp.type == "rr" and tp.value is not None and st.type == "atr":
            goal = price + b["atr"] * value(st.multiplier or 2.0) * value(tp.value)
            return b["high"] >= goal, goal
        if tp.type in ("rr", "pct") and tp.value is not None:
            return b["high"] >= F.col("_goal_at"), F.col("_goal_at")
        if tp.type == "target_ma" and tp.target:
            return b["high"] >= b["goal"], b["goal"]
        if tp.type == "trailing":
            arm, trail = value(tp.trigger_pct or 0.08), value(tp.trail_pct or 0.04)
            top = peak(b, F.greatest(at["idx"], s + 1))
            if strategy.entry.timing == "close":
                top = F.greatest(top, F.col("high"))
            armed = (top - price) / price >= arm
            return armed & ((top - b["low"]) / top >= trail), top * (1 - trail)
        return None

    return stop, target


def candidate_exits(flags: DataFrame, strategy: Strategy, costs: Costs, candidates: Column | None = None) -> DataFrame:
    """The exit each flagged bar would have, one row per (candidate and) bar."""
    ex, rules, policy = strategy.exit, strategy.market_rules, costs.policy
    df = _entry_fill(_bar_struct(flags, strategy), strategy, costs)
    ahead = 0 if strategy.entry.timing == "close" else 1
    frame = _window().rowsBetween(1, _horizon(ex) + ahead)
    df = df.withColumn("_look", F.collect_list("_bar").over(frame)).where(F.col("entry"))
    if candidates is not None:
        df = df.withColumn("_c", F.explode(candidates))
    df = _levels(df, strategy)

    look, s, at, price = F.col("_look"), F.col("idx"), F.col("_at"), F.col("entry_price")
    stop, target = _rules(strategy, flags.columns)
    limit = value(ex.max_holding_days).cast("int")

    def checked(b: Column) -> Column:
        fired = [rule[0] for rule in (stop(b), target(b)) if rule is not None]
        fired += [b["trigger"]] if ex.triggers else []
        hit = reduce(lambda x, y: x | y, fired) if fired else F.lit(False)
        if rules.limit_up_down or rules.suspension:
            hit = b["sell"] & hit
        return (b["idx"] > at["idx"]) & hit if rules.t_plus_1 else hit

    # bars that may stop a trade: from the next bar up to the holding limit
    in_reach = F.slice(look, F.lit(1), at["idx"] - s + limit - 1) if ahead else F.slice(look, F.lit(1), limit - 1)
    df = df.withColumn("_hit", F.get(F.filter(in_reach, checked), F.lit(0)))
    hit = F.col("_hit")
    nothing = (F.lit(False), F.lit(None).cast("double"))
    stopped, stop_price = stop(hit) or nothing
    reached, goal_price = target(hit) or nothing
    stopped, reached = F.coalesce(stopped, F.lit(False)), F.coalesce(reached, F.lit(False))
    if policy == "optimistic":
        prefer_target = F.lit(True)
    elif policy == "close_first":
        prefer_target = hit["close"] >= price
    else:
        prefer_target = F.lit(False)
    take = reached & (~stopped | prefer_target)
    held = F.get(look, at["idx"] - s + limit - 1)["next_sell"]
    final = F.coalesce(held, F.col("_last"))
    found = hit.isNotNull()
    df = df.withColumns(
        {
            "_reason": F.when(~found, "max_hold")
            .when(take, "take_profit")
            .when(stopped, "stop_loss")
            .otherwise("signal"),
            "_raw_exit": F.when(~found, final["close"])
            .when(take, goal_price)
            .when(stopped, stop_price)
            .otherwise(hit["close"]),
            "_exit_idx": F.when(found, hit["idx"]).otherwise(final["idx"]),
            "_exit_date": F.when(found, hit["date"]).otherwise(final["date"]),
        }
    )
    slip = costs.slippage if strategy.entry.slippage is None else strategy.entry.slippage
    exit_price = F.col("_raw_exit") * (1 - slip)
    paid, got = price * (1 + costs.commission), exit_price * (1 - costs.commission)
    kept = [c for c in ("regime", "sector") if c in flags.columns]
    snapshot = sorted({*[c.indicator for c in strategy.entry_conditions], *SNAPSHOT_EXTRAS} & set(flags.columns))
    return df.select(
        *([F.col("_c.candidate_id").alias("candidate_id")] if candidates is not None else []),
        "symbol",
        F.col("idx").alias("signal_idx"),
        F.col("_at.idx").alias("entry_idx"),
        F.col("_exit_idx").alias("exit_idx"),
        F.col("date").alias("signal_bar_date"),
        F.col("_at.date").alias("signal_date"),
        F.lit("long").alias("direction"),
        price.alias("entry_price"),
        exit_price.alias("exit_price"),
        F.col("_exit_date").alias("exit_date"),
        F.col("_reason").alias("exit_reason"),
        F.round((got - paid) / paid, 6).alias("return_pct"),
        (F.col("_exit_idx") - F.col("_at.idx")).alias("holding_days"),
        *kept,
        *(
            [
                F.map_from_arrays(
                    F.array(*[F.lit(n) for n in snapshot]),
                    F.array(*[F.round(F.col(n).cast("double"), 4) for n in snapshot]),
                ).alias("indicator_snapshot")
            ]
            if snapshot
            else []
        ),
    )


def one_position(exits: DataFrame, keys: list[str]) -> DataFrame:
    """Keep, per symbol, the trades that start after the previous one ended.

    The groups are the flagged bars of one symbol (and candidate), at most one
    per calendar day.
    """
    fields = [c for c in exits.columns if c not in keys]
    ordered = ["signal_idx", *[c for c in fields if c not in ("signal_idx", "indicator_snapshot")]]
    snap = ["indicator_snapshot"] if "indicator_snapshot" in fields else []
    grouped = exits.groupBy(*keys).agg(F.collect_list(F.struct(*ordered, *snap)).alias("_t"))
    # structs order by their first field; maps cannot be ordered, so they need a comparator
    by_start = (lambda a, b: F.when(a["signal_idx"] < b["signal_idx"], -1).otherwise(1)) if snap else None
    sorted_trades = F.array_sort("_t", by_start)
    # places of the kept trades in the sorted array
    start = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        after = acc["at"] + 1
        taken = F.struct(t["exit_idx"].cast("int").alias("until"), after.alias("at"), F.concat(acc["kept"], F.array(acc["at"])).alias("kept"))
        passed = F.struct(acc["until"].alias("until"), after.alias("at"), acc["kept"].alias("kept"))
        return F.when(t["signal_idx"] > acc["until"], taken).otherwise(passed)

    kept = F.aggregate(F.col("_s"), start, step, lambda acc: acc["kept"])
    return (
        grouped.select(*keys, sorted_trades.alias("_s"))
        .withColumn("_kept", kept)
        .select(*keys, F.inline(F.transform("_kept", lambda i: F.get(F.col("_s"), i))))
        .select(*exits.columns)
    )


def trades(
    bars: DataFrame,
    strategy: Strategy,
    costs: Costs = Costs(),
    *,
    snapshot: bool = False,
    window: tuple[object, object] | None = None,
) -> DataFrame:
    """Executed trades of a strategy over every symbol of a bar table."""
    extra = list(SNAPSHOT_EXTRAS) if snapshot else []
    if strategy.exit.stop.type == "atr":
        extra.append(_atr_name(strategy.exit))
    flags = entry_flags(bars, strategy, costs, extra=extra)
    exits = candidate_exits(flags, strategy, costs)
    if not snapshot and "indicator_snapshot" in exits.columns:
        exits = exits.drop("indicator_snapshot")
    taken = one_position(exits, ["symbol"]).withColumn("strategy_id", F.lit(strategy.id))
    if window is not None:
        taken = taken.where(F.col("signal_date").between(*window))
    return taken


def run_counts(taken: DataFrame) -> DataFrame:
    return taken.groupBy("strategy_id").agg(
        F.count("*").alias("total_signals"),
        F.count("exit_price").alias("executed_signals"),
        (F.count("*") - F.count("exit_price")).alias("skipped_signals"),
    )


__all__ = ["Condition", "Costs", "Strategy", "entry_flags", "one_position", "run_counts", "trades"]
