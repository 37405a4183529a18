"""Many exits of one or more entries in one pass over the bars ahead.

Every entry looks at the bars ahead once.  Of their lows only the ones below
all before matter to a stop: a staircase of records with their bars, falling
by construction, in which the first bar at or below any level is the first
record at or below it.  Targets use the staircase of highs, stops below a
running peak one of falls from it.  So each distinct stop, target and trigger
of a grid is answered from a handful of records, and a candidate (a choice of
stop, target, trigger and holding limit) only compares the bars that its three
parts name.  The signals of a symbol stay in one row, in which every candidate
takes one position at a time: a signal it passes by costs it a comparison, and
neither signals nor passed exits are multiplied by the candidates.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.indicators import with_indicators
from tapeloom.functions.spec import Exit, Stop, Strategy, Target, group_column, sell_allowed
from tapeloom.operators.trades import Costs, _entry_fill, _window, entry_flag

#: Candidates whose trades in one symbol are made at a time.
SOME = 64

#: References of a price-level stop that are known at the entry.
ENTRY_REFERENCES = ("entry", "entry_price", "signal_low", "entry_low", "signal_close", "entry_close")


def covers(ex: Exit) -> bool:
    """Whether staircases answer all rules of an exit: levels known at the entry, or trailing a peak."""
    st, tp = ex.stop, ex.target
    stop = (st.type in ("pct", "pct_from_low") and st.value is not None) or (
        st.type == "price_level" and (st.value is not None or (st.reference or "").strip() in ENTRY_REFERENCES)
    )
    goal = (tp.type in ("pct", "rr") and tp.value is not None) or tp.type == "trailing"
    return stop and goal and not isinstance(ex.max_holding_days, Column)


@dataclass(frozen=True)
class _Parts:
    """The distinct parts of a grid and each candidate's choice of them."""

    entries: list[Strategy]
    stops: list[Stop]
    goals: list[tuple[Stop | None, Target]]
    triggers: list[tuple]
    chosen: list[tuple[str, int, int, int, int, int]]

    @classmethod
    def of(cls, members: Sequence) -> _Parts:
        entries: dict[tuple, int] = {}
        strategies: list[Strategy] = []
        stops: dict[Stop, int] = {}
        goals: dict[tuple, int] = {}
        triggers: dict[tuple, int] = {}
        chosen = []
        for c in members:
            ex: Exit = c.strategy.exit
            key = (c.strategy.entry, c.strategy.preferred_regimes)
            if key not in entries:
                entries[key] = len(entries)
                strategies.append(c.strategy)
            # only a target in multiples of the risk depends on the stop
            goal = (ex.stop if ex.target.type == "rr" else None, ex.target)
            chosen.append(
                (
                    c.id,
                    entries[key],
                    stops.setdefault(ex.stop, len(stops)),
                    goals.setdefault(goal, len(goals)),
                    triggers.setdefault(ex.triggers, len(triggers)),
                    int(ex.max_holding_days),
                )
            )
        return cls(strategies, list(stops), list(goals), list(triggers), chosen)


def _stop_level(st: Stop) -> Column:
    price, at = F.col("entry_price"), F.col("_at")
    ref = (st.reference or "").strip()
    if st.type == "pct":
        return price * (1 - float(st.value))  # type: ignore[arg-type]
    if st.value is not None:
        return F.lit(float(st.value))  # type: ignore[arg-type]
    return {"signal_low": at["low"], "entry_low": at["low"], "signal_close": at["close"], "entry_close": at["close"]}.get(ref, price)


def _goal_level(st: Stop | None, tp: Target) -> Column:
    price = F.col("entry_price")
    if tp.type == "pct" or st is None:
        return price * (1 + float(tp.value))  # type: ignore[arg-type]
    risk = F.abs(price * float(st.value)) if st.type in ("pct", "pct_from_low") and st.value is not None else price * 0.05  # type: ignore[arg-type]
    return price + risk * float(tp.value)  # type: ignore[arg-type]


def _records(parts: _Parts, timing: str) -> Column:
    """Staircases of the bars ahead, built in one walk; ``k`` counts bars from 1."""
    falls = any(s.type == "pct_from_low" for s in parts.stops)
    trails = any(t.type == "trailing" for _, t in parts.goals)
    none = F.lit(None).cast("double")
    step = "array<struct<k:int,v:double>>"
    start = {"low": none, "lows": F.array().cast(step), "high": none, "highs": F.array().cast(step)}
    if falls:
        start |= {"near": none, "fall": none, "falls": F.array().cast("array<struct<k:int,v:double,top:double>>")}
    if trails:
        start |= {"top": F.col("high") if timing == "close" else none, "path": F.array().cast("array<struct<k:int,ok:boolean,low:double,top:double>>")}

    def push(array: Column, when: Column, *fields: Column) -> Column:
        return F.when(when, F.concat(array, F.array(F.struct(*fields)))).otherwise(array)

    def walk(acc: Column, b: Column) -> Column:
        k, ok, low, high = b["k"], b["ok"], b["low"], b["high"]
        lower = ok & (acc["low"].isNull() | (low < acc["low"]))
        higher = ok & (acc["high"].isNull() | (high > acc["high"]))
        out = {
            "low": F.when(lower, low).otherwise(acc["low"]),
            "lows": push(acc["lows"], lower, k.alias("k"), low.alias("v")),
            "high": F.when(higher, high).otherwise(acc["high"]),
            "highs": push(acc["highs"], higher, k.alias("k"), high.alias("v")),
        }
        if falls:
            # the peak starts on the bar after the entry bar, on the entry bar itself while that is the last one seen
            near = F.greatest(acc["near"], high) if timing == "close" else F.when(k <= 2, high).otherwise(F.greatest(acc["near"], high))
            fall = F.when(near > 0, (low - near) / F.nullif(near, F.lit(0.0)))
            deeper = ok & fall.isNotNull() & (acc["fall"].isNull() | (fall < acc["fall"]))
            out |= {
                "near": near,
                "fall": F.when(deeper, fall).otherwise(acc["fall"]),
                "falls": push(acc["falls"], deeper, k.alias("k"), fall.alias("v"), near.alias("top")),
            }
        if trails:
            top = F.greatest(acc["top"], high)
            out |= {"top": top, "path": F.concat(acc["path"], F.array(F.struct(k.alias("k"), ok.alias("ok"), low.alias("low"), top.alias("top"))))}
        return F.struct(*[v.alias(n) for n, v in out.items()])

    return F.aggregate("_look", F.struct(*[v.alias(n) for n, v in start.items()]), walk)


def _first(records: Column, hit) -> Column:
    return F.get(F.filter(records, hit), F.lit(0))


def grid_trades(ready: DataFrame, members: Sequence, costs: Costs) -> DataFrame:
    """Executed trades of candidates with exits that :func:`covers` accepts, one position at a time.

    ``ready`` has all indicators.  The candidates' entries may differ in what
    they ask of a bar, not in timing, slippage or market rules.  The bars of a
    symbol, at most one per calendar day, stay in one row: every candidate
    walks its flagged bars there, and only the trades it takes become rows.
    """
    first: Strategy = members[0].strategy
    rules, timing = first.market_rules, first.entry.timing
    parts = _Parts.of(members)
    ahead = 0 if timing == "close" else 1
    horizon = max(c[5] for c in parts.chosen) + ahead
    df = with_indicators(ready, [], keep_index=True)
    kept = [c for c in ("regime", "sector") if c in df.columns]
    df = df.withColumn("_bars", F.count("*").over(Window.partitionBy("symbol")))
    flags = [F.coalesce(entry_flag(s, costs, df.columns), F.lit(False)) for s in parts.entries]
    df = df.withColumn("_in", F.array(*flags)).withColumn("entry", F.array_contains("_in", True))
    df = df.withColumn("_sell", sell_allowed(rules, df.columns))
    place = F.struct("idx", "date", "close")
    own = Window.partitionBy("symbol")
    gated = rules.limit_up_down or rules.suspension
    next_sell = (
        F.last(F.when(F.col("_sell"), place), ignorenulls=True).over(own.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0))
        if gated
        else place
    )
    df = df.withColumn("_next_sell", next_sell)
    fired = [group_column(t, "or") if t else F.lit(False) for t in parts.triggers]
    bar = F.struct("high", "low", F.col("_sell").alias("sell"), F.array(*[F.coalesce(f, F.lit(False)) for f in fired]).alias("fired"))
    df = _entry_fill(df.withColumn("_bar", bar), first, costs)
    df = df.withColumn("_ahead", F.collect_list("_bar").over(_window().rowsBetween(1, horizon)))

    s, at, price = F.col("idx"), F.col("_at"), F.col("entry_price")

    def numbered(b: Column, i: Column) -> Column:
        k = (i + 1).cast("int")
        ok = b["sell"] if gated else F.lit(True)
        if rules.t_plus_1:
            ok = ok & (s + k > at["idx"])
        return F.struct(k.alias("k"), ok.alias("ok"), b["high"].alias("high"), b["low"].alias("low"), b["fired"].alias("fired"))

    # bars that no candidate enters on are asked for nothing
    df = df.withColumn("_look", F.when(F.col("entry"), F.transform("_ahead", numbered)))
    df = df.withColumn("_r", F.when(F.col("entry"), _records(parts, timing)))
    found = F.col("_r")

    def stopped(st: Stop) -> Column:
        if st.type == "pct_from_low":
            v = float(st.value)  # type: ignore[arg-type]
            hit = _first(found["falls"], lambda r: r["v"] <= -v)
            return F.struct(hit["k"].alias("k"), (hit["top"] * (1 - v)).alias("price"))
        level = _stop_level(st)
        return F.struct(_first(found["lows"], lambda r: r["v"] <= level)["k"].alias("k"), level.alias("price"))

    def reached(st: Stop | None, tp: Target) -> Column:
        if tp.type == "trailing":
            arm, trail = float(tp.trigger_pct or 0.08), float(tp.trail_pct or 0.04)  # type: ignore[arg-type]
            hit = _first(found["path"], lambda r: r["ok"] & ((r["top"] - price) / price >= arm) & ((r["top"] - r["low"]) / r["top"] >= trail))
            return F.struct(hit["k"].alias("k"), (hit["top"] * (1 - trail)).alias("price"))
        level = _goal_level(st, tp)
        return F.struct(_first(found["highs"], lambda r: r["v"] >= level)["k"].alias("k"), level.alias("price"))

    def called(i: int) -> Column:
        return _first(F.col("_look"), lambda b: b["ok"] & F.get(b["fired"], F.lit(i)))["k"]

    signal = F.struct(
        s.alias("idx"), F.col("date").alias("day"), at["idx"].alias("at"), at["date"].alias("at_day"), price.alias("price"), "_in", *kept,
        F.array(*[stopped(x) for x in parts.stops]).alias("stops"),
        F.array(*[reached(*x) for x in parts.goals]).alias("goals"),
        F.array(*[called(i) if t else F.lit(None).cast("int") for i, t in enumerate(parts.triggers)]).alias("calls"),
    )
    # of a bar others only need its close and the bar that sells it; where every bar can be sold on, that is itself
    seen = F.struct("idx", "date", "close", *([F.col("_next_sell").alias("next_sell")] if gated else []))
    df = df.select("symbol", seen.alias("_b"), F.when(F.col("entry"), signal).alias("_f"))
    df = df.groupBy("symbol").agg(F.collect_list("_b").alias("_b"), F.collect_list("_f").alias("_f")).where(F.size("_f") > 0)
    df = df.select("symbol", F.sort_array("_b").alias("_b"), F.sort_array("_f").alias("_f"))
    return _taken(df, parts, costs, first, gated, kept)


def _taken(df: DataFrame, parts: _Parts, costs: Costs, first: Strategy, gated: bool, kept: list[str]) -> DataFrame:
    """Trades of every candidate from a symbol's bars ``_b`` and signals ``_f``, both in bar order."""
    rows = [dict(zip(("id", "entry", "stop", "goal", "call", "hold"), c, strict=True)) for c in parts.chosen]
    # one literal, however many candidates there are; some at a time, so that a row holds the trades of a few
    some = [rows[i : i + SOME] for i in range(0, len(rows), SOME)]
    table = F.from_json(F.lit(json.dumps(some)), "array<array<struct<id:string,entry:int,stop:int,goal:int,call:int,hold:int>>>")
    df = df.withColumn("_cs", F.explode(table))
    bars, signals = F.col("_b"), F.col("_f")

    def place(b: Column) -> Column:
        return b["next_sell"] if gated else F.struct(b["idx"], b["date"], b["close"])

    def final(f: Column, reach: Column) -> Column:
        last = F.get(bars, F.size(bars) - 1)
        held = F.get(bars, F.when(reach >= 0, f["idx"] + reach + 1))
        return F.coalesce(F.when(held.isNotNull(), place(held)), F.struct(last["idx"], last["date"], last["close"]))

    def bound(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def exit_step(f: Column, c: Column) -> Column:
        k = F.least(F.get(f["stops"], c["stop"])["k"], F.get(f["goals"], c["goal"])["k"], F.get(f["calls"], c["call"]))
        return F.struct(k.alias("k"), (f["at"] - f["idx"] + c["hold"] - 1).alias("reach"))

    def walked(c: Column) -> Column:
        start = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("kept"))

        def step(acc: Column, f: Column) -> Column:
            def opened(x: Column) -> Column:
                out = F.when(x["k"] <= x["reach"], f["idx"] + x["k"]).otherwise(final(f, x["reach"])["idx"])
                return F.struct(out.cast("int").alias("until"), (acc["at"] + 1).alias("at"), F.concat(acc["kept"], F.array(acc["at"])).alias("kept"))

            passed = F.struct(acc["until"].alias("until"), (acc["at"] + 1).alias("at"), acc["kept"].alias("kept"))
            return F.when((f["idx"] > acc["until"]) & F.get(f["_in"], c["entry"]), bound(exit_step(f, c), opened)).otherwise(passed)

        return F.aggregate(signals, start, step, lambda acc: acc["kept"])

    def trade(c: Column, f: Column) -> Column:
        def made(x: Column) -> Column:
            return F.struct(
                c["id"].alias("candidate_id"), f["idx"].alias("signal_idx"), f["at"].alias("entry_idx"), f["day"].alias("signal_bar_date"), f["at_day"].alias("signal_date"),
                f["price"].alias("entry_price"), *[f[n].alias(n) for n in kept],
                x["k"].alias("_k"), F.get(f["stops"], c["stop"]).alias("_s"), F.get(f["goals"], c["goal"]).alias("_g"),
                F.when(x["k"] <= x["reach"], F.get(bars, f["idx"] + x["k"])).alias("_hit"), final(f, x["reach"]).alias("_final"),
            )

        return bound(exit_step(f, c), made)

    def trades(c: Column) -> Column:
        return F.transform(walked(c), lambda i: bound(F.get(signals, i), lambda f: trade(c, f)))

    df = df.select("symbol", F.inline(F.flatten(F.transform("_cs", trades))))
    price, hit, k, last = F.col("entry_price"), F.col("_hit"), F.col("_k"), F.col("_final")
    by_stop, by_goal = F.coalesce(F.col("_s.k") == k, F.lit(False)), F.coalesce(F.col("_g.k") == k, F.lit(False))
    prefer = {"optimistic": F.lit(True), "close_first": hit["close"] >= price}.get(costs.policy, F.lit(False))
    take = by_goal & (~by_stop | prefer)
    missed = hit.isNull()
    slip = costs.slippage if first.entry.slippage is None else first.entry.slippage
    df = df.withColumns(
        {
            "_reason": F.when(missed, "max_hold").when(take, "take_profit").when(by_stop, "stop_loss").otherwise("signal"),
            "_raw": F.when(missed, last["close"]).when(take, F.col("_g.price")).when(by_stop, F.col("_s.price")).otherwise(hit["close"]),
            "_out": F.when(missed, last["idx"]).otherwise(F.col("signal_idx") + k),
            "_day": F.when(missed, last["date"]).otherwise(hit["date"]),
        }
    )
    exit_price = F.col("_raw") * (1 - slip)
    paid, got = price * (1 + costs.commission), exit_price * (1 - costs.commission)
    return df.select(
        "candidate_id", "symbol", "signal_idx", "entry_idx", F.col("_out").alias("exit_idx"), "signal_bar_date", "signal_date",
        F.lit("long").alias("direction"), "entry_price", exit_price.alias("exit_price"), F.col("_day").alias("exit_date"),
        F.col("_reason").alias("exit_reason"), F.round((got - paid) / paid, 6).alias("return_pct"),
        (F.col("_out") - F.col("entry_idx")).alias("holding_days"), *kept,
    )
