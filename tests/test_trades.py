"""The trade operator against a plain row-by-row loop written for the test."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
import pytest

from market import market
from tapeloom.functions.spec import Condition, Entry, Exit, MarketRules, Stop, Strategy, Target
from tapeloom.operators import sweep
from tapeloom.operators.trades import Costs, trades

ENTRY = Entry(conditions=(Condition("momentum_3d", ">", 0.0),))


def loop(pdf: pd.DataFrame, s: Strategy, costs: Costs) -> list[tuple]:
    rules, ex, out = s.market_rules, s.exit, []
    for symbol, g in pdf.groupby("symbol"):
        o, h, lo, c, v = (g[k].tolist() for k in ("open", "high", "low", "close", "volume"))
        n, held = len(g), None
        tr = [h[0] - lo[0]] + [max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, n)]
        atr = [tr[i] if i < 14 else sum(tr[i - 13 : i + 1]) / 14 for i in range(n)]
        move = [0.0] + [(c[i] - c[i - 1]) / c[i - 1] for i in range(1, n)]

        def close_at(i, price, why):
            sold = price * (1 - costs.slippage)
            paid, got = held[1] * (1 + costs.commission), sold * (1 - costs.commission)
            out.append((symbol, held[2], held[0], i, why, round((got - paid) / paid, 6)))

        for i in range(30, n):
            halted = rules.suspension and v[i] == 0
            if held is not None:
                e, p, _ = held
                if (rules.t_plus_1 and i <= e) or halted or (rules.limit_up_down and move[i] <= -0.098):
                    continue
                if i - e >= ex.max_holding_days:
                    close_at(i, c[i], "max_hold")
                    held = None
                    continue
                stop = goal = None
                if ex.stop.type == "pct" and lo[i] <= p * (1 - ex.stop.value):
                    stop = p * (1 - ex.stop.value)
                if ex.stop.type == "atr" and lo[i] <= p - atr[i] * ex.stop.multiplier:
                    stop = p - atr[i] * ex.stop.multiplier
                if ex.stop.type == "pct_from_low":
                    top = max(h[min(e + 1, i) : i + 1])
                    if (lo[i] - top) / top <= -ex.stop.value:
                        stop = top * (1 - ex.stop.value)
                if ex.target.type == "pct" and h[i] >= p * (1 + ex.target.value):
                    goal = p * (1 + ex.target.value)
                if ex.target.type == "rr":
                    risk = atr[i] * ex.stop.multiplier if ex.stop.type == "atr" else p * ex.stop.value
                    if h[i] >= p + risk * ex.target.value:
                        goal = p + risk * ex.target.value
                if ex.target.type == "trailing":
                    top = max(h[e : i + 1])
                    if (top - p) / p >= ex.target.trigger_pct and (top - lo[i]) / top >= ex.target.trail_pct:
                        goal = top * (1 - ex.target.trail_pct)
                use_goal = goal is not None and (
                    stop is None
                    or costs.policy == "optimistic"
                    or (costs.policy == "close_first" and c[i] >= p)
                )
                if use_goal or stop is not None:
                    close_at(i, goal if use_goal else stop, "take_profit" if use_goal else "stop_loss")
                    held = None
                continue
            if halted or (rules.limit_up_down and move[i] >= 0.098):
                continue
            if (c[i] - c[i - 3]) / c[i - 3] > 0.0:
                if s.entry.timing == "close":
                    e, raw = i, c[i]
                elif s.entry.timing == "breakout_high":
                    if i + 1 >= n or o[i + 1] < h[i]:
                        continue
                    e, raw = i + 1, o[i + 1]
                else:
                    e = min(i + 1, n - 1)
                    raw = o[e]
                held = (e, raw * (1 + costs.slippage), i)
        if held is not None:
            close_at(n - 1, c[-1], "max_hold")
    return sorted(out)


def run(spark, pdf, s, costs=Costs()):
    rows = trades(spark.createDataFrame(pdf), s, costs).collect()
    return sorted(
        (r.symbol, r.signal_idx, r.entry_idx, r.exit_idx, r.exit_reason, round(r.return_pct, 6)) for r in rows
    )


def spec(stop=Stop("pct", 0.04), target=Target("rr", 1.5), hold=6, **options) -> Strategy:
    return Strategy("s", ENTRY, Exit(stop, target, hold), **options)


CASES = {
    "pct": (spec(), {}, Costs()),
    "atr": (spec(Stop("atr", multiplier=1.2)), {}, Costs()),
    "trailing_stop": (spec(Stop("pct_from_low", 0.05), Target("pct", 0.08)), {}, Costs()),
    "trailing_target": (spec(target=Target("trailing", trigger_pct=0.03, trail_pct=0.02)), {}, Costs()),
    "close_entry": (replace(spec(), entry=replace(ENTRY, timing="close")), {}, Costs()),
    "close_entry_trailing": (
        replace(spec(target=Target("trailing", trigger_pct=0.03, trail_pct=0.02)), entry=replace(ENTRY, timing="close")),
        {},
        Costs(),
    ),
    "breakout": (replace(spec(), entry=replace(ENTRY, timing="breakout_high")), {}, Costs()),
    "optimistic": (spec(Stop("pct", 0.01), Target("pct", 0.01)), {}, Costs(fill_policy="tp_first")),
    "close_first": (spec(Stop("pct", 0.01), Target("pct", 0.01)), {}, Costs(fill_policy="close_first")),
    "halts": (spec(market="us"), {"halts": True}, Costs()),
    "blocked": (
        spec(rules=MarketRules(t_plus_1=True, limit_up_down=True, suspension=True), hold=2),
        {"halts": True, "vol": 0.07},
        Costs(),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_matches_row_loop(spark, name):
    s, options, costs = CASES[name]
    pdf = market(**options)
    got, want = run(spark, pdf, s, costs), loop(pdf, s, costs)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 2e-6 for g, w in zip(got, want))
    assert len(want) > 10


def test_one_position_at_a_time(spark):
    rows = run(spark, market(), spec())
    for (sym, sig, *_), (before, _, _, out, *_) in zip(rows[1:], rows):
        assert sym != before or sig > out


def test_unknown_indicator_is_an_error(spark):
    bad = replace(spec(), entry=Entry(conditions=(Condition("nope_1", ">", 1),)))
    with pytest.raises(ValueError, match="nope_1"):
        trades(spark.createDataFrame(market()), bad)


def test_costs_are_validated():
    with pytest.raises(ValueError):
        Costs(slippage=0.5)
    with pytest.raises(ValueError):
        Costs(fill_policy="best")


def test_sweep_equals_single_runs(spark):
    """Candidates of different shapes give the trades each gives alone."""
    pdf = market(3, 120)
    plans = [
        sweep.Candidate("a", spec()),
        sweep.Candidate("b", spec(Stop("pct", 0.02), Target("rr", 3.0), 3)),
        sweep.Candidate("c", spec(target=Target("trailing", trigger_pct=0.04, trail_pct=0.02))),
        sweep.Candidate("d", replace(spec(), entry=Entry(conditions=(Condition("momentum_3d", ">", 0.04),)))),
    ]
    got = sweep.sweep_trades(spark.createDataFrame(pdf), plans).collect()
    for plan in plans:
        mine = sorted((r.symbol, r.signal_idx, r.exit_idx, r.exit_reason) for r in got if r.candidate_id == plan.id)
        alone = [(a, b, d, e) for a, b, _, d, e, _ in run(spark, pdf, plan.strategy)]
        assert mine == alone, plan.id


def test_grids():
    assert sweep.value_grid(10, 5, 20, 2, limit=8, integer=True) == [10, 8, 12, 5, 20, 6, 14]
    assert sweep.value_grid(10, 5, 20, 2, limit=3) == [10.0, 8.0, 12.0]
    assert sweep.value_grid(30, 5, 20, 2, limit=3) == []
    hold = sweep.Tunable(
        "exit.max_holding_days",
        2,
        10,
        2,
        lambda s: s.exit.max_holding_days,
        lambda s, v: replace(s, exit=replace(s.exit, max_holding_days=v)),
        integer=True,
    )
    plans = sweep.param_candidates(spec(), [hold], values=4, guards=True)
    assert plans[0].changes == ("baseline",)
    assert len(plans) == 1 + 3 + len(sweep.GUARD_CANDIDATES)
    exits = sweep.exit_candidates(spec(), ("stoploss", "holding"))
    assert len(exits) == 5 * 6  # four grid stops and 0.04, five grid holdings and 6: nothing repeats


@pytest.mark.parametrize(
    ("timing", "policy", "rules"),
    [
        ("next_open", "conservative", None),
        ("close", "optimistic", MarketRules()),
        ("breakout_high", "close_first", MarketRules(t_plus_1=True, limit_up_down=True, suspension=True)),
    ],
)
def test_exit_grid_equals_single_runs(spark, timing, policy, rules):
    """Staircases name the bars that a walk over every bar finds, whatever the stop, target and trigger."""
    pdf = market(2, 90, halts=True)
    stops = [Stop("pct", 0.03), Stop("pct_from_low", 0.04), Stop("price_level", reference="entry_low"), Stop("price_level", 98.0)]
    goals = [Target("rr", 1.5), Target("pct", 0.04), Target("trailing", trigger_pct=0.03, trail_pct=0.02)]
    triggers = [(), (Condition("close_below_ma5", "==", True),)]
    base = replace(spec(), rules=rules, entry=replace(spec().entry, timing=timing))
    plans = [
        sweep.Candidate(f"{i}-{j}-{k}-{hold}", replace(base, exit=Exit(stop, goal, hold, trigger)))
        for i, stop in enumerate(stops)
        for j, goal in enumerate(goals)
        for k, trigger in enumerate(triggers)
        for hold in (3, 8)
    ]
    costs = Costs(fill_policy=policy)
    bars = spark.createDataFrame(pdf)
    got = sweep.sweep_trades(bars, plans, costs).collect()
    for plan in plans[::5]:
        mine = sorted((r.symbol, r.signal_idx, r.exit_idx, r.exit_date, r.exit_reason, round(r.exit_price, 9)) for r in got if r.candidate_id == plan.id)
        alone = trades(bars, plan.strategy, costs).collect()
        assert mine == sorted((r.symbol, r.signal_idx, r.exit_idx, r.exit_date, r.exit_reason, round(r.exit_price, 9)) for r in alone), plan.id


def test_sweep_multiplies_no_signals(spark):
    """Signals are grouped once per symbol; candidates multiply taken trades only."""
    plans = sweep.exit_candidates(spec(), ("stoploss", "holding"))
    got = sweep.sweep_trades(spark.createDataFrame(market(2, 80)), plans)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in text.splitlines() if "Aggregate [" in line]
    assert grouped and not any("candidate_id" in line for line in grouped)


def test_entries_share_a_plan(spark):
    """Entries with moved exits are one plan, and each gives the trades it gives alone."""
    pdf = market(2, 150)
    hold = sweep.Tunable(
        "exit.max_holding_days", 2, 10, 2, lambda s: s.exit.max_holding_days, lambda s, v: replace(s, exit=replace(s.exit, max_holding_days=v)), integer=True
    )
    plans = sweep.param_candidates(spec(), [hold], values=3, max_changes=2, guards=True)
    got = sweep.sweep_trades(spark.createDataFrame(pdf), plans)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.collect()
    for plan in plans[::6]:
        mine = sorted((r.symbol, r.signal_idx, r.exit_idx, r.exit_reason) for r in rows if r.candidate_id == plan.id)
        assert mine == [(a, b, d, e) for a, b, _, d, e, _ in run(spark, pdf, plan.strategy)], plan.id
