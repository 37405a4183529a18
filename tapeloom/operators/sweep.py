"""Many candidate strategies evaluated in one job.

Candidates that differ only in numbers share one plan: their numbers travel as a
short array of structs, and a bar emits only the candidates whose entry it
satisfies.  Indicators of all candidates are computed once and staged.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.indicators import with_indicators
from tapeloom.functions.spec import Condition, Exit, Stop, Strategy, Target, entry_column
from tapeloom.operators.exit_grid import covers, grid_trades
from tapeloom.operators.metrics import confidence_score, overall_metrics
from tapeloom.operators.robust import (
    cpcv,
    cpcv_paths,
    numbered,
    regime_holdout,
    regime_holdout_summary,
    split_gaps,
    walk_forward,
    walk_forward_summary,
)
from tapeloom.operators.trades import Costs, _atr_name, candidate_exits, entry_flags, one_position
from tapeloom.runtime import stage, with_row

# Grids of the exit search.
STOP_GRID = (0.02, 0.03, 0.05, 0.08)
RR_GRID = (0.8, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0)
TRAILING_GRID = ((0.04, 0.02), (0.06, 0.03), (0.08, 0.04), (0.10, 0.05))
HOLDING_GRID = (2, 3, 5, 10, 20)
TRIGGER_GRID = (
    (),
    (Condition("close_below_ma20", "==", True),),
    (Condition("close_below_ma10", "==", True),),
    (Condition("close_below_ma5", "==", True),),
    (Condition("rsi_14", ">", 75),),
)

# Entry guards that may be added.
GUARD_CANDIDATES = (
    Condition("ma20_slope", ">", 0),
    Condition("momentum_10d", ">", 0),
    Condition("relative_strength_20d", ">", 0),
    Condition("volume_ratio_1d_20d", ">=", 1.0),
    Condition("volatility_20d", "<=", 0.04),
    Condition("volatility_20d", "<=", 0.06),
    Condition("rsi_14", "<", 65),
    Condition("rsi_14_zscore", "<=", 1.5),
    Condition("price_position_120d", ">=", 0.65),
    Condition("price_position_52w", ">=", 0.5),
    Condition("bollinger_band_width_20d", "<=", 0.16),
    Condition("body_to_range_ratio", ">=", 0.35),
    Condition("gap_up_pct", "<=", 0.04),
    Condition("days_since_high_20d", "<=", 10),
)


@dataclass(frozen=True)
class Candidate:
    id: str
    strategy: Strategy
    changes: tuple[str, ...] = ("baseline",)


# ── numbers in a spec ────────────────────────────────────────────────────────

Number = int | float


def _is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _map_numbers(s: Strategy, fn: Callable[[Number], object]) -> Strategy:
    """The same spec with every tunable number replaced, in a fixed order."""

    def one(v: object) -> object:
        return fn(v) if _is_number(v) else v  # type: ignore[arg-type]

    def conds(cs: tuple[Condition, ...]) -> tuple[Condition, ...]:
        return tuple(replace(c, value=one(c.value)) for c in cs)

    e, x = s.entry, s.exit
    entry = replace(
        e,
        conditions=conds(e.conditions),
        triggers=conds(e.triggers),
        guards=conds(e.guards),
        filters=conds(e.filters),
    )
    stop = replace(
        x.stop, value=one(x.stop.value), multiplier=one(x.stop.multiplier), conditions=conds(x.stop.conditions)
    )
    target = replace(
        x.target,
        value=one(x.target.value),
        trigger_pct=one(x.target.trigger_pct),
        trail_pct=one(x.target.trail_pct),
    )
    hold = one(x.max_holding_days)
    # exit triggers are read per bar, so their numbers stay part of the plan
    return replace(s, entry=entry, exit=replace(x, stop=stop, target=target, max_holding_days=hold))


def _numbers(s: Strategy) -> list[Number]:
    found: list[Number] = []
    _map_numbers(s, lambda v: found.append(v) or v)
    return found


def _shape(s: Strategy) -> tuple:
    blank = _map_numbers(s, lambda _v: "#")
    stop_numbers = tuple(c.value for c in s.exit.stop.conditions)
    return replace(blank, id=""), stop_numbers


def _template(s: Strategy, fixed: dict[int, Number], pick: Callable[[int], Column]) -> Strategy:
    counter = itertools.count()

    def put(v: Number) -> object:
        i = next(counter)
        return v if i in fixed else pick(i)

    return _map_numbers(s, put)


# ── the sweep ────────────────────────────────────────────────────────────────


def prepare(bars: DataFrame, strategies: list[Strategy], plans: int) -> DataFrame:
    """Bars with the union of all indicators, computed once.

    They are staged when several plans will read them.
    """
    names: list[str] = []
    for s in strategies:
        names += s.indicators + ([_atr_name(s.exit)] if s.exit.stop.type == "atr" else [])
    ready = with_indicators(bars, sorted(set(names)))
    return stage(ready) if plans > 1 else ready


def _plans(candidates: list[Candidate]) -> dict[tuple, list[Candidate]]:
    """Candidates by the plan that evaluates them: a grid of entries and exits, or the shape of the whole."""

    def family(s: Strategy) -> tuple:
        return s.entry, s.market, s.preferred_regimes, s.rules

    exits = Counter(family(c.strategy) for c in candidates if covers(c.strategy.exit))
    plans: dict[tuple, list[Candidate]] = defaultdict(list)
    for c in candidates:
        s = c.strategy
        # entries that one candidate has differ in numbers only and share a plan by their shape
        grid = covers(s.exit) and exits[family(s)] > 1
        plans[("grid", s.entry.timing, s.entry.slippage, s.market, s.rules) if grid else ("shape", *_shape(s))].append(c)
    return plans


def sweep_trades(bars: DataFrame, candidates: list[Candidate], costs: Costs = Costs()) -> DataFrame:
    """Executed trades of every candidate, keyed by ``candidate_id``."""
    plans = _plans(candidates)
    ready = prepare(bars, [c.strategy for c in candidates], len(plans))
    parts = [grid_trades(ready, members, costs) for key, members in plans.items() if key[0] == "grid"]
    shapes = [_sweep_group(ready, members, costs) for key, members in plans.items() if key[0] == "shape"]
    if shapes:
        parts.append(one_position(reduce(DataFrame.unionByName, shapes), ["candidate_id", "symbol"]))
    return reduce(DataFrame.unionByName, parts)


def _sweep_group(ready: DataFrame, members: list[Candidate], costs: Costs) -> DataFrame:
    first = members[0].strategy
    values = [_numbers(c.strategy) for c in members]
    fixed = {
        i: values[0][i] for i in range(len(values[0])) if all(v[i] == values[0][i] for v in values)
    }
    moving = [i for i in range(len(values[0])) if i not in fixed]
    table = F.array(
        *[
            F.struct(F.lit(c.id).alias("candidate_id"), *[F.lit(float(v[i])).alias(f"p{i}") for i in moving])
            for c, v in zip(members, values)
        ]
    )

    def entered(c: Column) -> Column:
        return entry_column(_template(first, fixed, lambda i: c[f"p{i}"]).entry)

    horizon = max(int(c.strategy.exit.max_holding_days) for c in members)  # type: ignore[call-overload]
    bound = _template(first, fixed, lambda i: F.col("_c")[f"p{i}"])
    bound = replace(bound, exit=replace(bound.exit, horizon=horizon), entry=replace(bound.entry))
    flags = entry_flags(ready, first, costs, flag=F.exists(table, entered))
    return candidate_exits(flags, bound, costs, F.filter(table, entered)).drop("indicator_snapshot")


def roster(candidates: list[Candidate], spark_df: DataFrame) -> DataFrame:
    rows = [(c.id, float(c.strategy.complexity), "; ".join(c.changes)) for c in candidates]
    return spark_df.sparkSession.createDataFrame(rows, "candidate_id string, complexity double, changes string")


def fast_report(
    trades: DataFrame, names: DataFrame, key: str = "candidate_id", *, order: DataFrame | None = None
) -> DataFrame:
    """Metrics, split gaps and confidence of each candidate, zeros without trades."""
    metrics = overall_metrics(trades, [key], names)
    gaps = split_gaps(trades, [key], order)
    neutral = {
        "train_win_rate": 0.0,
        "val_win_rate": 0.0,
        "test_win_rate": 0.0,
        "train_val_gap": 0.0,
        "val_test_gap": 0.0,
        "yearly_consistency": 0.5,
        "param_sensitivity": 0.0,
    }
    joined = metrics.join(gaps, key, "left").fillna(neutral).join(names, key)
    return joined.withColumn("confidence_score", confidence_score(F.col("complexity")))


def full_report(trades: DataFrame, names: DataFrame, key: str = "candidate_id", *, pass_gap: float = 0.10) -> DataFrame:
    """The fast report with fold, regime-holdout and purged-path diagnostics.

    The trades are numbered by date once; all chronological parts read that.
    """
    keys = [key]
    order = stage(numbered(trades, keys))
    report = fast_report(trades, names, key, order=order)
    folds = walk_forward_summary(walk_forward(trades, keys, order=order), keys, pass_gap)
    held = regime_holdout_summary(regime_holdout(trades, keys), keys, pass_gap)
    paths = cpcv(cpcv_paths(trades, keys, order=order), keys)
    for part in (folds, held.withColumnsRenamed({"pass_rate": "holdout_pass_rate", "worst_gap": "holdout_worst_gap"}), paths):
        report = report.join(part, key, "left")
    return report


def param_sensitivity(
    bars: DataFrame, strategy: Strategy, variants: list[Candidate], costs: Costs = Costs()
) -> DataFrame:
    """Mean relative loss of confidence over ±10% variants; 0 below 30 trades."""
    base = Candidate("__base__", strategy)
    trades = stage(sweep_trades(bars, [base, *variants], costs))
    names = roster([base, *variants], trades)
    scored = overall_metrics(trades, ["candidate_id"], names).join(names, "candidate_id")
    scored = scored.withColumn("score", confidence_score(F.col("complexity"), anti_fit=False))
    is_base = F.col("candidate_id") == base.id
    top = scored.where(is_base).select(F.col("score").alias("base"), F.col("signal_count").alias("base_n"))
    loss = F.greatest(F.lit(0.0), F.col("base") - F.col("score")) / F.nullif("base", F.lit(0.0))
    joined = with_row(scored.where(~is_base), top)
    usable = (F.max("base") > 0) & (F.max("base_n") >= 30)
    return joined.agg(
        F.when(usable, F.round(F.avg(loss), 4)).otherwise(0.0).alias("param_sensitivity"),
        F.count("*").alias("variants"),
    )


def two_phase(trades: DataFrame, names: DataFrame, best: int, key: str = "candidate_id", *, score: str = "confidence_score") -> DataFrame:
    """Fast report of every candidate, then the full report of the ``best`` by ``score``.

    The trades are read once for the cheap pass; only those of the best few,
    whose ids are at most ``best`` rows, enter the full pass.
    """
    fast = fast_report(trades, names, key)
    top = stage(fast.select(key, score).orderBy(F.col(score).desc(), key).limit(best).select(key))
    return full_report(stage(trades.join(F.broadcast(top), key, "left_semi")), names.join(F.broadcast(top), key, "left_semi"), key)


# ── grids ────────────────────────────────────────────────────────────────────


def value_grid(
    current: float, low: float, high: float, step: float, *, limit: int, integer: bool = False, digits: int = 6
) -> list[Number]:
    """Ordered distinct values around the current one, inside its range."""
    low, high = min(low, high), max(low, high)
    if step <= 0 or not low <= current <= high:
        return []
    # fixed values: the order in which candidates are tried
    raw = [current, current - step, current + step, low, high, current - 2 * step, current + 2 * step, (low + high) / 2]
    kept = [v for v in raw if low <= v <= high]
    shaped = [int(round(v)) if integer else round(float(v), digits) for v in kept]
    return list(dict.fromkeys(shaped))[: max(1, limit)]


@dataclass(frozen=True)
class Tunable:
    """A number that may move: how to set it, its range and its step."""

    target: str
    low: float
    high: float
    step: float
    get: Callable[[Strategy], float]
    set: Callable[[Strategy, Number], Strategy]
    integer: bool = False


#: How far a tunable number is moved to see how much the result depends on it.
PERTURBATIONS = (0.9, 1.1)


def perturbed(s: Strategy, tunables: list[Tunable]) -> list[Candidate]:
    """Every tunable moved down and up by a tenth, clamped to its range; what does not move is left out."""
    out = []
    for t in tunables:
        now = t.get(s)
        for factor in PERTURBATIONS:
            value = max(t.low, min(t.high, round(now * factor, 6)))
            if value != now:
                out.append(Candidate(f"v{len(out)}", t.set(s, int(value) if t.integer else value), (f"{t.target}: {now} -> {value}",)))
    return out


def param_candidates(
    s: Strategy,
    tunables: list[Tunable],
    *,
    values: int = 5,
    max_changes: int = 1,
    guards: bool = False,
) -> list[Candidate]:
    """Baseline, combinations of up to ``max_changes`` moves, and added guards."""
    moves = [
        (t, v)
        for t in tunables
        for v in value_grid(t.get(s), t.low, t.high, t.step, limit=values, integer=t.integer)
        if v != t.get(s)
    ]
    plans: list[tuple[Strategy, tuple[str, ...]]] = [(s, ("baseline",))]
    combos = [
        group
        for size in range(1, max(1, max_changes) + 1)
        for group in itertools.combinations(moves, size)
        if len({t.target for t, _ in group}) == len(group)
    ]

    def moved(start: Strategy, group: tuple) -> tuple[Strategy, tuple[str, ...]]:
        notes = []
        for t, v in group:
            notes.append(f"{t.target}: {t.get(start)} -> {v}")
            start = t.set(start, v)
        return start, tuple(notes)

    plans += [moved(s, g) for g in combos]
    if guards:
        present = set(s.entry.guards)
        for guard in GUARD_CANDIDATES:
            if guard in present:
                continue
            guarded = replace(s, entry=replace(s.entry, guards=(*s.entry.guards, guard)))
            note = f"Add entry guard: {guard.indicator} {guard.op} {guard.value}"
            plans.append((guarded, (note,)))
            plans += [
                (c, (note, *notes))
                for g in combos
                if len(g) < max_changes
                for c, notes in [moved(guarded, g)]
            ]
    return _numbered(s.id, plans, "p")


def exit_candidates(s: Strategy, spaces: tuple[str, ...] = ("exit", "stoploss", "takeprofit", "holding")) -> list[Candidate]:
    """Every stop x holding x trigger x target combination, without repeats."""
    x = s.exit
    stops = [x.stop] + ([Stop("pct", v) for v in STOP_GRID] if "stoploss" in spaces else [])
    holds = [x.max_holding_days] + (list(HOLDING_GRID) if "holding" in spaces else [])
    triggers = [x.triggers] + (list(TRIGGER_GRID) if "exit" in spaces else [])
    targets = [x.target]
    if "takeprofit" in spaces:
        targets += [Target("rr", v) for v in RR_GRID]
        targets += [Target("trailing", trigger_pct=a, trail_pct=b) for a, b in TRAILING_GRID]
    plans = []
    for stop, hold, trig, goal in itertools.product(
        *[list(dict.fromkeys(options)) for options in (stops, holds, triggers, targets)]
    ):
        changed = Exit(stop, goal, hold, trig)
        notes = [
            f"stop_loss={stop.value:.1%}" if stop != x.stop else "",
            f"take_profit={_target_note(goal)}" if goal != x.target else "",
            f"max_holding_days={hold}" if hold != x.max_holding_days else "",
            f"exit_triggers={','.join(c.indicator for c in trig) or 'none'}" if trig != x.triggers else "",
        ]
        plans.append((replace(s, exit=changed), tuple(n for n in notes if n) or ("baseline",)))
    return _numbered(s.id, plans, "x")


def _target_note(goal: Target) -> str:
    return f"{goal.type}:{goal.trigger_pct}/{goal.trail_pct}" if goal.type == "trailing" else f"{goal.type}:{goal.value}"


def _numbered(base: str, plans: list, tag: str) -> list[Candidate]:
    unique: dict[Strategy, tuple[str, ...]] = {}
    for strategy, notes in plans:
        unique.setdefault(strategy, notes)
    return [
        Candidate(f"{base}_{tag}{i:04d}", strategy, notes) for i, (strategy, notes) in enumerate(unique.items())
    ]
