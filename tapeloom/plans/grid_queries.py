"""Sweeps over the library's own grids, and reads and samples that widen by themselves."""

from __future__ import annotations

from dataclasses import replace

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.indicators import lookback, with_indicators
from tapeloom.functions.spec import warmup_bars
from tapeloom.operators import sampling, sweep
from tapeloom.plans import tables as t
from tapeloom.plans.bar_queries import _SIMPLE, _band, _momentum, _position, _rsi_cte, _since, _slope, _vol, _vratio, guard, ma, over
from tapeloom.plans.registry import query, r, rounded
from tapeloom.plans.trade_queries import BASE
from tapeloom.plans.metric_queries import TAKEN, taken
from tapeloom.plans.trade_sql import trades_sql
from tapeloom.runtime import shared_path
from tapeloom.sources import bars as src

# ── exit grid ────────────────────────────────────────────────────────────────

#: The grid by number, the strategy's own part first; targets below 0 are trailing ones.
_STOPS = (0.10, 0.02, 0.03, 0.05, 0.08)
_HOLDS = (10, 2, 3, 5, 20)
_GOALS = (2.0, 0.8, 1.0, 1.2, 1.5, 2.5, 3.0, -1, -2, -3, -4)
_TRAIL = {-1: (0.04, 0.02), -2: (0.06, 0.03), -3: (0.08, 0.04), -4: (0.10, 0.05)}


def _list(values: tuple) -> str:
    return "(SELECT unnest(%s) AS v, unnest(range(%d)) AS i)" % (list(values), len(values))


_GRID = f"""(SELECT 'trend_x' || lpad((row_number() OVER (ORDER BY a.i, b.i, c.i, d.i) - 1)::VARCHAR, 4, '0') AS candidate_id,
    a.v::DOUBLE AS stop_v, d.v::DOUBLE AS target_v, b.v AS hold, c.i AS call_no
    FROM {_list(_STOPS)} a, {_list(_HOLDS)} b, {_list((0, 1, 2, 3, 4))} c, {_list(_GOALS)} d) c"""


def _case(of: int) -> str:
    return "CASE target_v " + " ".join(f"WHEN {k} THEN {v[of]}" for k, v in _TRAIL.items()) + " END"


_BROKE = {n: guard(f"idx >= {n - 1}", f"close < {ma(n)}", "false") for n in (20, 10, 5)}
GRID_TRADES = "WITH RECURSIVE " + trades_sql(
    base=_rsi_cte(14).removeprefix("WITH "),
    source="s",
    cand=_GRID,
    cand_columns="call_no",
    columns=", ".join(f"{x} AS broke{n}" for n, x in _BROKE.items()),
    target=(
        f"CASE WHEN target_v > 0 THEN high >= p + p * stop_v * target_v ELSE (peak_e - p) / p >= {_case(0)} AND (peak_e - low) / peak_e >= {_case(1)} END",
        f"CASE WHEN target_v > 0 THEN p + p * stop_v * target_v ELSE peak_e * (1 - {_case(1)}) END",
    ),
    signal="(CASE call_no WHEN 1 THEN broke20 WHEN 2 THEN broke10 WHEN 3 THEN broke5 WHEN 4 THEN rsi > 75 ELSE false END)",
)


@query(
    "i04_exit_grid_sweep",
    f"{GRID_TRADES} SELECT candidate_id, symbol, signal_idx, exit_idx, exit_reason, {r('return_pct', 'return_pct')} FROM taken",
)
def exit_grid_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exit of the library's grid for one entry, over all bars."""
    got = sweep.sweep_trades(t.bars_by_symbol(spark, sf_dir), sweep.exit_candidates(BASE))
    return rounded(got.select("candidate_id", "symbol", "signal_idx", "exit_idx", "exit_reason", "return_pct"))


# ── parameter grid ───────────────────────────────────────────────────────────

#: The library's tries around a stop of 0.10 and a holding limit of 10, the current one first.
_STOP_TRIES, _HOLD_TRIES = (0.10, 0.08, 0.12, 0.04, 0.16), (10, 8, 12, 2, 20)
_PARAMS = [
    sweep.Tunable("exit.stop.value", 0.04, 0.16, 0.02, lambda s: s.exit.stop.value, lambda s, v: replace(s, exit=replace(s.exit, stop=replace(s.exit.stop, value=v)))),
    sweep.Tunable("exit.max_holding_days", 2, 20, 2, lambda s: s.exit.max_holding_days, lambda s, v: replace(s, exit=replace(s.exit, max_holding_days=v)), integer=True),
]
#: The guards' conditions in SQL, in the order of the library's list.
_ZSCORE = f"CASE WHEN idx >= 50 AND {over('stddev_pop(rsi)', -49, 0)} >= 1e-6 THEN (rsi - {over('avg(rsi)', -49, 0)}) / {over('stddev_pop(rsi)', -49, 0)} ELSE 0 END"
_GUARDS = [
    f"({_slope(20)}) > 0", f"({_momentum(10)}) > 0", f"({_momentum(20)}) > 0", f"({_vratio(20)}) >= 1.0", f"({_vol(20)}) <= 0.04", f"({_vol(20)}) <= 0.06", "rsi < 65",
    f"({_ZSCORE}) <= 1.5", f"({_position(120)}) >= 0.65", f"({_position(250, 20)}) >= 0.5", f"({_band(20, 2, 'width')}) <= 0.16",
    "(CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0.0 END) >= 0.35", "(CASE WHEN idx >= 1 THEN (open - pc) / pc ELSE 0.0 END) <= 0.04", f"({_since(20, 'high', 'max')}) <= 10",
]


def _first_bars() -> str:
    """First bar that may signal, by guard number: warm-up follows the names of the indicators."""
    names = BASE.indicators
    cases = [f"WHEN {i} THEN {max(30, warmup_bars(sorted({*names, g.indicator})))}" for i, g in enumerate(sweep.GUARD_CANDIDATES)]
    return f"CASE guard_no {' '.join(cases)} ELSE {max(30, warmup_bars(names))} END"


_MOVES = f"""(SELECT a.v AS stop_v, b.v AS hold, row_number() OVER (ORDER BY a.i > 0 AND b.i > 0, a.i = 0, a.i, b.i) AS m
    FROM {_list(_STOP_TRIES)} a, {_list(_HOLD_TRIES)} b WHERE a.i > 0 OR b.i > 0)"""
# baseline and the moves of one and two parameters, then every guard alone and with each move of one parameter
_PARAM_GRID = f"""(SELECT 'trend_p' || lpad((row_number() OVER (ORDER BY g, m) - 1)::VARCHAR, 4, '0') AS candidate_id, stop_v::DOUBLE AS stop_v, 2.0::DOUBLE AS target_v, hold, guard_no FROM (
    SELECT -1 AS g, 0 AS m, 0.1 AS stop_v, 10 AS hold, -1 AS guard_no UNION ALL SELECT -1, m, stop_v, hold, -1 FROM {_MOVES}
    UNION ALL SELECT k, 0, 0.1, 10, k FROM range({len(_GUARDS)}) t(k) UNION ALL SELECT k, m, stop_v, hold, k FROM range({len(_GUARDS)}) t(k), {_MOVES} WHERE stop_v = 0.1 OR hold = 10)) c"""
PARAM_TRADES = "WITH RECURSIVE " + trades_sql(
    base=_rsi_cte(14).removeprefix("WITH ") + f", gd AS (SELECT *, [{', '.join(f'coalesce({g}, false)' for g in _GUARDS)}] AS gs FROM s)",
    source="gd",
    cand=_PARAM_GRID,
    cand_columns="guard_no",
    entry_cand=f"(guard_no < 0 OR gs[guard_no + 1]) AND idx >= {_first_bars()}",
)


@query(
    "i01_i03_param_sweep",
    f"{PARAM_TRADES} SELECT candidate_id, symbol, signal_idx, exit_idx, exit_reason, {r('return_pct', 'return_pct')} FROM taken",
)
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of up to two parameters and the library's guards, over all bars."""
    plans = sweep.param_candidates(BASE, _PARAMS, max_changes=2, guards=True)
    got = sweep.sweep_trades(t.bars_by_symbol(spark, sf_dir), plans)
    return rounded(got.select("candidate_id", "symbol", "signal_idx", "exit_idx", "exit_reason", "return_pct"))


# ── widened reads ────────────────────────────────────────────────────────────

_RANGE = (date(1996, 3, 1), date(1996, 9, 30))
_WIDE_NAMES = ["ma20_slope", "volatility_20d", "atr", "days_since_high_20d", "momentum_10d", "price_position_52w", "rsi_14"]
_WIDE_SQL = {k: v for group in _SIMPLE.values() for k, v in group.items() if k in _WIDE_NAMES}


@query(
    "b11_widened_history",
    f"""{_rsi_cte(14)}, w AS (SELECT symbol, date, rsi, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _WIDE_SQL.items())} FROM s)
    SELECT symbol, date, {', '.join(r(k, k) for k in _WIDE_SQL)}, {r('rsi', 'rsi_14')} FROM w WHERE date BETWEEN '{_RANGE[0]}' AND '{_RANGE[1]}'""",
)
def widened_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of a date range out of a read that only goes back as far as they look."""
    path = shared_path(spark)
    src.write_history(t.bars(spark, sf_dir).drop("prev_close"), path)
    part = src.read_widened(spark, path, *_RANGE, lookback(_WIDE_NAMES))
    made = with_indicators(part, _WIDE_NAMES).where(F.col("date").between(*_RANGE))
    return rounded(made.select("symbol", "date", *[F.col(n).cast("double").alias(n) for n in _WIDE_NAMES]))


# ── sample expansion ─────────────────────────────────────────────────────────

_LADDER = sampling.Ladder(steps=3, symbols=6, more_symbols=4, more_days=180, signals=150)
_FAR = replace(_LADDER, signals=1_000_000)
_SPAN = (date(1998, 1, 1), date(1998, 6, 30))
_RUNGS = ", ".join(f"({k}, {_LADDER.size(k)}, CAST('{_SPAN[0]}' AS DATE) - {k * _LADDER.more_days})" for k in range(_LADDER.steps + 1))


@query(
    "j08_expanded_sample",
    f"""{TAKEN}, rung(step, max_symbols, start_date) AS (VALUES {_RUNGS}),
    ranked AS (SELECT symbol, row_number() OVER (ORDER BY md5('42|' || symbol), symbol) AS a, row_number() OVER (ORDER BY -market_cap NULLS FIRST, symbol) AS b FROM universe),
    adm AS (SELECT symbol, min(step) AS step FROM ranked JOIN rung ON CASE WHEN step <= 1 THEN a ELSE b END <= max_symbols GROUP BY 1),
    sig AS (SELECT greatest(adm.step, greatest(0, ceil(date_diff('day', signal_date, DATE '{_SPAN[0]}') / {_LADDER.more_days}))) AS step FROM tk JOIN adm USING (symbol) WHERE signal_date <= '{_SPAN[1]}'),
    cum AS (SELECT step, max_symbols, start_date, (SELECT count(*) FROM adm WHERE adm.step <= rung.step) AS symbols, (SELECT count(*) FROM sig WHERE sig.step <= rung.step) AS signals FROM rung),
    both_ AS (SELECT 'reached' AS kind, {_LADDER.signals} AS goal, * FROM cum UNION ALL SELECT 'exhausted', {_FAR.signals}, * FROM cum)
    SELECT kind, CAST(step AS INT) AS step, CAST(max_symbols AS INT) AS max_symbols, CAST(start_date AS DATE) AS start_date, symbols, signals, signals >= goal AS reached,
      step = coalesce(min(step) FILTER (signals >= goal) OVER (PARTITION BY kind), {_LADDER.steps}) AS chosen FROM both_""",
)
def expanded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of two ladders over all trades: one finds enough, one runs out of steps."""
    pool, signals = t.universe(spark, sf_dir), taken(spark, sf_dir)
    orders = [sampling.hashed(42), sampling.hashed(42), -F.col("market_cap")]
    cases = [("reached", _LADDER), ("exhausted", _FAR)]
    parts = [sampling.expand(pool, signals, orders, *_SPAN, ladder).withColumn("kind", F.lit(kind)) for kind, ladder in cases]
    return parts[0].unionByName(parts[1])
