"""Queries that derive trades: every fill, stop, target and rule variant."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import context
from tapeloom.functions.regime import with_regime
from tapeloom.functions.spec import DEFAULT_RULES, Condition, Entry, Exit, Stop, Strategy, Target
from tapeloom.operators import trades as tr
from tapeloom.plans import tables as t
from tapeloom.plans.bar_queries import _LIMIT, _SIMPLE, WIDE, _atr, ma
from tapeloom.plans.registry import QUERIES, SQL, query, rounded
from tapeloom.plans.trade_sql import RICH, TRADE_COLUMNS, trades_sql

ENTRY = Entry(
    conditions=(Condition("ma5_above_ma10", "==", True), Condition("close_above_ma20", "==", True))
)
BASE = Strategy("trend", ENTRY, Exit(Stop("pct", 0.10), Target("rr", 2.0), 10))
COLUMNS = [
    "symbol",
    "signal_idx",
    "entry_idx",
    "exit_idx",
    "signal_date",
    "exit_date",
    "exit_reason",
    "holding_days",
    "entry_price",
    "exit_price",
    "return_pct",
]


def rich_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with sector and the symbol's own regime."""
    b = with_regime(t.bars_by_symbol(spark, sf_dir), ["symbol"], WIDE)
    return context.join_universe(b, t.universe(spark, sf_dir)).drop("is_st")


def _exit(**changes: object) -> Strategy:
    return replace(BASE, exit=replace(BASE.exit, **changes))


def _variant(key: str, strategy: Strategy, costs: tr.Costs = tr.Costs(), **sql: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = rich_bars if sql.get("base") == RICH else t.bars
        return rounded(tr.trades(source(spark, sf_dir), strategy, costs).select(*COLUMNS))

    QUERIES[key] = run
    SQL[key] = f"WITH RECURSIVE {trades_sql(**sql)} SELECT {TRADE_COLUMNS} FROM taken"


_variant("e01_e05_e10_e16_e18_trades", BASE)
_variant("e02_close_entry", replace(BASE, entry=replace(ENTRY, timing="close")), timing="close")
_variant(
    "e02_breakout_high_entry", replace(BASE, entry=replace(ENTRY, timing="breakout_high")), timing="breakout_high"
)
_variant(
    "e06_atr_stop",
    _exit(stop=Stop("atr", multiplier=1.5)),
    columns=f"{_atr(14)} AS atr",
    stop=("low <= p - atr * 1.5", "p - atr * 1.5"),
    target=("high >= p + atr * 1.5 * target_v", "p + atr * 1.5 * target_v"),
)
_variant(
    "e07_trailing_stop",
    _exit(stop=Stop("pct_from_low", 0.08)),
    stop=(
        "(low - CASE WHEN j <= e + 1 THEN high ELSE peak_1 END) / CASE WHEN j <= e + 1 THEN high ELSE peak_1 END <= -0.08",
        "CASE WHEN j <= e + 1 THEN high ELSE peak_1 END * 0.92",
    ),
    target=("high >= p + p * 0.08 * target_v", "p + p * 0.08 * target_v"),
)
_variant(
    "e08_price_level_stop",
    _exit(stop=Stop("price_level", reference="entry_low")),
    stop=("low <= e_low", "e_low"),
    target=("high >= p + p * 0.05 * target_v", "p + p * 0.05 * target_v"),
)
_variant(
    "e08_price_level_column_stop",
    _exit(stop=Stop("price_level", reference="prev_close")),
    columns="prev_close AS level",
    stop=("low <= level", "level"),
    target=("high >= p + p * 0.05 * target_v", "p + p * 0.05 * target_v"),
)
_variant(
    "e09_composite_stop",
    _exit(stop=Stop("composite", conditions=(Condition("close_below_ma10", "==", True),))),
    columns=f"{_SIMPLE['d05_d28_close_below_ma']['close_below_ma10']} AS broke",
    stop=("broke", "close"),
    target=("high >= p + p * 0.05 * target_v", "p + p * 0.05 * target_v"),
)
_variant("e11_pct_target", _exit(target=Target("pct", 0.06)), target=("high >= p * 1.06", "p * 1.06"))
_variant(
    "e12_target_ma",
    _exit(target=Target("target_ma", target="ma20")),
    columns=f"CASE WHEN idx >= 19 THEN {ma(20)} END AS goal",
    target=("high >= goal", "goal"),
)
_variant(
    "e13_trailing_target",
    _exit(target=Target("trailing", trigger_pct=0.06, trail_pct=0.03)),
    target=("(peak_e - p) / p >= 0.06 AND (peak_e - low) / peak_e >= 0.03", "peak_e * 0.97"),
)
_variant(
    "e13_trailing_target_close_entry",
    replace(_exit(target=Target("trailing")), entry=replace(ENTRY, timing="close")),
    timing="close",
    target=(
        "(greatest(peak_e, sh) - p) / p >= 0.08 AND (greatest(peak_e, sh) - low) / greatest(peak_e, sh) >= 0.04",
        "greatest(peak_e, sh) * 0.96",
    ),
)
_variant(
    "e14_optimistic_conflicts",
    _exit(stop=Stop("pct", 0.01), target=Target("pct", 0.01)),
    tr.Costs(fill_policy="take_profit_first"),
    stop=("low <= p * 0.99", "p * 0.99"),
    target=("high >= p * 1.01", "p * 1.01"),
    policy="optimistic",
)
_variant(
    "e14_close_first_conflicts",
    _exit(stop=Stop("pct", 0.01), target=Target("pct", 0.01)),
    tr.Costs(fill_policy="close_first"),
    stop=("low <= p * 0.99", "p * 0.99"),
    target=("high >= p * 1.01", "p * 1.01"),
    policy="close_first",
)
_variant(
    "e15_exit_triggers",
    _exit(triggers=(Condition("close_below_ma10", "==", True),)),
    trigger=_SIMPLE["d05_d28_close_below_ma"]["close_below_ma10"],
)
_A_SHARE = _LIMIT.replace("symbol", "symbol")
_variant(
    "e03_e04_b07_blocked_sells",
    replace(BASE, market="a_share", rules=DEFAULT_RULES["a_share"]),
    base=RICH,
    columns=f"coalesce((close - prev_close) / prev_close <= -({_A_SHARE}), false) AS down, coalesce((close - prev_close) / prev_close >= ({_A_SHARE}), false) AS up",
    buy="volume <> 0 AND NOT up",
    sell=f"volume <> 0 AND NOT coalesce((close - prev_close) / prev_close <= -({_A_SHARE}), false)",
    t_plus_1=True,
    reach="100000",
)
_variant(
    "b05_regime_gate",
    replace(BASE, preferred_regimes=("range_bound", "trending_up")),
    base=RICH,
    gate="(regime IS NULL OR regime IN ('range_bound', 'trending_up'))",
)


@query(
    "e20_regime_sector_tags",
    f"""WITH RECURSIVE {trades_sql(base=RICH, tags='regime, sector')}
    SELECT symbol, signal_idx, exit_idx, exit_reason, regime, sector FROM taken""",
)
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tr.trades(rich_bars(spark, sf_dir), BASE)
    return got.select("symbol", "signal_idx", "exit_idx", "exit_reason", "regime", "sector")


_SNAP = {
    "ma20_slope": _SIMPLE["d07_d41_ma_slope"]["ma20_slope"],
    "momentum_10d": _SIMPLE["d19_d42_momentum"]["momentum_10d"],
    "volume_ratio_1d_5d": _SIMPLE["d18_d29_d49_volume_ratio"]["volume_ratio_1d_5d"],
}


@query(
    "e19_entry_snapshot",
    f"""WITH RECURSIVE {trades_sql(columns=', '.join(f'{v} AS {k}' for k, v in _SNAP.items()), tags=', '.join(_SNAP))}
    SELECT symbol, signal_idx, {', '.join(f'round(round({k}, 4) + 1e-7, 4) + 0.0 AS {k}' for k in _SNAP)} FROM taken""",
)
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tr.trades(t.bars(spark, sf_dir), BASE, snapshot=True)
    picked = [F.col("indicator_snapshot")[k].alias(k) for k in _SNAP]
    return rounded(got.select("symbol", "signal_idx", *picked), 4)


@query(
    "e01_run_counts",
    f"""WITH RECURSIVE {trades_sql()} SELECT 'trend' AS strategy_id, count(*) AS total_signals, count(exit_price) AS executed_signals,
    count(*) - count(exit_price) AS skipped_signals FROM taken""",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.run_counts(tr.trades(t.bars(spark, sf_dir), BASE))


@query(
    "b10_signal_bars",
    f"""WITH RECURSIVE {trades_sql()} SELECT symbol, idx, date FROM f1 WHERE flag AND idx >= 30 AND n_bars >= 30 AND volume <> 0""",
)
def signal_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.entry_flags(t.bars(spark, sf_dir), BASE).where("entry").select("symbol", "idx", "date")
