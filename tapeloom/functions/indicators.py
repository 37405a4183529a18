"""Named indicators as window expressions.

A name such as ``ma5_above_ma20`` is resolved to a builder.  Builders ask a
:class:`Plan` for intermediate columns; each distinct column is planned once and
placed at the lowest level where its inputs exist, so any number of indicators
shares one shuffle by symbol and a few sorted passes.

Every window is over the bars of one symbol, which hold at most one row per
calendar day.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_EVENT_DAYS = 999


#: What a column that remembers every bar before it looks back on.
WHOLE_HISTORY = math.inf


class Plan:
    """Levels of derived columns over one bar table, and how far back each looks.

    A column looks back ``back`` bars on the columns it reads (``of``), so the
    look-back of the whole is the sum along a chain and the maximum over
    branches of the graph.
    """

    def __init__(self, columns: list[str]) -> None:
        self.columns = set(columns)
        self._level: dict[str, int] = {}
        self._expr: dict[str, Column] = {}
        self._back: dict[str, float] = {}

    def add(self, name: str, level: int, expr: Callable[[], Column], back: float = 0, of: tuple[str, ...] = ()) -> Column:
        if name not in self._expr:
            self._level[name] = level
            self._back[name] = back + max((self._back[n] for n in of), default=0)
            self._expr[name] = expr()
        return F.col(name)

    @property
    def lookback(self) -> float:
        """Bars before a bar that any of the columns needs."""
        return max(self._back.values(), default=0)

    def level(self, name: str) -> int:
        return self._level[name]

    def apply(self, df: DataFrame) -> DataFrame:
        for level in sorted(set(self._level.values())):
            names = [n for n, v in self._level.items() if v == level]
            df = df.select("*", *[self._expr[n].alias(n) for n in names])
        return df


def bars_window() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def frame(first: int, last: int) -> Window:
    return bars_window().rowsBetween(first, last)


IDX = "_idx"


def position(p: Plan) -> Column:
    return p.add(IDX, 0, lambda: F.row_number().over(bars_window()) - 1)


def previous(p: Plan, col: str, n: int = 1) -> Column:
    return p.add(f"_{col}_{n}", 0, lambda: F.lag(col, n).over(bars_window()), back=n)


def moving_average(p: Plan, n: int, ago: int = 0, col: str = "close") -> Column:
    return p.add(f"_avg_{col}_{n}_{ago}", 0, lambda: F.avg(col).over(frame(1 - n - ago, -ago)), back=n - 1 + ago)


def guard(ok: Column, value: Column, default: float | bool | int) -> Column:
    return F.coalesce(F.when(ok, value), F.lit(default))


def true_range(p: Plan) -> Column:
    prev = previous(p, "close")
    spread = F.col("high") - F.col("low")
    return p.add(
        "_tr",
        1,
        lambda: F.greatest(spread, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        of=("_close_1",),
    )


#: A decayed sum forgets what weighs less than this.
FORGOTTEN = 1e-18


def decayed_sum(p: Plan, tag: str, level: int, value: Column, decay: float, of: tuple[str, ...] = ()) -> tuple[Column, int]:
    """``s = decay * s_before + value`` along the bars, without a fold.

    Inside a block the sum is a running sum of ``value * decay^-k``; the block
    is short enough for that power to stay finite and long enough for anything
    before the previous block to vanish (1e-150).
    """
    if decay <= 0:
        return p.add(f"_dec_{tag}", level, lambda: value, of=of), level + 1
    position(p)
    span = max(2, int(150 * math.log(10) / -math.log(decay)))
    block, k = F.floor(F.col(IDX) / span), F.col(IDX) % span
    inner = Window.partitionBy("symbol", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    local = p.add(
        f"_loc_{tag}",
        level,
        lambda: F.sum(value * F.pow(F.lit(decay), -k)).over(inner) * F.pow(F.lit(decay), k),
    )
    closing = F.when(k == span - 1, local)
    carried = F.last(closing, ignorenulls=True).over(frame(Window.unboundedPreceding, -1))
    total = p.add(
        f"_dec_{tag}",
        level + 1,
        lambda: local + F.coalesce(carried, F.lit(0.0)) * F.pow(F.lit(decay), k + 1),
        back=math.ceil(math.log(FORGOTTEN) / math.log(decay)),
        of=of,
    )
    return total, level + 2


# ── families ─────────────────────────────────────────────────────────────────

Built = tuple[Column, int]
Builder = Callable[..., Built]


def _ma_above(p: Plan, n: int, m: int) -> Built:
    idx = position(p)
    fast, slow = moving_average(p, n), moving_average(p, m)
    return guard(idx >= max(n, m) - 1, fast > slow, False), 1


def _ma_ge_or_crossing(p: Plan, n: int, m: int) -> Built:
    idx = position(p)
    fast, slow = moving_average(p, n), moving_average(p, m)
    before = moving_average(p, n, 1) < moving_average(p, m, 1)
    return guard(idx >= max(n, m), (fast >= slow) | (before & (fast >= slow * 0.998)), False), 1


def _close_to_ma(p: Plan, n: int) -> Built:
    idx, ma = position(p), moving_average(p, n)
    return guard((idx >= n - 1) & (ma != 0), F.abs(F.col("close") - ma) / F.nullif(ma, F.lit(0.0)), 1.0), 1


def _close_above_ma(p: Plan, n: int) -> Built:
    return guard(position(p) >= n - 1, F.col("close") > moving_average(p, n), False), 1


def _close_below_ma(p: Plan, n: int) -> Built:
    return guard(position(p) >= n - 1, F.col("close") < moving_average(p, n), False), 1


def _deviation(p: Plan, n: int) -> Built:
    idx, ma = position(p), moving_average(p, n)
    return guard(idx >= n - 1, (F.col("close") - ma) / F.nullif(ma, F.lit(0.0)), 0.0), 1


def _ma_slope(p: Plan, n: int) -> Built:
    idx, now, then = position(p), moving_average(p, n), moving_average(p, n, 5)
    return guard(idx >= n + 4, (now - then) / F.nullif(then, F.lit(0.0)), 0.0), 1


def _rsi(p: Plan, n: int) -> Built:
    idx = position(p)
    move = F.coalesce(F.col("close") - previous(p, "close"), F.lit(0.0))
    keep = 1 - 1 / n
    gain, _ = decayed_sum(p, f"gain_{n}", 1, F.greatest(move, F.lit(0.0)), keep, ("_close_1",))
    loss, level = decayed_sum(p, f"loss_{n}", 1, F.greatest(-move, F.lit(0.0)), keep, ("_close_1",))
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return p.add(f"_rsi_{n}", level, lambda: guard(idx >= n, value, 50.0), of=(f"_dec_gain_{n}", f"_dec_loss_{n}")), level + 1


def _rsi_zscore(p: Plan, n: int) -> Built:
    rsi, level = _rsi(p, n)
    mean = p.add(f"_rsi_mean_{n}", level, lambda: F.avg(rsi).over(frame(-49, 0)), back=49, of=(f"_rsi_{n}",))
    std = p.add(f"_rsi_std_{n}", level, lambda: F.stddev_pop(rsi).over(frame(-49, 0)), back=49, of=(f"_rsi_{n}",))
    ok = (position(p) >= 50) & (std >= 1e-6)
    return guard(ok, (rsi - mean) / F.nullif(std, F.lit(0.0)), 0.0), level + 1


def _macd(p: Plan, fast: int, slow: int, signal: int) -> tuple[Column, Column, int]:
    idx = position(p)

    def ema(tag: str, level: int, value: Column, span: int, of: tuple[str, ...] = ()) -> Built:
        alpha = 2 / (span + 1)
        return decayed_sum(p, tag, level, F.when(idx == 0, value).otherwise(value * alpha), 1 - alpha, of)

    quick, _ = ema(f"ema_{fast}", 1, F.col("close"), fast)
    slow_ema, level = ema(f"ema_{slow}", 1, F.col("close"), slow)
    key = f"{fast}_{slow}"
    line = p.add(f"_macd_{key}", level, lambda: quick - slow_ema, of=(f"_dec_ema_{fast}", f"_dec_ema_{slow}"))
    smooth, level = ema(f"sig_{key}_{signal}", level + 1, line, signal, (f"_macd_{key}",))
    return line, smooth, level


def _macd_histogram(p: Plan, fast: int, slow: int, signal: int) -> Built:
    line, smooth, level = _macd(p, fast, slow, signal)
    return guard(position(p) + 1 >= slow + signal - 1, line - smooth, 0.0), level


def _macd_cross(p: Plan, fast: int, slow: int, signal: int) -> Built:
    line, smooth, level = _macd(p, fast, slow, signal)
    key = f"{fast}_{slow}_{signal}"
    gap = p.add(f"_gap_{key}", level, lambda: line - smooth, of=(f"_dec_sig_{key}",))
    before = p.add(f"_gapb_{key}", level + 1, lambda: F.lag(gap, 1).over(bars_window()), back=1, of=(f"_gap_{key}",))
    return guard(position(p) >= slow + signal - 1, (gap > 0) & (before <= 0), False), level + 2


def _atr(p: Plan, n: int) -> Built:
    idx, tr = position(p), true_range(p)
    mean = p.add(f"_atr_{n}", 2, lambda: F.avg(tr).over(frame(1 - n, 0)), back=n - 1, of=("_tr",))
    return F.when(idx >= n, mean).otherwise(tr), 3


def _bands(p: Plan, n: int, s: str | None) -> tuple[Column, Column, float]:
    mid = moving_average(p, n)
    std = p.add(f"_std_close_{n}", 0, lambda: F.stddev_samp("close").over(frame(1 - n, 0)), back=n - 1)
    return mid, std, multiplier(s or "2")


def multiplier(token: str) -> float:
    return float(token.replace("p", "."))


def _boll_width(p: Plan, n: int, s: str | None) -> Built:
    mid, std, k = _bands(p, n, s)
    return guard(position(p) >= n - 1, 2 * k * std / F.nullif(mid, F.lit(0.0)), 0.1), 1


def _boll_above(p: Plan, n: int, s: str | None) -> Built:
    mid, std, k = _bands(p, n, s)
    return guard(position(p) >= n - 1, F.col("close") > mid + k * std, False), 1


def _boll_below(p: Plan, n: int, s: str | None) -> Built:
    mid, std, k = _bands(p, n, s)
    return guard(position(p) >= n - 1, F.col("close") < mid - k * std, False), 1


def _breakout(p: Plan, n: int) -> Built:
    top = p.add(f"_top_{n}", 0, lambda: F.max("high").over(frame(-n, -1)), back=n)
    return guard(position(p) >= n, F.col("close") > top, False), 1


def _price_position(p: Plan, n: int, least: int = 2) -> Built:
    low = p.add(f"_minc_{n}", 0, lambda: F.min("close").over(frame(1 - n, 0)), back=n - 1)
    high = p.add(f"_maxc_{n}", 0, lambda: F.max("close").over(frame(1 - n, 0)), back=n - 1)
    ok = (position(p) + 1 >= least) & F.lit(n >= 2)
    return guard(ok, (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)), 0.5), 1


def _volume_ratio(p: Plan, n: int) -> Built:
    base = p.add(f"_basev_{n}", 0, lambda: F.avg("volume").over(frame(-n, -1)), back=n)
    return guard((position(p) >= n) & (base > 0), F.col("volume") / F.nullif(base, F.lit(0.0)), 1.0), 1


def _momentum(p: Plan, n: int) -> Built:
    then = previous(p, "close", n)
    return guard(position(p) >= n, (F.col("close") - then) / F.nullif(then, F.lit(0.0)), 0.0), 1


def _avg_volume(p: Plan, n: int) -> Built:
    mean = moving_average(p, n, col="volume")
    return F.when(position(p) >= n - 1, mean).otherwise(F.col("volume")), 1


def _days_since_high(p: Plan, n: int) -> Built:
    idx = position(p)
    at = p.add(f"_hi_at_{n}", 1, lambda: F.max_by(idx, F.struct(F.col("high"), -idx)).over(frame(1 - n, 0)), back=n - 1)
    return guard(idx >= n - 1, idx - at, 0).cast("int"), 2


def _days_since_low(p: Plan, n: int) -> Built:
    idx = position(p)
    at = p.add(f"_lo_at_{n}", 1, lambda: F.min_by(idx, F.struct(F.col("low"), idx)).over(frame(1 - n, 0)), back=n - 1)
    return guard(idx >= n - 1, idx - at, 0).cast("int"), 2


def _volatility(p: Plan, n: int) -> Built:
    prev = previous(p, "close")
    ret = p.add("_ret", 1, lambda: F.col("close") / F.nullif(prev, F.lit(0.0)) - 1, of=("_close_1",))
    if n - 1 < 5:
        return F.lit(0.0), 0
    std = p.add(f"_vol_{n}", 2, lambda: F.stddev_samp(ret).over(frame(2 - n, 0)), back=n - 2, of=("_ret",))
    count = p.add(f"_voln_{n}", 2, lambda: F.count(ret).over(frame(2 - n, 0)), back=n - 2, of=("_ret",))
    return guard((position(p) >= n) & (count >= 5), std * math.sqrt(250), 0.0), 3


def _relative_strength(p: Plan, n: int) -> Built:
    then = previous(p, "close", n)
    own = F.col("close") / F.nullif(then, F.lit(0.0)) - 1
    index: Column = F.lit(0.0)
    if "bench_close" in p.columns:
        base = previous(p, "bench_close", n)
        index = F.coalesce(F.col("bench_close") / F.nullif(base, F.lit(0.0)) - 1, F.lit(0.0))
    return guard(position(p) >= n, own - index, 0.0), 1


def _stop_signal(p: Plan) -> Built:
    idx, prev_open, prev_close = position(p), previous(p, "open"), previous(p, "close")
    body = F.abs(F.col("close") - F.col("open"))
    shadow = F.least("open", "close") - F.col("low")
    hammer = (body > 0) & (shadow >= 2 * body)
    engulfing = (
        (prev_close < prev_open)
        & (F.col("close") > F.col("open"))
        & (F.col("close") > prev_open)
        & (F.col("open") < prev_close)
    )
    return guard(idx >= 1, hammer | engulfing, False), 1


def _shrink_then_rise(p: Plan) -> Built:
    v1, v2, v3 = (previous(p, "volume", i) for i in (1, 2, 3))
    return guard(position(p) >= 3, (v3 > v2) & (v2 > v1) & (F.col("volume") > v1), False), 1


def _streak(p: Plan, up: bool) -> Built:
    idx, prev = position(p), previous(p, "close")
    move = F.col("close") > prev if up else F.col("close") < prev
    broken = F.when(~F.coalesce(move, F.lit(False)), idx)
    last = p.add(
        f"_broken_{'up' if up else 'down'}",
        1,
        lambda: F.max(broken).over(frame(Window.unboundedPreceding, 0)),
        back=WHOLE_HISTORY,
    )
    return (idx - last).cast("int"), 2


def _gap_up(p: Plan) -> Built:
    prev = previous(p, "close")
    return guard(position(p) >= 1, (F.col("open") - prev) / F.nullif(prev, F.lit(0.0)), 0.0), 1


def _body_to_range(p: Plan) -> Built:
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return F.coalesce(F.abs(F.col("close") - F.col("open")) / spread, F.lit(0.0)), 0


def _context(column: str, default: float | bool | int) -> Callable[[Plan], Built]:
    """A column joined from the universe, sector or event tables, with its default."""

    def build(p: Plan) -> Built:
        return (F.coalesce(F.col(column), F.lit(default)) if column in p.columns else F.lit(default)), 0

    return build


def _fund_flow(p: Plan) -> Built:
    if "sector_net_inflow" not in p.columns:
        return F.lit(True), 0
    return F.coalesce(F.col("sector_net_inflow") > 0, F.lit(True)), 0


# ── registry ─────────────────────────────────────────────────────────────────

_FAMILIES: list[tuple[str, Builder]] = [
    (r"ma(\d+)_above_ma(\d+)", _ma_above),
    (r"ma(\d+)_ge_ma(\d+)_or_crossing", _ma_ge_or_crossing),
    (r"close_to_ma(\d+)_pct", _close_to_ma),
    (r"close_above_ma(\d+)", _close_above_ma),
    (r"close_below_ma(\d+)", _close_below_ma),
    (r"deviation_from_ma(\d+)_pct", _deviation),
    (r"ma(\d+)_slope", _ma_slope),
    (r"rsi_(\d+)", _rsi),
    (r"rsi_(\d+)_zscore", _rsi_zscore),
    (r"macd_histogram_fast(\d+)_slow(\d+)_signal(\d+)", _macd_histogram),
    (r"macd_cross_bullish_fast(\d+)_slow(\d+)_signal(\d+)", _macd_cross),
    (r"atr_(\d+)", _atr),
    (r"bollinger_band_width_(\d+)d(?:_std(\d+(?:p\d+)?))?", _boll_width),
    (r"price_above_bollinger_upper_(\d+)d(?:_std(\d+(?:p\d+)?))?", _boll_above),
    (r"price_below_bollinger_lower_(\d+)d(?:_std(\d+(?:p\d+)?))?", _boll_below),
    (r"breakout_high_(\d+)d", _breakout),
    (r"price_position_(\d+)d", _price_position),
    (r"volume_ratio_1d_(\d+)d", _volume_ratio),
    (r"momentum_(\d+)d", _momentum),
    (r"avg_volume_(\d+)d", _avg_volume),
    (r"days_since_high_(\d+)d", _days_since_high),
    (r"days_since_low_(\d+)d", _days_since_low),
    (r"volatility_(\d+)d", _volatility),
    (r"relative_strength_(\d+)d", _relative_strength),
]

# Names that stand for one member of a family.
_ALIASES = {
    "atr": "atr_14",
    "macd_histogram": "macd_histogram_fast12_slow26_signal9",
    "macd_cross_bullish": "macd_cross_bullish_fast12_slow26_signal9",
    "bollinger_band_width": "bollinger_band_width_20d",
    "price_above_bollinger_upper": "price_above_bollinger_upper_20d",
    "price_below_bollinger_lower": "price_below_bollinger_lower_20d",
}

_NAMED: dict[str, Builder] = {
    "has_stop_signal": _stop_signal,
    "volume_shrink_then_rise": _shrink_then_rise,
    "consecutive_up_days": lambda p: _streak(p, True),
    "consecutive_down_days": lambda p: _streak(p, False),
    "price_position_52w": lambda p: _price_position(p, 250, 20),
    "gap_up_pct": _gap_up,
    "body_to_range_ratio": _body_to_range,
    "st_flag": _context("is_st", False),
    "sector_heat_rank": _context("sector_heat_rank", 1),
    "sector_heat_rising_days": _context("sector_rising_days", 99),
    "intra_sector_strength_rank_pct": _context("intra_sector_strength_rank_pct", 0.0),
    "negative_news_score": _context("negative_news_score", 0.0),
    "news_sentiment_score": _context("news_sentiment_score", 0.0),
    "days_since_event": _context("days_since_event", NO_EVENT_DAYS),
    "price_above_pre_event": _context("price_above_pre_event", False),
    "already_overreacted": _context("already_overreacted", False),
    "sector_fund_flow_positive": _fund_flow,
    "sector_risk_flag": _context("sector_risk_flag", False),
    "sector_net_inflow_days": _context("sector_net_inflow_days", 99),
}

EVENT_INDICATORS = (
    "negative_news_score",
    "news_sentiment_score",
    "days_since_event",
    "price_above_pre_event",
    "already_overreacted",
)

# Family members that also exist as plain registered names.
_COMMON_MEMBERS = (
    "ma5_above_ma10",
    "close_to_ma10_pct",
    "close_above_ma20",
    "close_below_ma10",
    "volume_ratio_1d_5d",
    "rsi_14",
    "deviation_from_ma20_pct",
    "ma5_ge_ma10_or_crossing",
    "ma20_slope",
    "momentum_10d",
    "avg_volume_20d",
    "days_since_high_20d",
    "days_since_low_20d",
    "rsi_14_zscore",
    "volume_ratio_1d_20d",
    "volatility_20d",
    "relative_strength_20d",
)

_custom: dict[str, Builder] = {}
_runtime: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    """Decorator: add an indicator builder ``(plan) -> (Column, level)``."""

    def add(builder: Builder) -> Builder:
        _custom[name] = builder
        return builder

    return add


def register_dynamic(name: str, factor: Callable[[], Column] | str) -> None:
    """Add a run-time factor: a Column builder, or the name of a precomputed column."""

    def build(p: Plan) -> Built:
        column = F.col(factor) if isinstance(factor, str) else factor()
        value = p.add(f"_dyn_{name}", 0, lambda: column.cast("double"), back=WHOLE_HISTORY)
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        return guard(finite, value, 0.0), 1

    _runtime[name] = build


def unregister_dynamic(name: str) -> None:
    _runtime.pop(name, None)


def dynamic_names() -> list[str]:
    return sorted(_runtime)


def available() -> list[str]:
    return sorted({*_NAMED, *_ALIASES, *_COMMON_MEMBERS, *_custom, *_runtime})


def _match(name: str) -> tuple[Builder, list] | None:
    if name in _runtime:
        return _runtime[name], []
    if name in _custom:
        return _custom[name], []
    if name in _NAMED:
        return _NAMED[name], []
    name = _ALIASES.get(name, name)
    for pattern, builder in _FAMILIES:
        if not (found := re.fullmatch(pattern, name)):
            continue
        args = [int(g) if g and g.isdigit() and "std" not in pattern else g for g in found.groups()]
        if "std" in pattern:
            args = [int(args[0]), args[1]]
        numbers = [a for a in args if isinstance(a, int)]
        bad_band = "std" in pattern and args[1] is not None and multiplier(args[1]) <= 0
        bad_macd = "fast" in pattern and args[0] >= args[1]
        return None if min(numbers) <= 0 or bad_band or bad_macd else (builder, args)
    return None


def is_registered(name: str) -> bool:
    return _match(name) is not None


def lookback(names: list[str], columns: list[str] | None = None) -> float:
    """Bars before a bar that its values of the indicators depend on; infinite for all of them.

    Decayed averages forget: what weighs less than ``FORGOTTEN`` is not counted.
    A run-time factor may look at anything, so it counts as infinite.
    """
    plan = Plan(columns or ["open", "high", "low", "close", "volume", "bench_close"])
    for name in names:
        if (found := _match(name)) is None:
            raise ValueError(f"unknown indicator: {name}")
        found[0](plan, *found[1])
    return plan.lookback


def with_indicators(bars: DataFrame, names: list[str], *, keep_index: bool = False) -> DataFrame:
    """Add one column per indicator name to a bar table.

    Context indicators read columns joined earlier: ``bench_close``, ``is_st``,
    ``sector_*`` and the event columns; without them their defaults apply.
    """
    wanted = list(dict.fromkeys(names))
    unknown = sorted(n for n in wanted if not is_registered(n))
    if unknown:
        raise ValueError(f"unknown indicators: {', '.join(unknown)}; known: {', '.join(available())}")
    plan = Plan(bars.columns)
    outputs: dict[str, Column] = {}
    for name in wanted:
        builder, args = _match(name)  # type: ignore[misc]
        outputs[name], _ = builder(plan, *args)
    if keep_index:
        position(plan)
    df = plan.apply(bars)
    kept = [c for c in bars.columns if c not in outputs]
    tail = [F.col(IDX).alias("idx")] if keep_index else []
    return df.select(*kept, *tail, *[expr.alias(n) for n, expr in outputs.items()])
