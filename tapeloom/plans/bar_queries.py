"""Queries over bars: preparation, indicators, events, regimes, conditions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import context, events, indicators, regime, spec
from tapeloom.plans import tables as t
from tapeloom.plans.registry import QUERIES, SQL, query, r, rounded
from tapeloom.runtime import shared_path
from tapeloom.sources import bars as src

W = "PARTITION BY symbol ORDER BY date"
BARS = "WITH " + t.SQL_BARS


def over(agg: str, first: int, last: int) -> str:
    def edge(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"

    return f"{agg} OVER ({W} ROWS BETWEEN {edge(first)} AND {edge(last)})"


def ma(n: int, ago: int = 0, col: str = "close") -> str:
    return over(f"avg({col})", 1 - n - ago, -ago)


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER ({W})"


def guard(ok: str, value: str, default: str) -> str:
    return f"coalesce(CASE WHEN {ok} THEN {value} END, {default})"


def decayed(u: str, d: str) -> str:
    return (
        f"(sum(({u}) * pow({d}, -idx)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        f" * pow({d}, idx))"
    )


# ── indicators ───────────────────────────────────────────────────────────────


def _band(n: int, k: float, kind: str) -> str:
    mid, std = ma(n), over("stddev_samp(close)", 1 - n, 0)
    if kind == "width":
        return guard(f"idx >= {n - 1}", f"2 * {k} * {std} / {mid}", "0.1")
    sign, op = ("+", ">") if kind == "above" else ("-", "<")
    return guard(f"idx >= {n - 1}", f"close {op} {mid} {sign} {k} * {std}", "false")


def _ma_above(n: int, m: int) -> str:
    return guard(f"idx >= {max(n, m) - 1}", f"{ma(n)} > {ma(m)}", "false")


def _ma_cross(n: int, m: int) -> str:
    near = f"({ma(n, 1)} < {ma(m, 1)} AND {ma(n)} >= {ma(m)} * 0.998)"
    return guard(f"idx >= {max(n, m)}", f"({ma(n)} >= {ma(m)} OR {near})", "false")


def _slope(n: int) -> str:
    return guard(f"idx >= {n + 4}", f"({ma(n)} - {ma(n, 5)}) / {ma(n, 5)}", "0.0")


def _atr(n: int) -> str:
    return f"CASE WHEN idx >= {n} THEN {over('avg(tr)', 1 - n, 0)} ELSE tr END"


def _position(n: int, least: int = 2) -> str:
    lo, hi = over("min(close)", 1 - n, 0), over("max(close)", 1 - n, 0)
    return guard(f"idx + 1 >= {least} AND {hi} > {lo}", f"(close - {lo}) / ({hi} - {lo})", "0.5")


def _vratio(n: int) -> str:
    base = over("avg(volume)", -n, -1)
    return guard(f"idx >= {n} AND {base} > 0", f"volume / {base}", "1.0")


def _momentum(n: int) -> str:
    return guard(f"idx >= {n}", f"(close - {lag('close', n)}) / {lag('close', n)}", "0.0")


def _avgvol(n: int) -> str:
    return f"CASE WHEN idx >= {n - 1} THEN {ma(n, col='volume')} ELSE volume END"


def _since(n: int, col: str, best: str) -> str:
    at = over(f"list({col})", 1 - n, 0)
    return f"CASE WHEN idx >= {n - 1} THEN {n} - list_position({at}, {over(f'{best}({col})', 1 - n, 0)}) ELSE 0 END"


def _vol(n: int) -> str:
    return guard(f"idx >= {n}", f"{over('stddev_samp(ret)', 2 - n, 0)} * sqrt(250)", "0.0")


def _streak(op: str) -> str:
    broken = f"max(CASE WHEN coalesce(close {op} pc, false) THEN NULL ELSE idx END)"
    return f"idx - {broken} OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_BASE = f"""{BARS},
x AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close / pc - 1 AS ret
      FROM (SELECT *, {lag('close')} AS pc, {lag('open')} AS po FROM bars))"""

_HAMMER = "(abs(close - open) > 0 AND least(open, close) - low >= 2 * abs(close - open))"
_ENGULF = "(pc < po AND close > open AND close > po AND open < pc)"

# key -> {indicator: SQL over x}; doubles are rounded on both sides
_SIMPLE: dict[str, dict[str, str]] = {
    "d01_d25_ma_above": {"ma5_above_ma10": _ma_above(5, 10), "ma20_above_ma60": _ma_above(20, 60)},
    "d02_d34_ma_ge_or_crossing": {
        "ma5_ge_ma10_or_crossing": _ma_cross(5, 10),
        "ma10_ge_ma30_or_crossing": _ma_cross(10, 30),
    },
    "d03_d26_close_to_ma": {"close_to_ma10_pct": guard("idx >= 9", f"abs(close - {ma(10)}) / {ma(10)}", "1.0")},
    "d04_d27_close_above_ma": {"close_above_ma20": guard("idx >= 19", f"close > {ma(20)}", "false")},
    "d05_d28_close_below_ma": {"close_below_ma10": guard("idx >= 9", f"close < {ma(10)}", "false")},
    "d06_d31_deviation_from_ma": {
        "deviation_from_ma20_pct": guard("idx >= 19", f"(close - {ma(20)}) / {ma(20)}", "0.0")
    },
    "d07_d41_ma_slope": {"ma20_slope": _slope(20), "ma5_slope": _slope(5)},
    "d12_d35_atr": {"atr": _atr(14), "atr_5": _atr(5)},
    "d13_d38_bollinger_width": {
        "bollinger_band_width": _band(20, 2, "width"),
        "bollinger_band_width_10d_std1p5": _band(10, 1.5, "width"),
    },
    "d14_d39_above_bollinger_upper": {
        "price_above_bollinger_upper": _band(20, 2, "above"),
        "price_above_bollinger_upper_10d_std1p5": _band(10, 1.5, "above"),
    },
    "d15_d40_below_bollinger_lower": {
        "price_below_bollinger_lower": _band(20, 2, "below"),
        "price_below_bollinger_lower_10d_std1p5": _band(10, 1.5, "below"),
    },
    "d16_breakout_high": {"breakout_high_20d": guard("idx >= 20", f"close > {over('max(high)', -20, -1)}", "false")},
    "d17_d50_price_position": {"price_position_20d": _position(20), "price_position_52w": _position(250, 20)},
    "d18_d29_d49_volume_ratio": {"volume_ratio_1d_5d": _vratio(5), "volume_ratio_1d_20d": _vratio(20)},
    "d19_d42_momentum": {"momentum_10d": _momentum(10), "momentum_3d": _momentum(3)},
    "d20_d43_avg_volume": {"avg_volume_20d": _avgvol(20)},
    "d21_d46_days_since_high": {"days_since_high_20d": _since(20, "high", "max")},
    "d22_d47_days_since_low": {"days_since_low_20d": _since(20, "low", "min")},
    "d23_d51_volatility": {"volatility_20d": _vol(20), "volatility_10d": _vol(10)},
    "d32_stop_signal": {"has_stop_signal": guard("idx >= 1", f"({_HAMMER} OR {_ENGULF})", "false")},
    "d33_volume_shrink_then_rise": {
        "volume_shrink_then_rise": guard(
            "idx >= 3",
            f"({lag('volume', 3)} > {lag('volume', 2)} AND {lag('volume', 2)} > {lag('volume', 1)}"
            f" AND volume > {lag('volume', 1)})",
            "false",
        )
    },
    "d44_consecutive_up_days": {"consecutive_up_days": _streak(">")},
    "d45_consecutive_down_days": {"consecutive_down_days": _streak("<")},
    "d52_gap_up": {"gap_up_pct": guard("idx >= 1", "(open - pc) / pc", "0.0")},
    "d53_body_to_range": {"body_to_range_ratio": guard("high > low", "abs(close - open) / (high - low)", "0.0")},
}

_WHOLE = ("days_since", "consecutive")
_FLAGS = ("above", "below", "crossing", "breakout", "signal", "shrink", "cross_bullish")


def _sql_column(name: str, expr: str) -> str:
    if name.startswith(_WHOLE) or any(f in name for f in _FLAGS):
        return f"{expr} AS {name}"
    return r(expr, name)


def _register_simple(key: str, columns: dict[str, str]) -> None:
    names = list(columns)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = indicators.with_indicators(t.bars(spark, sf_dir), names)
        return rounded(df.select("symbol", "date", *names))

    QUERIES[key] = run
    SQL[key] = f"{_BASE} SELECT symbol, date, {', '.join(_sql_column(n, e) for n, e in columns.items())} FROM x"


for _key, _columns in _SIMPLE.items():
    _register_simple(_key, _columns)


def _rsi_cte(n: int) -> str:
    d = f"(1.0 - 1.0 / {n})"
    return f"""{_BASE},
g AS (SELECT *, {decayed('greatest(coalesce(close - pc, 0), 0)', d)} AS gain,
             {decayed('greatest(coalesce(pc - close, 0), 0)', d)} AS loss FROM x),
s AS (SELECT *, CASE WHEN idx < {n} THEN 50.0 WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM g)"""


@query("d08_d30_rsi", f"{_rsi_cte(14)} SELECT symbol, date, {r('rsi', 'rsi_14')} FROM s")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.with_indicators(t.bars(spark, sf_dir), ["rsi_14"])
    return rounded(df.select("symbol", "date", "rsi_14"))


_ZMEAN, _ZSTD = over("avg(rsi)", -49, 0), over("stddev_pop(rsi)", -49, 0)


@query(
    "d09_d48_rsi_zscore",
    f"""{_rsi_cte(14)}, z AS (SELECT *, {_ZMEAN} AS m, {_ZSTD} AS sd FROM s)
    SELECT symbol, date, {r('CASE WHEN idx >= 50 AND sd >= 1e-6 THEN (rsi - m) / sd ELSE 0 END', 'rsi_14_zscore')} FROM z""",
)
def rsi_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.with_indicators(t.bars(spark, sf_dir), ["rsi_14_zscore"])
    return rounded(df.select("symbol", "date", "rsi_14_zscore"))


def _macd_cte(f: int, s: int, k: int) -> str:
    def ema(col: str, span: int) -> str:
        a = f"(2.0 / {span + 1})"
        return decayed(f"CASE WHEN idx = 0 THEN {col} ELSE {col} * {a} END", f"(1.0 - {a})")

    return f"""{_BASE},
e AS (SELECT *, {ema('close', f)} - {ema('close', s)} AS line FROM x),
q AS (SELECT *, line - {ema('line', k)} AS hist FROM e),
m AS (SELECT *, {lag('hist')} AS before FROM q)"""


@query(
    "d10_d36_macd_histogram",
    f"{_macd_cte(12, 26, 9)} SELECT symbol, date, {r('CASE WHEN idx >= 33 THEN hist ELSE 0 END', 'macd_histogram')} FROM m",
)
def macd_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.with_indicators(t.bars(spark, sf_dir), ["macd_histogram"])
    return rounded(df.select("symbol", "date", "macd_histogram"))


@query(
    "d11_d37_macd_cross",
    f"""{_macd_cte(12, 26, 9)} SELECT symbol, date,
    coalesce(idx >= 34 AND hist > 0 AND before <= 0, false) AS macd_cross_bullish FROM m""",
)
def macd_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.with_indicators(t.bars(spark, sf_dir), ["macd_cross_bullish"])
    return df.select("symbol", "date", "macd_cross_bullish")


# ── context joins ────────────────────────────────────────────────────────────

_BENCHED = f"{BARS}, {t.SQL_BENCH}"
_RS = "bars.close / lag(bars.close, 20) OVER w - 1 - coalesce(b.close / lag(b.close, 20) OVER w - 1, 0)"


@query(
    "c01_d24_d54_relative_strength_by_date",
    f"""{_BENCHED} SELECT symbol, bars.date, {r(f'CASE WHEN idx >= 20 THEN {_RS} ELSE 0 END', 'relative_strength_20d')}
    FROM bars LEFT JOIN bench b ON b.date = bars.date WINDOW w AS (PARTITION BY symbol ORDER BY bars.date)""",
)
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    joined = context.join_benchmark(b, src.benchmark_from_bars(b))
    df = indicators.with_indicators(joined, ["relative_strength_20d"])
    return rounded(df.select("symbol", "date", "relative_strength_20d"))


@query(
    "c01_relative_strength_by_position",
    f"""{_BENCHED} SELECT symbol, bars.date, {r(f'CASE WHEN idx >= 20 THEN {_RS} ELSE 0 END', 'relative_strength_20d')}
    FROM bars LEFT JOIN bench b ON b.bidx = bars.idx WINDOW w AS (PARTITION BY symbol ORDER BY bars.date)""",
)
def relative_strength_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    joined = context.join_benchmark(b, src.benchmark_from_bars(b), by="position")
    df = indicators.with_indicators(joined, ["relative_strength_20d"])
    return rounded(df.select("symbol", "date", "relative_strength_20d"))


_HEAT = """
sect AS (SELECT sector, row_number() OVER (ORDER BY sum(market_cap) DESC, sector) AS heat_rank,
                sum(market_cap) AS cap, count(*) AS n FROM universe GROUP BY sector)"""


def _sectors(universe: DataFrame) -> DataFrame:
    """Sectors of the universe ranked by traded value; laggards carry the risk flag."""
    caps = universe.groupBy(F.col("sector").alias("name")).agg(
        F.sum("market_cap").alias("cap"), F.count("*").alias("n")
    )
    # one row per sector
    w = Window.orderBy(F.col("cap").desc(), "name")
    ranked = caps.withColumn("heat_rank", F.row_number().over(w))
    return ranked.select(
        "name",
        "heat_rank",
        (F.col("cap") - 1e7 * F.col("n")).alias("net_inflow"),
        F.col("n").cast("int").alias("rising_days"),
        (F.col("n") + 1).cast("int").alias("net_inflow_days"),
        (F.col("heat_rank") > 20).alias("risk_flag"),
    )


@query(
    "c03_d55_d66_universe_and_sector_context",
    f"""{BARS}, {t.SQL_UNIVERSE}, {_HEAT}
    SELECT bars.symbol, bars.date, coalesce(is_st, false) AS st_flag, heat_rank AS sector_heat_rank,
           n AS sector_heat_rising_days, n + 1 AS sector_net_inflow_days,
           cap - 1e7 * n > 0 AS sector_fund_flow_positive, heat_rank > 20 AS sector_risk_flag
    FROM bars LEFT JOIN universe USING (symbol) LEFT JOIN sect USING (sector)""",
)
def sector_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.universe(spark, sf_dir)
    df = context.join_sectors(context.join_universe(t.bars(spark, sf_dir), u), _sectors(u))
    names = [
        "st_flag",
        "sector_heat_rank",
        "sector_heat_rising_days",
        "sector_net_inflow_days",
        "sector_fund_flow_positive",
        "sector_risk_flag",
    ]
    return indicators.with_indicators(df, names).select("symbol", "date", *names)


# ── events ───────────────────────────────────────────────────────────────────

_EVENTS = f"""{BARS},
e0 AS (SELECT *, coalesce({lag('close')}, close) AS pv, {over('avg(volume)', -5, -1)} AS vb FROM bars),
e1 AS (SELECT *, coalesce(volume / nullif(vb, 0), 1.0) AS vr, coalesce((open - pv) / nullif(pv, 0), 0) AS gap,
              coalesce((close - pv) / nullif(pv, 0), 0) AS day, coalesce((close - open) / nullif(open, 0), 0) AS intra FROM e0),
e2 AS (SELECT *, (abs(gap) >= 0.025 OR abs(day) >= 0.045) AND vr >= 1.5 AS flag,
              least(1.0, greatest(0.0, 0.5 + gap * 4 + intra * 2)) AS mood FROM e1),
e3 AS (SELECT *, last_value(CASE WHEN flag THEN {{'i': idx, 'm': mood, 'b': CASE WHEN pv > 0 THEN pv ELSE close END}} END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM e2),
e4 AS (SELECT symbol, date, idx, close, day, e.i AS hit, e.m AS m, coalesce(e.b, close) AS base, CASE WHEN e IS NULL THEN 999 ELSE idx - e.i END AS age FROM e3),
ev AS (SELECT symbol, date, idx,
       round(CASE WHEN hit IS NULL THEN 0.0 ELSE least(1.0, least(1.0, greatest(0.0, (0.5 - m) * 2)) * greatest(0.0, 1 - age / 5.0)
             + greatest(0.0, -day) * 2) END, 6) + 0.0 AS negative_news_score,
       round(CASE WHEN hit IS NULL THEN 1.0 ELSE 0.5 + (m - 0.5) * greatest(0.0, 1 - age / 5.0) END, 6) + 0.0 AS news_sentiment_score,
       round(base, 6) + 0.0 AS pre_event_close, age AS days_since_event, close >= base AS price_above_pre_event,
       age <= 5 AND (close - base) / base >= 0.12 AS already_overreacted FROM e4)"""
_EVENT_NAMES = (
    "negative_news_score, news_sentiment_score, pre_event_close, days_since_event, price_above_pre_event, already_overreacted"
)


_EVENT_SELECT = f"""{r('negative_news_score', 'negative_news_score')}, {r('news_sentiment_score', 'news_sentiment_score')},
  {r('pre_event_close', 'pre_event_close')}, days_since_event, price_above_pre_event, already_overreacted"""


@query("d67_c04_event_proxies", f"{_EVENTS} SELECT symbol, date, {_EVENT_SELECT} FROM ev")
def event_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events.with_event_proxies(t.bars(spark, sf_dir))
    return rounded(df.select("symbol", "date", *_EVENT_NAMES.split(", ")))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_NEWS = f"""
news AS (SELECT doc_id % (SELECT count(*) FROM supplier) AS symbol,
                CAST(DATE '1998-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date, source AS title, text AS summary FROM documents),
words AS (SELECT symbol, date, list_distinct(regexp_split_to_array(lower(title || ' ' || summary), '\\s+')) AS w FROM news),
hits AS (SELECT symbol, date, len(list_intersect(w, {_sql_list(events.POSITIVE_WORDS)})) AS pos,
                len(list_intersect(w, {_sql_list(events.NEGATIVE_WORDS)})) AS neg FROM words),
scored AS (SELECT symbol, date, CASE WHEN pos + neg = 0 THEN 0.5 ELSE 0.5 + 0.5 * (pos - neg) / (pos + neg) END AS s FROM hits),
perday AS (SELECT symbol, date, avg(s) AS s FROM scored GROUP BY symbol, date),
nev AS (SELECT symbol, date, round(1 - s, 3) + 0.0 AS negative_news_score, round(s, 3) + 0.0 AS news_sentiment_score,
               date - min(date) OVER (PARTITION BY symbol) AS days_since_event FROM perday)"""


@query(
    "a11_news_word_events",
    f"""WITH {_NEWS} SELECT symbol, date, {r('negative_news_score', 'negative_news_score')},
    {r('news_sentiment_score', 'news_sentiment_score')}, days_since_event FROM nev""",
)
def news_word_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.news_events(t.news(spark, sf_dir)))


def _contains_count(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(txt, '{w}') AS INT)" for w in words)


@query(
    "a12_news_keyword_events",
    f"""WITH {_NEWS}, k AS (SELECT symbol, date, {_contains_count(events.POSITIVE_WORDS)} AS pos,
        {_contains_count(events.NEGATIVE_WORDS)} AS neg FROM (SELECT *, title || ' ' || summary AS txt FROM news)),
    sc AS (SELECT symbol, date,
        round(CASE WHEN neg > 0 THEN least(1, greatest(0, 0.15 + neg * 0.2 - pos * 0.05)) ELSE least(1, greatest(0, 0.10 - pos * 0.03)) END, 4) AS b,
        round(least(1, greatest(0, 0.5 + pos * 0.12 - neg * 0.15)), 4) AS g FROM k)
    SELECT symbol, date, {r('max(b)', 'negative_news_score', 4)}, {r('avg(g)', 'news_sentiment_score', 4)}, 0 AS days_since_event
    FROM sc GROUP BY symbol, date""",
)
def news_keyword_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.keyword_events(t.news(spark, sf_dir), events.POSITIVE_WORDS, events.NEGATIVE_WORDS)
    return rounded(got, 4)


_MERGED = f"""{_EVENTS}, {_NEWS},
merged AS (SELECT ev.symbol, ev.date, coalesce(nev.negative_news_score, ev.negative_news_score) AS negative_news_score,
       coalesce(nev.news_sentiment_score, ev.news_sentiment_score) AS news_sentiment_score,
       coalesce(nev.days_since_event, ev.days_since_event) AS days_since_event,
       ev.pre_event_close, ev.price_above_pre_event, ev.already_overreacted,
       CASE WHEN count(nev.date) OVER p = 0 THEN 'proxy' WHEN count(nev.date) OVER p = count(*) OVER p THEN 'news' ELSE 'news+proxy' END AS event_source
  FROM ev LEFT JOIN nev ON nev.symbol = ev.symbol AND nev.date = ev.date WINDOW p AS (PARTITION BY ev.symbol))"""


def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.merge_events(t.bars(spark, sf_dir), events.news_events(t.news(spark, sf_dir)), source="news")


@query("c02_d59_d64_d68_merged_events", f"{_MERGED} SELECT symbol, date, {_EVENT_SELECT}, event_source FROM merged")
def merge_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = merged_events(spark, sf_dir)
    return rounded(df.select("symbol", "date", *_EVENT_NAMES.split(", "), "event_source"))


# ── regimes and market context ───────────────────────────────────────────────


def regime_sql(source: str, part: str, vol: float) -> str:
    w = f"({part} ORDER BY date"
    return f"""
rg0 AS (SELECT *, row_number() OVER {w}) AS n, lag(close) OVER {w}) AS pc0,
  avg(close) OVER {w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ms, avg(close) OVER {w} ROWS BETWEEN 23 PRECEDING AND 4 PRECEDING) AS ms4,
  avg(close) OVER {w} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ml, max(close) OVER {w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS top FROM {source}),
rg1 AS (SELECT *, avg(greatest(high - low, abs(high - pc0), abs(low - pc0))) OVER {w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS atr20,
  (ms - ms4) / (ms4 * 5) AS slope, (top - close) / top AS fall, close > ml AS above FROM rg0),
rg AS (SELECT *, CASE WHEN n < 20 THEN NULL WHEN n < 65 THEN 'range_bound' WHEN slope < -0.003 AND fall > 0.10 THEN 'panic'
  WHEN atr20 / close > {vol} THEN 'volatile' WHEN slope > 0.004 AND atr20 / close < {vol} * 0.5 AND above THEN 'euphoria'
  WHEN slope > 0.001 AND above THEN 'trending_up' WHEN slope < -0.001 AND NOT above THEN 'trending_down' ELSE 'range_bound' END AS regime FROM rg1)"""


WIDE = regime.RegimeLimits(volatility=0.10)


@query(
    "d69_d70_symbol_regime",
    f"{BARS}, {regime_sql('bars', 'PARTITION BY symbol', 0.10)} SELECT symbol, date, regime FROM rg",
)
def symbol_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.with_regime(t.bars(spark, sf_dir), ["symbol"], WIDE).select("symbol", "date", "regime")


@query(
    "d70_benchmark_regime_on_bars",
    f"""{_BENCHED}, {regime_sql('bench', 'PARTITION BY 0', 0.03)}
    SELECT bars.symbol, bars.date, rg.regime FROM bars LEFT JOIN rg ON rg.date = bars.date""",
)
def benchmark_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    return context.join_index_regime(b, src.benchmark_from_bars(b)).select("symbol", "date", "regime")


_SHORT = date(1997, 12, 31)
_SHORT_REGIME = f"""{_BENCHED}, early AS (SELECT * FROM bench WHERE date <= '{_SHORT}'), {regime_sql('early', 'PARTITION BY 0', 0.03)}"""


@query(
    "d70_index_regime_past_its_end",
    f"""{_SHORT_REGIME}, la AS (SELECT arg_max(regime, date) AS last_regime, max(date) AS last_date FROM rg)
    SELECT bars.symbol, bars.date, CASE WHEN bars.date > last_date THEN last_regime ELSE rg.regime END AS regime FROM bars CROSS JOIN la LEFT JOIN rg ON rg.date = bars.date""",
)
def regime_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    early = src.benchmark_from_bars(b).where(F.col("date") <= F.lit(_SHORT))
    return context.join_index_regime(b, early).select("symbol", "date", "regime")


@query(
    "d70_index_regime_by_position",
    f"""{_SHORT_REGIME}, po AS (SELECT regime, row_number() OVER (ORDER BY date) - 1 AS pos FROM rg)
    SELECT bars.symbol, bars.date, po.regime FROM bars JOIN po ON po.pos = least(bars.idx, (SELECT max(pos) FROM po))""",
)
def regime_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    early = src.benchmark_from_bars(b).where(F.col("date") <= F.lit(_SHORT))
    return context.join_index_regime(b, early, by="position").select("symbol", "date", "regime")


@query(
    "d71_regime_periods",
    f"""{BARS}, {regime_sql('bars', 'PARTITION BY symbol', 0.10)},
    ends AS (SELECT symbol, date, regime, lag(date, 79) OVER ({W}) AS start, n FROM rg),
    kept AS (SELECT *, CASE WHEN lag(regime) OVER ({W}) = regime THEN 0 ELSE 1 END AS ch FROM ends WHERE n >= 80 AND (n - 80) % 20 = 0),
    runs AS (SELECT *, sum(ch) OVER ({W}) AS period FROM kept)
    SELECT symbol, CAST(period AS BIGINT) AS period, min(start) AS start_date, max(date) AS end_date, first(regime) AS regime
    FROM runs GROUP BY symbol, period""",
)
def regime_periods_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.regime_periods(t.bars(spark, sf_dir), ["symbol"], WIDE, window=80)


_BREADTH = """
br AS (SELECT date, count(*) FILTER (close > prev_close) AS up_count, count(*) FILTER (close < prev_close) AS down_count,
  count(*) FILTER (close = prev_close) AS flat_count, count(*) FILTER ((close - prev_close) / prev_close >= 0.098) AS limit_up_count,
  count(*) FILTER ((close - prev_close) / prev_close <= -0.098) AS limit_down_count FROM bars WHERE prev_close IS NOT NULL GROUP BY date),
breadth AS (SELECT *, round(up_count / nullif(up_count + down_count, 0), 4) AS breadth,
  round(least(1, greatest(0, 0.5 + (up_count / nullif(up_count + down_count, 0) - 0.5) * 0.8
   + (limit_up_count - limit_down_count) / (up_count + down_count + flat_count) * 2)), 4) + 0.0 AS sentiment_index FROM br)"""


@query("a14_market_breadth", f"{BARS}, {_BREADTH} SELECT * REPLACE ({r('breadth', 'breadth', 4)}, {r('sentiment_index', 'sentiment_index', 4)}) FROM breadth")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(context.market_breadth(t.bars(spark, sf_dir)), 4)


_COARSE = """CASE WHEN move IS NULL AND breadth IS NULL THEN NULL
 WHEN coalesce(move, 0) <= -0.025 AND coalesce(breadth, 0.5) <= 0.25 THEN 'panic' WHEN coalesce(move, 0) >= 0.02 AND coalesce(breadth, 0.5) >= 0.75 THEN 'euphoria'
 WHEN coalesce(move, 0) >= 0.008 AND coalesce(breadth, 0.5) >= 0.55 THEN 'trending_up' WHEN coalesce(move, 0) <= -0.008 AND coalesce(breadth, 0.5) <= 0.45 THEN 'trending_down'
 WHEN abs(coalesce(move, 0)) >= 0.018 THEN 'volatile' ELSE 'range_bound' END"""


@query(
    "a15_coarse_regime",
    f"""{_BENCHED}, {_BREADTH}, mv AS (SELECT date, round(close / lag(close) OVER (ORDER BY date) - 1, 4) + 0.0 AS move FROM bench)
    SELECT date, {r('move', 'move', 4)}, {r('breadth', 'breadth', 4)}, {_COARSE} AS regime FROM mv LEFT JOIN breadth USING (date)""",
)
def coarse_regime_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    move = context.market_context(src.benchmark_from_bars(b)).select("date", F.col("index_change_pct").alias("move"))
    df = move.join(context.market_breadth(b).select("date", "breadth"), "date", "left")
    return rounded(df.withColumn("regime", regime.coarse_regime(F.col("move"), F.col("breadth"))), 4)


@query(
    "a16_market_context",
    f"""{_BENCHED}, {t.SQL_UNIVERSE}, {_BREADTH}, {regime_sql('bench', 'PARTITION BY 0', 0.03)},
    mv AS (SELECT date, sector, round(avg((close - prev_close) / prev_close), 9) AS change FROM bars JOIN universe USING (symbol) WHERE prev_close > 0 GROUP BY ALL),
    bd AS (SELECT date, list(sector ORDER BY change DESC, sector)[1:5] AS sector_leaders, list(sector ORDER BY change, sector)[1:5] AS sector_laggards FROM mv GROUP BY date),
    own AS (SELECT date, CASE WHEN lag(close) OVER o > 0 THEN round((close - lag(close) OVER o) / lag(close) OVER o, 4) + 0.0 END AS chg, regime FROM rg WINDOW o AS (ORDER BY date))
    SELECT coalesce(own.date, breadth.date) AS date, {r('chg', 'index_change_pct', 4)}, {r('breadth', 'breadth', 4)}, {r('sentiment_index', 'sentiment_index', 4)},
      coalesce(regime, CASE WHEN breadth IS NULL THEN NULL ELSE 'range_bound' END) AS regime,
      coalesce(bd.sector_leaders, []) AS sector_leaders, coalesce(bd.sector_laggards, []) AS sector_laggards
    FROM own FULL JOIN breadth ON own.date = breadth.date LEFT JOIN bd ON bd.date = coalesce(own.date, breadth.date)""",
)
def market_context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir)
    move = (F.col("close") - F.col("prev_close")) / F.col("prev_close")
    placed = b.where(F.col("prev_close") > 0).join(t.universe(spark, sf_dir).select("symbol", "sector"), "symbol")
    changes = placed.groupBy("date", "sector").agg(F.round(F.avg(move), 9).alias("change_pct"))
    boards = context.leaders_and_laggards(changes)
    got = context.market_context(src.benchmark_from_bars(b), context.market_breadth(b), boards)
    return rounded(got, 4)


# ── preparation ──────────────────────────────────────────────────────────────

START, END = date(1996, 1, 1), date(1997, 12, 31)


@query(
    "a01_prepare_history",
    f"""WITH {t.SQL_BARS},
    seq AS (SELECT symbol, date, arg_max(price, k1 * 1000000 + k3 * 10 + k2) AS close, max(k1 * 1000000 + k3 * 10 + k2) AS top
            FROM (SELECT symbol, date, price, k1, k2, k3 FROM ticks) GROUP BY symbol, date),
    lagged AS (SELECT symbol, date, close, lag(close) OVER ({W}) AS prev_close FROM seq)
    SELECT symbol, date, close, prev_close FROM lagged WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
)
def prepare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.ticks(spark, sf_dir).select(
        "symbol",
        "date",
        *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
        F.col("size").alias("volume"),
        (F.col("k1") * 1000000 + F.col("k3") * 10 + F.col("k2")).alias("seq"),
    )
    got = src.prepare_history(rows, START, END, sequence="seq")
    return got.select("symbol", "date", "close", "prev_close")


@query(
    "a02_normalise_yahoo",
    f"{BARS} SELECT symbol, date, open, high, low, close, volume, prev_close FROM bars",
)
def yahoo_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir).drop("prev_close")
    raw = b.withColumn("date", F.to_timestamp("date")).withColumnsRenamed({v: k for k, v in src.YAHOO_COLUMNS.items()})
    return src.normalise_yahoo(raw)


@query(
    "a03_a04_normalise_renamed",
    f"{BARS} SELECT symbol, date, open, high, low, close, CAST(0 AS DOUBLE) AS volume, prev_close FROM bars",
)
def renamed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir).drop("prev_close", "volume")
    text = b.withColumns({c: F.col(c).cast("string") for c in ("date", "open", "high", "low", "close")})
    chinese = {"date": "日期", "open": "开盘", "high": "最高", "low": "最低", "close": "收盘"}
    return src.normalise_renamed(text.withColumnsRenamed(chinese), coerce=True)


@query(
    "a05_prefer_sources",
    f"""{BARS}, a AS (SELECT symbol, date, close FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)),
    b AS (SELECT symbol, date, close * 2 AS close FROM bars)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""",
)
def prefer_sources_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = t.bars(spark, sf_dir).select("symbol", "date", "close")
    rich = t.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("symbol"))
    first = b.join(rich, "symbol", "left_semi")
    return src.prefer_sources([first, b.withColumn("close", F.col("close") * 2)])


@query("a07_index_history", f"{_BENCHED} SELECT date, {r('close', 'close')}, {r('close', 'open')}, {r('high', 'high')}, {r('low', 'low')} FROM bench")
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.index_history(t.benchmark(spark, sf_dir)))


@query(
    "a09_a06_stored_history",
    f"""{BARS} SELECT symbol, date, open, high, low, close, volume FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
)
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    src.write_history(t.bars(spark, sf_dir), path)
    got = src.read_history(spark, path, START, END)
    return got.select("symbol", "date", "open", "high", "low", "close", "volume")


@query(
    "a10_custom_universe",
    f"WITH {t.SQL_UNIVERSE} SELECT symbol, name, sector FROM universe WHERE market = 'us' AND symbol IN (1, 3, 5, 7)",
)
def custom_universe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = src.custom_universe(t.universe(spark, sf_dir), "us", [1, 3, 5, 7], "us")
    return got.select("symbol", "name", "sector")


@query(
    "a13_sector_rank_match",
    f"""WITH {t.SQL_UNIVERSE} SELECT symbol, sector,
    CASE WHEN sector = 'CHINA' THEN 1 WHEN contains(sector, 'UNITED') THEN 2 WHEN sector = 'FRANCE' THEN 3 WHEN sector = 'GERMANY' THEN 4 END AS heat_rank,
    sector IN ('FRANCE', 'GERMANY') AS risk_flag FROM universe""",
)
def sector_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = t.universe(spark, sf_dir).select("symbol", "sector")
    return context.match_sector_rank(u, ["china", "UNITED"], ["France", "GERMANY"])


@query(
    "a13_board_rank_match",
    f"""WITH {t.SQL_UNIVERSE}, lb AS (SELECT DISTINCT p_name AS name FROM part), words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part),
    bo AS (SELECT name, row_number() OVER (ORDER BY length(name), name) AS heat_rank, length(name) > 5 AS risk_flag FROM words WHERE name <> ''),
    ma AS (SELECT lb.name, arg_min({{'k': heat_rank, 'r': risk_flag}}, heat_rank) AS m FROM lb JOIN bo ON lower(lb.name) = lower(bo.name) OR contains(lb.name, bo.name) OR contains(bo.name, lb.name) GROUP BY lb.name)
    SELECT lb.name AS sector, CAST(m.k AS INT) AS heat_rank, coalesce(m.r, false) AS risk_flag FROM lb LEFT JOIN ma USING (name)""",
)
def board_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against a ranked board of all words in them, both as tables."""
    names = t.table(spark, sf_dir, "part").select(F.col("p_name").alias("sector")).distinct()
    words = names.select(F.explode(F.split("sector", " ")).alias("name")).where("name <> ''").distinct()
    order = Window.orderBy(F.length("name"), "name")
    board = words.select("name", F.row_number().over(order).alias("heat_rank"), (F.length("name") > 5).alias("risk_flag"))
    return context.match_board_rank(names, board)


@query(
    "a13_select_sector_board",
    """SELECT symbol, coalesce(min_by(board, pos) FILTER (kind = 'industry'), min_by(board, pos)) AS sector FROM (
      SELECT l_suppkey AS symbol, p_brand AS board, CASE WHEN p_size > 25 THEN 'industry' ELSE 'concept' END AS kind,
             l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS pos
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol""",
)
def sector_board_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = t.table(spark, sf_dir, "lineitem").join(t.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return context.select_sector(
        boards.select(
            F.col("l_suppkey").alias("symbol"),
            F.col("p_brand").alias("board_name"),
            F.when(F.col("p_size") > 25, "industry").otherwise("concept").alias("board_type"),
            (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"),
        )
    )


@query(
    "a20_data_fingerprint_parts",
    f"{BARS} SELECT symbol, count(*) AS rows, min(date) AS start, max(date) AS end, {r('arg_max(close, date)', 'last_close')} FROM bars GROUP BY symbol",
)
def fingerprint_parts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.fingerprint_rows(t.bars(spark, sf_dir)))


def _digits(x: str) -> str:
    return f"CAST(CAST(round({x} * 1000000) AS BIGINT) AS VARCHAR)"


@query(
    "a20_data_fingerprint",
    f"""{BARS}, h AS (SELECT md5(symbol || '|' || CAST(date AS VARCHAR) || '|' || {" || '|' || ".join(_digits(c) for c in ("open", "high", "low", "close", "volume"))}) AS h FROM bars),
    f AS (SELECT count(*) AS rows, CAST(sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) % 1152921504606846976 AS BIGINT) AS a,
      CAST(sum(('0x' || substr(h, 17, 15))::BIGINT::HUGEINT) % 1152921504606846976 AS BIGINT) AS b FROM h)
    SELECT substr(sha256(rows || '|' || a || '|' || b), 1, 12) AS fingerprint, rows FROM f""",
)
def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.data_fingerprint(t.bars(spark, sf_dir))


@query("a21_date_range", f"{BARS} SELECT min(date) AS start, max(date) AS end FROM bars")
def date_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.date_range(t.bars(spark, sf_dir))


@query(
    "d72_forward_return",
    f"""{BARS} SELECT symbol, date, {r(f'lead(close, 5) OVER ({W}) / close - 1', 'forward_return')} FROM bars""",
)
def forward_return_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tapeloom.operators.factors import forward_return

    df = forward_return(t.bars(spark, sf_dir), 5)
    return rounded(df.select("symbol", "date", F.col("r").alias("forward_return")))


# ── conditions and market rules ──────────────────────────────────────────────

C = spec.Condition


@query(
    "b01_b02_b03_entry_predicate",
    f"""{_rsi_cte(14)} SELECT symbol, date,
    (({_SIMPLE['d01_d25_ma_above']['ma5_above_ma10']}) OR rsi < 30)
     AND ({_SIMPLE['d04_d27_close_above_ma']['close_above_ma20']}) = true AND ({_vratio(5)}) >= 0.8 AS entry FROM s""",
)
def entry_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = spec.Entry(
        triggers=(C("ma5_above_ma10", "==", True), C("rsi_14", "<", 30)),
        logic="or",
        guards=(C("close_above_ma20", "==", True),),
        filters=(C("volume_ratio_1d_5d", ">=", 0.8),),
    )
    names = [c.indicator for c in (*entry.triggers, *entry.guards, *entry.filters)]
    df = indicators.with_indicators(t.bars(spark, sf_dir), names)
    return df.select("symbol", "date", spec.entry_column(entry).alias("entry"))


_LIMIT = """CASE WHEN upper(name) LIKE '%ST %' OR upper(name) LIKE 'ST%' OR contains(name, '*ST') THEN 0.048
  WHEN starts_with(CAST(symbol AS VARCHAR), '688') OR starts_with(CAST(symbol AS VARCHAR), '300') THEN 0.196
  WHEN starts_with(CAST(symbol AS VARCHAR), '8') OR starts_with(CAST(symbol AS VARCHAR), '43') THEN 0.294 ELSE 0.098 END"""


@query(
    "b06_b07_b08_market_rules",
    f"""{BARS}, {t.SQL_UNIVERSE}, m AS (SELECT bars.*, name, {_LIMIT.replace('symbol', 'bars.symbol')} AS lim, (close - prev_close) / prev_close AS mv
      FROM bars LEFT JOIN universe ON universe.symbol = bars.symbol)
    SELECT symbol, date, coalesce(mv >= lim, false) AS limit_up, coalesce(mv <= -lim, false) AS limit_down,
      NOT coalesce(mv >= lim, false) AND volume <> 0 AS can_buy, NOT coalesce(mv <= -lim, false) AND volume <> 0 AS can_sell FROM m""",
)
def market_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = context.join_universe(t.bars(spark, sf_dir), t.universe(spark, sf_dir))
    rules = spec.DEFAULT_RULES["a_share"]
    return df.select(
        "symbol",
        "date",
        spec.is_limit_up(df.columns).alias("limit_up"),
        spec.is_limit_down(df.columns).alias("limit_down"),
        spec.buy_allowed(rules, df.columns).alias("can_buy"),
        spec.sell_allowed(rules, df.columns).alias("can_sell"),
    )


@query(
    "s01_symbol_rules",
    r"""WITH k AS (SELECT s_suppkey AS key, lpad(CAST(s_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS c FROM supplier),
    s AS (SELECT key, CASE key % 6 WHEN 0 THEN c WHEN 1 THEN 'sz' || c WHEN 2 THEN c || '.SH' WHEN 3 THEN ' SH' || c || '.ss ' WHEN 4 THEN 'SZSH' || c ELSE 'AB' || c END AS raw FROM k),
    p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '\.SZ$', ''), '\.SS$', ''), '\.SH$', '') AS a FROM s),
    q AS (SELECT key, raw, regexp_replace(regexp_replace(regexp_replace(a, '^SZ(.+)', '\1'), '^SH(.+)', '\1'), '^SS(.+)', '\1') AS code FROM p)
    SELECT key, raw, code, CASE WHEN regexp_full_match(code, '[0-9]{6}') THEN code || CASE WHEN code[1] IN ('6', '9') THEN '.SS' ELSE '.SZ' END ELSE code END AS listed FROM q""",
)
def symbol_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier numbers written the ways codes come in, brought to one form."""
    key = F.col("s_suppkey")
    c = F.lpad((key * 7919 % 1000000).cast("string"), 6, "0")
    raw = (
        F.when(key % 6 == 0, c)
        .when(key % 6 == 1, F.concat(F.lit("sz"), c))
        .when(key % 6 == 2, F.concat(c, F.lit(".SH")))
        .when(key % 6 == 3, F.concat(F.lit(" SH"), c, F.lit(".ss ")))
        .when(key % 6 == 4, F.concat(F.lit("SZSH"), c))
        .otherwise(F.concat(F.lit("AB"), c))
    )
    named = t.table(spark, sf_dir, "supplier").select(key.alias("key"), raw.alias("raw"))
    coded = named.withColumn("code", src.plain_code(F.col("raw")))
    return coded.withColumn("listed", src.exchange_code(F.col("code")))
