"""Sources, indicators and context on small tables."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from market import market, walk
from tapeloom.functions import indicators
from tapeloom.functions.spec import Condition, Entry, condition_column, entry_column, warmup_bars
from tapeloom.operators import baselines, factors, sampling
from tapeloom.sources import bars as src

WARMUP = {
    "ma5_above_ma10": False,
    "close_to_ma10_pct": 1.0,
    "rsi_14": 50.0,
    "rsi_14_zscore": 0.0,
    "macd_histogram": 0.0,
    "macd_cross_bullish": False,
    "bollinger_band_width": 0.1,
    "breakout_high_20d": False,
    "price_position_20d": 0.5,
    "price_position_52w": 0.5,
    "volume_ratio_1d_5d": 1.0,
    "momentum_10d": 0.0,
    "days_since_high_20d": 0,
    "volatility_20d": 0.0,
    "relative_strength_20d": 0.0,
    "ma20_slope": 0.0,
    "consecutive_up_days": 0,
    "gap_up_pct": 0.0,
    "has_stop_signal": False,
    "days_since_event": 999,
    "sector_heat_rank": 1,
    "sector_net_inflow_days": 99,
    "sector_fund_flow_positive": True,
    "st_flag": False,
}


def test_warmup_defaults(spark):
    df = spark.createDataFrame(walk("A", 3, 1))
    first = indicators.with_indicators(df, list(WARMUP)).orderBy("date").first()
    assert {k: first[k] for k in WARMUP} == WARMUP


def test_smoothed_indicators_match_pandas(spark):
    pdf = walk("A", 700, 5)
    got = indicators.with_indicators(spark.createDataFrame(pdf), ["rsi_2", "rsi_14", "macd_histogram"]).toPandas()
    got = got.sort_values("date").reset_index(drop=True)
    move = pdf.close.diff().iloc[1:]
    for n in (2, 14):
        up = move.clip(lower=0).ewm(com=n - 1).mean()
        down = (-move.clip(upper=0)).ewm(com=n - 1).mean()
        want = 100 - 100 / (1 + up / down)
        assert np.allclose(got[f"rsi_{n}"][n:], want[n - 1 :], atol=1e-9)
    line = pdf.close.ewm(span=12, adjust=False).mean() - pdf.close.ewm(span=26, adjust=False).mean()
    hist = line - line.ewm(span=9, adjust=False).mean()
    assert np.allclose(got["macd_histogram"][33:], hist[33:], atol=1e-9)


def test_names_resolve():
    assert indicators.is_registered("ma7_above_ma33")
    assert indicators.is_registered("bollinger_band_width_20d_std1p5")
    assert not indicators.is_registered("macd_histogram_fast26_slow12_signal9")
    assert not indicators.is_registered("ma0_slope")
    assert len(indicators.available()) >= 42


def test_dynamic_factor(spark):
    indicators.register_dynamic("spread", lambda: (F.col("high") - F.col("low")) / F.col("close"))
    try:
        got = indicators.with_indicators(spark.createDataFrame(walk("A", 5, 1)), ["spread"]).first()
        assert got.spread == pytest.approx((got.high - got.low) / got.close)
    finally:
        indicators.unregister_dynamic("spread")
    assert "spread" not in indicators.dynamic_names()


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, True), (None, None)], "atr double, st_flag boolean")
    checks = [
        condition_column(Condition("atr", ">", 0)),
        condition_column(Condition("atr", "==", True)),
        condition_column(Condition("st_flag", "==", 1)),
        condition_column(Condition("atr", "~", 0)),
        entry_column(Entry()),
    ]
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(checks)]).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, False, True), (False, False, False, False, True)]


def test_warmup_bars():
    assert warmup_bars(["ma5_above_ma10"]) == 30
    assert warmup_bars(["close_above_ma60"]) == 75
    assert warmup_bars(["rsi_14"]) == 30
    assert warmup_bars(["macd_histogram"]) == 70


def test_prepare_keeps_last_and_previous_close(spark):
    rows = [("A", "2024-01-01", 1.0, 1), ("A", "2024-01-02", 2.0, 2), ("A", "2024-01-02", 3.0, 3), ("A", "2024-01-03", 4.0, 4)]
    df = spark.createDataFrame(rows, "symbol string, date string, close double, seq int")
    for c in ("open", "high", "low", "volume"):
        df = df.withColumn(c, F.col("close"))
    got = src.prepare_history(df, date(2024, 1, 2), date(2024, 1, 3), sequence="seq").orderBy("date").collect()
    assert [(r.close, r.prev_close) for r in got] == [(3.0, 1.0), (4.0, 3.0)]
    with pytest.raises(ValueError):
        src.prepare_history(df.drop("open"))
    with pytest.raises(ValueError):
        src.clip_dates(df, date(2024, 2, 1), date(2024, 1, 1))


def test_missing_columns_give_an_empty_table(spark):
    df = spark.createDataFrame([("A", "2024-01-01", 1.0)], "symbol string, `日期` string, `收盘` double")
    assert src.normalise_renamed(df).count() == 0


def test_lookback_start():
    assert src.lookback_start(date(2024, 6, 1), 10) == date(2024, 4, 2)
    assert (date(2024, 6, 1) - src.lookback_start(date(2024, 6, 1), 100)).days == 160


def test_leak_check_passes_a_causal_factor(spark):
    df = spark.createDataFrame(market(2, 60))

    def causal(b):
        return indicators.with_indicators(b, ["momentum_10d"])

    assert factors.leak_check(df, causal, "momentum_10d", F.lit(date(2023, 2, 10))).count() == 0


def test_samples(spark):
    rows = [(f"S{i}", "tech" if i % 3 else "bank", float(i + 1), i == 0) for i in range(90)]
    u = spark.createDataFrame(rows, "symbol string, sector string, market_cap double, is_st boolean")
    got = sampling.representative(u, sampling.Limits(30, 10)).collect()
    assert len(got) == 30 and len({r.symbol for r in got}) == 30 and "S0" not in {r.symbol for r in got}
    again = sampling.representative(u, sampling.Limits(30, 10)).collect()
    assert {r.symbol for r in got} == {r.symbol for r in again}
    one = sampling.representative(u.where("sector = 'bank'"), sampling.Limits(30, 10)).collect()
    assert len(one) == 29
    picks = [sampling.evenly_spaced(F.lit(p), F.lit(10), F.lit(4)) for p in range(10)]
    row = u.select(*[c.alias(str(i)) for i, c in enumerate(picks)]).first()
    assert [i for i in range(10) if row[i]] == [0, 2, 5, 7]
    assert sampling.apply_filters(u.withColumn("pe", F.lit(None).cast("double")), [("pe", "<", 3.0)]).count() == 90


def test_evenly_spaced_picks_as_many_as_asked(spark):
    pairs = spark.range(1, 200).selectExpr("id AS size").selectExpr("size", "explode(sequence(1L, size)) AS n")
    picks = pairs.selectExpr("size", "n", "explode(sequence(0L, size - 1)) AS pos").where(
        sampling.evenly_spaced(F.col("pos"), F.col("size"), F.col("n"))
    )
    want = pairs.selectExpr("size", "n", "explode(transform(sequence(0L, n - 1), i -> cast(floor(i * (size / n)) AS long))) AS pos")
    assert picks.exceptAll(want).isEmpty() and want.exceptAll(picks).isEmpty()


def test_lineage_reports_circles(spark):
    from tapeloom.operators.lineage import lineage

    rows = [("f", f"n{i}", f"n{i - 1}" if i else None) for i in range(9)] + [("f", "x", "y"), ("f", "y", "x"), ("f", "z", "y"), ("g", "s", "s")]
    got = {(r.family, r.id): (r.root_id, r.depth) for r in lineage(spark.createDataFrame(rows, "family string, id string, parent_id string")).collect()}
    assert all(got["f", f"n{i}"] == ("n0", i) for i in range(9))
    assert [got[k] for k in (("f", "x"), ("f", "y"), ("f", "z"), ("g", "s"))] == [(None, None)] * 4


def test_exit_grid_keeps_other_stops():
    from dataclasses import replace

    from tapeloom.functions.spec import Stop
    from tapeloom.operators import sweep
    from tapeloom.plans.trade_queries import BASE

    for stop in (Stop("pct_from_low", 0.08), Stop("price_level", 95.0)):
        grid = sweep.exit_candidates(replace(BASE, exit=replace(BASE.exit, stop=stop)))
        assert grid[0].strategy.exit.stop == stop and grid[0].changes == ("baseline",)
        assert {c.strategy.exit.stop.type for c in grid} == {stop.type, "pct"}
        assert len({c.changes for c in grid}) == len(grid)


def test_random_baseline_is_centred_on_the_pool(spark):
    bars = spark.createDataFrame(market(4, 150))
    taken = spark.createDataFrame([(0.01, 3)] * 200, "return_pct double, holding_days int")
    pool = baselines.random_pool(bars, taken).agg(F.avg("r"), F.stddev("r")).first()
    got = baselines.random_baseline(bars, taken, sims=60).first()
    assert got.n_simulations == 60
    assert abs(got.random_mean - pool[0]) < 4 * pool[1] / (200 * 60) ** 0.5
    assert got.ci_lower < got.random_mean < got.ci_upper


def test_tasks_of_whole_symbols_stay_small(spark, tmp_path, monkeypatch):
    from tapeloom import runtime
    from tapeloom.plans import tables
    from tapeloom.plans.trade_queries import rich_bars

    nations = spark.createDataFrame([(0, "PERU")], "n_nationkey int, n_name string")
    suppliers = spark.createDataFrame([(i, f"s{i}", 0) for i in range(60)], "s_suppkey long, s_name string, s_nationkey int")
    lines = [(100 * i + d, i, 1, d % 7, date(1995, 1, 1) + timedelta(days=d), 10.0, 1000.0 + i + d) for i in range(60) for d in range(20)]
    items = spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_shipdate date, l_quantity double, l_extendedprice double")
    for name, df in (("nation", nations), ("supplier", suppliers), ("lineitem", items)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    monkeypatch.setattr(runtime, "TASK_ROWS", 40)
    got = rich_bars(spark, str(tmp_path))
    held = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    # 1,200 bars in 30 tasks; Spark alone puts so few bytes into one
    assert sum(r["count"] for r in held) == 1200 and max(r["count"] for r in held) <= 200
    cols = ["symbol", "date", "close", "prev_close"]
    assert sorted(map(tuple, tables.bars_by_symbol(spark, str(tmp_path)).select(cols).collect()), key=lambda x: x[:2]) == sorted(
        map(tuple, tables.bars(spark, str(tmp_path)).select(cols).collect()), key=lambda x: x[:2]
    )
