"""Look-back, widened reads, ladders, digests, purged paths and boards against plain versions."""

from __future__ import annotations

from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from market import market
from tapeloom.functions import context, events, indicators
from tapeloom.functions.indicators import WHOLE_HISTORY, lookback, with_indicators
from tapeloom.functions.spec import Condition, Entry, Exit, Stop, Strategy
from tapeloom.operators import book, ranking, robust, sampling, trades
from tapeloom.sources import bars as src

NAMES = ["ma20_slope", "atr", "atr_5", "rsi_14", "rsi_14_zscore", "macd_histogram", "macd_cross_bullish", "volatility_20d", "days_since_high_20d", "momentum_10d", "breakout_high_20d", "volume_ratio_1d_5d"]


def test_lookback_adds_up_along_chains(spark):
    assert lookback(["ma20_slope"]) == 24  # 20 bars, five earlier
    assert lookback(["ma5_above_ma10", "close_above_ma20"]) == 19
    assert lookback(["atr_14"]) == 14  # 14 ranges, each against the close before
    assert lookback(["volatility_20d"]) == 19
    assert lookback(["gap_up_pct"]) == 1 and lookback(["body_to_range_ratio"]) == 0
    assert lookback(["rsi_14_zscore"]) == lookback(["rsi_14"]) + 49
    assert lookback(["consecutive_up_days"]) == WHOLE_HISTORY
    with pytest.raises(ValueError):
        lookback(["nope"])


def test_widened_read_gives_the_values_of_the_whole(spark, tmp_path):
    pdf = market(3, 1400).drop(columns=["prev_close"])
    pdf = pdf[~((pdf.symbol == "S1") & (np.arange(len(pdf)) % 3 > 0))]  # a symbol with gaps
    bars = spark.createDataFrame(pdf)
    path = f"file://{tmp_path}/bars"
    src.write_history(bars, path)
    start, end = date(2026, 1, 5), date(2026, 3, 1)
    inside = F.col("date").between(start, end)
    whole = {(r.symbol, r.date): r for r in with_indicators(bars, NAMES).where(inside).collect()}
    part = src.read_widened(spark, path, start, end, lookback(NAMES))
    got = with_indicators(part, NAMES).where(inside).collect()
    assert len(got) == len(whole) > 50
    for r in got:
        for n in NAMES:
            assert r[n] == pytest.approx(whole[r.symbol, r.date][n], rel=1e-9, abs=1e-9), n
    few = src.read_widened(spark, path, start, end, 10)
    assert few.groupBy("symbol").agg(F.count_if(F.col("date") < F.lit(start)).alias("n")).where("n <> 10").count() == 0
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan and few.agg(F.min("date")).first()[0] > date(2025, 11, 1)
    assert src.read_widened(spark, path, start, end, 0).agg(F.min("date")).first()[0] >= start
    assert src.read_widened(spark, path, start, end, WHOLE_HISTORY).agg(F.min("date")).first()[0] == date(2023, 1, 2)


def _ladder(pool, signals, ladder, start, end):
    """The tries one after the other."""
    out, have = [], set()
    for k in range(ladder.steps + 1):
        order = sorted(pool, key=lambda r: (r[1], r[0])) if k < 2 else sorted(pool, key=lambda r: (-r[1], r[0]))
        have |= {r[0] for r in order[: ladder.size(k)]}
        first = start - timedelta(days=k * ladder.more_days)
        n = sum(s in have and first <= d <= end for s, d in signals)
        out.append((k, len(have), n))
    return out


@pytest.mark.parametrize("goal", [1, 12, 40, 10_000])
def test_ladder_equals_tries_one_by_one(spark, goal):
    rng = np.random.default_rng(4)
    pool = [(f"s{i}", float(rng.random())) for i in range(25)]
    start, end = date(2024, 1, 1), date(2024, 3, 1)
    signals = [(f"s{rng.integers(30)}", end + timedelta(days=int(rng.integers(-200, 20)))) for _ in range(150)]
    ladder = sampling.Ladder(steps=3, symbols=4, more_symbols=5, more_days=30, signals=goal)
    df = spark.createDataFrame(pool, "symbol string, score double")
    orders = [F.col("score"), F.col("score"), -F.col("score")]
    got = sampling.expand(df, spark.createDataFrame(signals, "symbol string, signal_date date"), orders, start, end, ladder).orderBy("step").collect()
    want = _ladder(pool, signals, ladder, start, end)
    assert [(r.step, r.symbols, r.signals) for r in got] == want
    chosen = next((k for k, _, n in want if n >= goal), ladder.steps)
    assert [r.step for r in got if r.chosen] == [chosen] and [r.reached for r in got] == [n >= goal for _, _, n in want]
    sample = sampling.expanded_sample(df, spark.createDataFrame(got), orders, ladder)
    assert sample.count() == want[chosen][1]


def test_digests_merge_and_take_back(spark):
    pdf = market(3, 900)
    bars = spark.createDataFrame(pdf).repartition(5)
    old, new = bars.where("date < '2024-06-01'"), bars.where("date >= '2024-06-01'")
    whole = src.data_fingerprint(bars).first()
    both = src.merged_digests(src.bar_digests(old), src.bar_digests(new))
    assert src.fingerprint(both).first() == whole and both.count() == 3
    assert src.fingerprint(src.merged_digests(both, less=src.bar_digests(new))).first() == src.data_fingerprint(old).first() != whole
    assert src.data_fingerprint(bars.withColumn("close", F.when(F.col("symbol") == "S0", F.col("close") + 0.01).otherwise(F.col("close")))).first() != whole
    assert src.data_fingerprint(bars.limit(0)).first().rows == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_purged_paths_of_any_choice(spark, k):
    rng = np.random.default_rng(k)
    # days close together, so that zones meet and groups share days
    rows = [("a" if i % 3 else "b", f"s{i % 7}", i, date(2024, 1, 1) + timedelta(days=int(d)), float(rng.normal())) for i, d in enumerate(np.sort(rng.integers(0, 60, 240)))]
    got = {}
    trades = spark.createDataFrame(rows, "key string, symbol string, signal_idx int, signal_date date, return_pct double")
    for r in robust.cpcv_paths(trades, ["key"], test_groups=k, purge_days=3).collect():
        got[r.key, tuple(r[f"g{i + 1}"] for i in range(k))] = (r.train_n, r.test_n, round(r.train_win_rate, 9), round(r.test_win_rate, 9))
    want = {}
    for key in "ab":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1], r[2]))
        size = len(mine) // 6
        parts = [mine[i * size : (i + 1) * size if i < 5 else None] for i in range(6)]
        for tested in combinations(range(6), k):
            zones = [(parts[i][0][3] - timedelta(days=3), parts[i][-1][3] + timedelta(days=3)) for i in tested]
            test = [r for i in tested for r in parts[i]]
            train = [r for i in set(range(6)) - set(tested) for r in parts[i] if not any(a <= r[3] <= b for a, b in zones)]
            if len(train) >= 5 and len(test) >= 5:
                want[key, tested] = (len(train), len(test), round(np.mean([r[4] > 0 for r in train]), 9), round(np.mean([r[4] > 0 for r in test]), 9))
    assert got == want and (want or k == 5)


def test_board_match_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    names = list({"".join(rng.choice(list("abAB "), rng.integers(0, 9))) for _ in range(120)}) + [None, "ab", "Zz"]
    board = list({"".join(rng.choice(list("abAB "), rng.integers(0, 6))) for _ in range(60)}) + ["zZ"]
    got = context.match_board_rank(
        spark.createDataFrame([(n,) for n in names], "sector string"),
        spark.createDataFrame([(n, i, i % 2 == 1) for i, n in enumerate(board)], "name string, heat_rank int, risk_flag boolean"),
    ).collect()
    assert len(got) == len(names)
    for r in got:
        n = r.sector
        hits = [i for i, b in enumerate(board) if n and b and (n.lower() == b.lower() or n in b or b in n)]
        assert (r.heat_rank, r.risk_flag) == ((min(hits), min(hits) % 2 == 1) if hits else (None, False)), n


def test_exposure_sweep_equals_a_walk_over_days(spark):
    rng = np.random.default_rng(1)
    rows = [(date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 40))), 100.0, float(rng.normal(100, 5)) if i % 9 else None, int(rng.integers(0, 12))) for i in range(60)]
    trades = spark.createDataFrame(rows, "signal_date date, entry_price double, exit_price double, holding_days int")
    got = {r.date: r for r in book.exposure_curve(trades).collect()}
    assert set(got) == {r[0] for r in rows}

    def weekdays_after(d, n):
        while n:
            d += timedelta(days=1)
            n -= d.weekday() < 5
        return d

    for day, r in got.items():
        equity, live = 100_000.0, 0
        for opened, entry, out, hold in rows:
            if opened > day:
                continue
            until = weekdays_after(opened, hold) if hold > 0 else None
            live += until is None or day < until
            part = min(1.0, (day - opened).days / max(1, hold)) if hold > 0 and out is not None else 0.0
            equity += 10_000 / entry * part * ((out or entry) - entry)
        assert r.positions_open == live and r.equity == pytest.approx(equity, abs=1e-6)


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/store"

    def rows(ids, when, score):
        return spark.createDataFrame([(f"e{i}", score + i, f"j{i}-{when}", when) for i in ids], "id string, confidence_score double, json_content string, created_at long")

    def files():
        return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "store/base").rglob("*.parquet")}

    ranking.append_evaluations(rows(range(40), 1, 0.0), path, buckets=8)
    assert ranking.read_evaluations(spark, path).count() == 40
    assert ranking.compact_evaluations(spark, path, buckets=8) == list(range(8))
    before = files()
    ranking.append_evaluations(rows([3, 50], 5, 100.0), path, buckets=8)
    ranking.append_evaluations(rows([3], 4, 200.0), path, buckets=8)  # older than what is stored by now
    want = {(f"e{i}", float(i), 1) for i in range(40) if i != 3} | {("e3", 103.0, 1), ("e50", 150.0, 5)}
    for _ in range(2):
        got = {(r.id, r.confidence_score, r.created_at) for r in ranking.read_evaluations(spark, path).collect()}
        assert got == want
        touched = ranking.compact_evaluations(spark, path, buckets=8)
    assert touched == []
    after = files()
    changed = {k.split("bucket=")[1].split("/")[0] for k in before.keys() ^ after.keys()}
    assert 1 <= len(changed) <= 2
    ranking.append_evaluations(rows([3], 4, 300.0), path, buckets=8)  # late and older: the stored score stays
    assert ranking.read_evaluations(spark, path).where("id = 'e3'").first().confidence_score == 103.0


def test_registered_indicators_resolve_by_name(spark):
    @indicators.register("twice_close")
    def _twice(plan):
        return F.col("close") * 2, 0

    assert indicators.is_registered("twice_close") and "twice_close" in indicators.available()
    assert {"rsi_14", "atr", "gap_up_pct", "has_stop_signal"} <= set(indicators.available())
    assert not indicators.is_registered("ma0_above_ma5") and not indicators.is_registered("macd_histogram_fast9_slow5_signal3")
    row = with_indicators(spark.createDataFrame(market(1, 40)), ["twice_close"]).first()
    assert row.twice_close == 2 * row.close


def test_gates_of_a_fast_pass(spark):
    row = spark.createDataFrame([(0.4, 10, 0.3, 0.2)], "win_rate double, signal_count int, train_val_gap double, max_drawdown double")
    fast = ranking.gate_reasons(min_win_rate=0.5, min_signals=30, max_drawdown=0.5, max_train_val_gap=0.1, full=False)
    full = ranking.gate_reasons(min_win_rate=0.5, min_signals=30, max_drawdown=0.5, max_train_val_gap=0.1)
    got = row.select(fast.alias("a"), full.alias("b"), ranking.gate_reasons(full=False).alias("c")).first()
    assert got.a == ["win_rate<50.0%", "signals<30", "full_eval_required_for_robust_gates"]
    assert got.b == ["win_rate<50.0%", "signals<30", "train_val_gap>10.0%"] and got.c == []


def test_silent_choices_are_errors(spark):
    bars = spark.createDataFrame(market(1, 40))
    with pytest.raises(Exception, match="a day repeats"):
        src.prepare_history(bars.union(bars.limit(1))).collect()
    assert src.prepare_history(bars).count() == 40
    one = bars.limit(1).select("symbol", "date", F.lit(0.5).alias("news_sentiment_score"))
    other = one.withColumn("news_sentiment_score", F.lit(0.7))
    assert events.merge_events(bars, one.union(one)).count() == 40
    with pytest.raises(Exception, match="no sequence is given"):
        events.merge_events(bars, one.union(other)).collect()
    gated = Strategy("g", Entry(conditions=(Condition("momentum_3d", ">", 0.0),)), Exit(Stop("pct", 0.05)), preferred_regimes=("trending_up",))
    with pytest.raises(ValueError, match="regime"):
        trades.entry_flags(bars, gated)
