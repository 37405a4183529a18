"""Ordered scans equal plain windows: a hot group, ties, null groups and keys, one odd symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import ordered


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    rng = np.random.default_rng(3)
    n = 3000
    return pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n)),
            "symbol": rng.choice([f"SYM{i}" for i in range(40)] + ["S", "T9"], n),
            "signal_idx": np.arange(n),
            "signal_date": pd.to_datetime("2024-01-01").date(),
            "v": np.where(rng.random(n) < 0.4, 50.0, np.round(rng.normal(0, 1, n), 2)),
            "return_pct": np.round(rng.normal(0.001, 0.05, n), 6),
        }
    )


def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows)
    got = ordered.running(
        df, ["k"], ["symbol", "signal_idx"], {"rn": F.lit(1), "s": F.col("return_pct")}, peaks={"top": "s"}
    ).toPandas()
    want = rows.sort_values(["k", "symbol", "signal_idx"]).copy()
    want["rn"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["return_pct"].cumsum()
    want["top"] = want.groupby("k")["s"].cummax()
    both = got.merge(want, on="signal_idx", suffixes=("", "_w"))
    assert (both.rn == both.rn_w).all()
    assert np.allclose(both.s, both.s_w) and np.allclose(both.top, both.top_w)


def test_average_ranks_and_median(spark, rows):
    df = spark.createDataFrame(rows)
    got = ordered.with_average_ranks(df, ["k"], {"v": "rk"}).toPandas().set_index("signal_idx").sort_index()
    want = rows.groupby("k")["v"].rank()
    assert np.allclose(got["rk"].to_numpy(), want.to_numpy())
    med = ordered.exact_median(df, ["k"], "return_pct", "m").toPandas().set_index("k")["m"]
    assert np.allclose(med.sort_index(), rows.groupby("k")["return_pct"].median().sort_index())


def test_path_summary(spark, rows):
    df = spark.createDataFrame(rows)
    got = ordered.path_summary(
        df, ["k"], ["symbol", "signal_idx"], "return_pct"
    ).toPandas().set_index("k")
    for key, g in rows.sort_values(["symbol", "signal_idx"]).groupby("k"):
        equity = np.cumprod(1 + g.return_pct.to_numpy())
        peak = np.maximum.accumulate(np.r_[1.0, equity])[1:]
        streak = best = 0
        for x in g.return_pct:
            streak = streak + 1 if x <= 0 else 0
            best = max(best, streak)
        assert abs(got.loc[key, "max_drawdown"] - ((peak - equity) / peak).max()) < 1e-9
        assert abs(got.loc[key, "total_return"] - (equity[-1] - 1)) < 1e-9
        assert got.loc[key, "max_consecutive_loss"] == best


def test_nulls_and_odd_symbols_are_keys_like_others(spark):
    data = [(None if i % 2 else "g", None if i % 7 == 0 else f"SYMBOL-{i:06d}" if i != 5 else "A", i, float(i % 5), None if i % 3 == 0 else i % 4 / 1.0) for i in range(400)]
    df = spark.createDataFrame(data, "k string, symbol string, signal_idx int, return_pct double, v double")
    w = Window.partitionBy("k").orderBy("symbol", "signal_idx").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.signal_idx): (r.rn, r.s) for r in df.select("*", F.count("*").over(w).alias("rn"), F.sum("return_pct").over(w).alias("s")).collect()}
    sums = {"rn": F.lit(1), "s": F.col("return_pct")}
    got = {(r.k, r.signal_idx): (r.rn, r.s) for r in ordered.running(df, ["k"], ["symbol", "signal_idx"], sums, buckets=13).collect()}
    assert got == want
    down = Window.orderBy(F.col("v").desc(), "signal_idx")
    want = {r.signal_idx: r.p for r in df.select("signal_idx", F.row_number().over(down).alias("p")).collect()}
    got = {r.signal_idx: r.p for r in ordered.running(df, [], [F.col("v").desc(), F.col("signal_idx")], {"p": F.lit(1)}).collect()}
    assert got == want
    ranks = {(r.k, r.signal_idx): r.rk for r in ordered.with_average_ranks(df, ["k"], {"v": "rk"}).collect()}
    frame = df.toPandas().dropna(subset=["v"])
    for part in (None, "g"):
        one = frame[frame.k.isna()] if part is None else frame[frame.k == part]
        assert [ranks[part, i] for i in one.signal_idx] == one.v.rank().tolist()
    assert {r.k: r.m for r in ordered.exact_median(df, ["k"], "v", "m").collect()} == {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert ordered.path_summary(df, ["k"], ["symbol", "signal_idx"], "return_pct").count() == 2


def test_paths_write_what_they_need(spark, monkeypatch):
    """A wide trade table is cut into ranges by key, order and return only."""
    from tapeloom.operators import metrics

    seen = []
    cut = ordered.bucketed
    monkeypatch.setattr(ordered, "bucketed", lambda df, *a, **k: seen.append(df.columns) or cut(df, *a, **k))
    wide = spark.createDataFrame([("a", "S", i, 0.1 * (-1) ** i, "much", 5.0) for i in range(40)], "k string, symbol string, signal_idx int, return_pct double, note string, price double")
    got = metrics.path_metrics(wide, ["k"]).first()
    assert seen == [["k", "symbol", "signal_idx", "return_pct"]]
    assert got.max_consecutive_loss == 1
