"""Ranks, chunks and turnover equal plain ones when groups are cut into many parts."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import factors, ordered

START = date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    """40 symbols on 30 days with gaps, many ties and both zeros; one day holds most rows."""
    rng = np.random.default_rng(11)
    days = pd.concat([pd.DataFrame({"day": d, "symbol": rng.choice(40, rng.integers(3, 40), replace=False)}) for d in range(30)])
    hot = pd.DataFrame({"day": 12, "symbol": np.arange(100, 500)})
    df = pd.concat([days, hot], ignore_index=True)
    n = len(df)
    df["date"] = [START + timedelta(days=int(d)) for d in df.day]
    df["f"] = np.where(rng.random(n) < 0.4, 0.0, np.round(rng.normal(0, 1, n), 1))
    df.loc[df.f == 0, "f"] = np.where(rng.random((df.f == 0).sum()) < 0.5, 0.0, -0.0)
    df["r"] = np.round(rng.normal(0, 1, n), 2)
    return df.drop(columns="day")


@pytest.mark.parametrize("size", [7, 50, 100_000])
@pytest.mark.parametrize("group", [["date"], []])
def test_ranks_move_rows_once_and_stage_nothing(spark, rows, monkeypatch, size, group):
    monkeypatch.setattr(ordered, "TASK_ROWS", size)
    monkeypatch.setattr(ordered, "stage", None)
    got = ordered.with_average_ranks(spark.createDataFrame(rows), group, {"f": "rf", "r": "rr"})
    found = got.toPandas().set_index(["symbol", "date"]).sort_index()
    flat = rows.assign(f=rows.f + 0.0).set_index(["symbol", "date"]).sort_index()
    by = flat.groupby("date") if group else flat
    assert np.array_equal(found.rf, by.f.rank()) and np.array_equal(found.rr, by.r.rank())


def test_one_value_has_no_correlation_however_it_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 10, raising=False)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    days = [pd.DataFrame({"date": START + timedelta(days=n), "f": 0.1, "r": np.random.default_rng(n).normal(size=n)}) for n in range(200, 240)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = factors._rank_corr(spark.createDataFrame(pd.concat(days)), ["date"], "f", "r").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(got) == 40 and {x.ic for x in got} == {None}


@pytest.mark.parametrize("parts", [5, 12])
def test_chunks_follow_date_and_symbol(spark, rows, parts):
    got = factors.in_chunks(spark.createDataFrame(rows), parts, 5).toPandas()
    size = max(len(rows) // parts, 5)
    assert set(got["size"]) == {size} and set(got["rows"]) == {len(rows)}
    got = got.sort_values(["date", "symbol"]).reset_index(drop=True)
    assert np.array_equal(got.chunk, np.arange(len(rows)) // size)


def test_turnover_pairs_consecutive_days(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    got = factors.turnover(spark.createDataFrame(rows)).first()
    df = rows.assign(f=rows.f + 0.0)
    df = df[df.groupby("date").f.transform("size") >= factors.MIN_CROSS_SECTION]
    df = df.assign(no=df.date.rank(method="dense").astype(int), rank=df.groupby("date").f.rank())
    pairs = df.merge(df.assign(no=df.no + 1), on=["symbol", "no"], suffixes=("", "_before"))
    steps = (pairs["rank"] - pairs["rank_before"]).abs().groupby(pairs.no).agg(["mean", "size"])
    steps = steps[steps["size"] >= factors.MIN_CROSS_SECTION]
    assert got.steps == len(steps)
    assert got.turnover == pytest.approx((steps["mean"] / steps["size"]).mean(), abs=1e-12)


def test_validation_is_the_same_in_many_parts(spark, rows, monkeypatch):
    obs = spark.createDataFrame(rows.assign(g=rows.f * 0.5 + rows.r))
    whole = factors.validate(obs, others={"gap": obs.g}).first()
    monkeypatch.setattr(ordered, "TASK_ROWS", 30)
    cut = factors.validate(obs, others={"gap": obs.g}).first()
    assert whole.reasons == cut.reasons
    assert [whole[c] for c in ("ic_mean", "ir", "turnover", "corr_gap")] == pytest.approx([cut[c] for c in ("ic_mean", "ir", "turnover", "corr_gap")])
