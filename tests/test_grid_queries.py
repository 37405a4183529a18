"""Sweeps over the library's grids look at every entry of the base strategy."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import trades as tr
from tapeloom.plans import grid_queries
from tapeloom.plans import tables as t
from tapeloom.plans.trade_queries import BASE


@pytest.fixture(scope="module")
def tables(tmp_path_factory) -> str:
    """Three symbols of 420 days, one tick a day, with small moves."""
    folder, parts = tmp_path_factory.mktemp("sweep"), []
    for symbol in range(3):
        rng = np.random.default_rng(symbol)
        price = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.012, 420)))
        days = [date(1996, 1, 1) + timedelta(days=i) for i in range(420)]
        parts.append(pd.DataFrame({"l_suppkey": symbol, "l_shipdate": days, "l_extendedprice": np.exp((price - 100) / 5) * 10, "l_quantity": 10.0}))
    rows = pd.concat(parts, ignore_index=True)
    rows["l_orderkey"], rows["l_linenumber"], rows["l_partkey"] = rows.index, 1, rows.index % 7
    rows["l_shipdate"] = pd.to_datetime(rows["l_shipdate"]).dt.date
    rows.to_parquet(folder / "lineitem.parquet")
    return str(folder)


def entries(df) -> set[tuple]:
    return {(r.symbol, r.signal_idx, r.exit_idx, r.exit_reason) for r in df.collect()}


def test_exit_grid_starts_with_all_trades_of_the_base(spark, tables):
    got = grid_queries.exit_grid_sweep(spark, tables).cache()
    base = entries(tr.trades(t.bars(spark, tables), BASE))
    assert len(base) > 20
    assert entries(got.where("candidate_id LIKE '%_x0000'")) == base
    assert got.select("candidate_id").distinct().count() == 5 * 5 * 5 * 11


def test_param_sweep_starts_with_all_trades_of_the_base_and_makes_all_tries(spark, tables):
    got = grid_queries.param_sweep(spark, tables).cache()
    assert entries(got.where("candidate_id LIKE '%_p0000'")) == entries(tr.trades(t.bars(spark, tables), BASE))
    # baseline, 4 moves each of stop and holding limit and their pairs, then 14 guards alone and with each single move
    ids = sorted(r.candidate_id for r in got.select("candidate_id").distinct().collect())
    assert [i[-4:] for i in ids[:25]] == [f"{i:04d}" for i in range(1 + 8 + 16)]
    assert int(ids[-1][-4:]) == 1 + 8 + 16 + 14 * 9 - 1
