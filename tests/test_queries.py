"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "d08_d30_rsi",
    "e01_e05_e10_e16_e18_trades",
    "g01_g08_g10_g11_overall_metrics",
    "g20_c08_cpcv_paths",
    "g30_c05_stress_windows",
    "h02_daily_rank_ic",
    "h05_rank_turnover",
    "i09_diverse_seeds",
    "j06_regime_fit_sample",
    "c14_lineage",
    "i04_exit_grid_sweep",
    "j08_expanded_sample",
    "b11_widened_history",
    "a20_data_fingerprint",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    ok, note = compare(duck, spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130
