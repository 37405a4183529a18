"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = {
    "prepare_history": "a01_prepare_history",
    "moving_average": "d01_d25_ma_above",
    "rsi": "d08_d30_rsi",
    "macd": "d10_d36_macd_histogram",
    "event_proxies": "d67_c04_event_proxies",
    "regime": "d69_d70_symbol_regime",
    "entry_predicate": "b01_b02_b03_entry_predicate",
    "trades": "e01_e05_e10_e16_e18_trades",
    "trailing_trades": "e13_trailing_target",
    "sector_metrics": "g13_sector_metrics",
    "sweep_metrics": "i05_sweep_metrics",
    "walk_forward": "g17_walk_forward",
    "cpcv": "g20_c08_cpcv_paths",
    "exit_diagnostics": "g31_c06_c07_exit_diagnostics",
    "buy_and_hold": "g28_buy_and_hold",
    "exposure_curve": "f01_f03_exposure_curve",
    "daily_rank_ic": "h02_daily_rank_ic",
    "rank_turnover": "h05_rank_turnover",
    "failed_signatures": "j14_failed_signatures",
    "lineage": "c14_lineage",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        # one process and small files: keep every core busy after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.files.maxPartitionBytes", "4MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from tapeloom.plans.catalog import QUERIES

    spark = session()
    drain(QUERIES["a21_date_range"](spark, SF_DIR))  # start the executors
    seconds: dict[str, float] = {}
    for label, name in HEADLINE.items():
        began = time.perf_counter()
        drain(QUERIES[name](spark, SF_DIR))
        seconds[label] = round(time.perf_counter() - began, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name}))


if __name__ == "__main__":
    main()
