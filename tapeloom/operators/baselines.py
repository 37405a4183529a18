"""Buy-and-hold, random entry and stress-window baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import running
from tapeloom.runtime import stage, with_row


def buy_and_hold(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Mean symbol return, equal-weight curve drawdown and Sharpe, excess return.

    The curve averages normalised closes by bar position, so it has at most as
    many rows as a calendar has days.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    numbered = bars.select(
        "symbol",
        "close",
        F.row_number().over(own).alias("i"),
        F.first("close").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
    )
    pos = stage(numbered)  # read for the symbols and for the curve
    per_symbol = pos.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.max("first").alias("first"),
        F.max_by("close", "i").alias("last"),
    )
    held = per_symbol.agg(
        F.coalesce(
            F.avg(F.when((F.col("n") >= 2) & (F.col("first") > 0), (F.col("last") - F.col("first")) / F.col("first"))),
            F.lit(0.0),
        ).alias("benchmark_return"),
        F.count("*").alias("symbols_used"),
    )
    curve = pos.where(F.col("first") > 0).groupBy("i").agg(F.avg(F.col("close") / F.col("first")).alias("v"))
    line = Window.orderBy("i")  # one row per bar position
    walked = curve.select(
        (F.col("v") / F.max("v").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("dd"),
        (F.col("v") / F.lag("v", 1).over(line) - 1).alias("ret"),
    )
    shape = walked.agg(
        F.abs(F.min("dd")).alias("benchmark_max_drawdown"),
        F.when(
            (F.count("ret") > 5) & (F.stddev_samp("ret") > 0),
            F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * (252**0.5),
        )
        .otherwise(0.0)
        .alias("benchmark_sharpe"),
    )
    made = trades.agg(F.coalesce(F.sum("return_pct"), F.lit(0.0)).alias("total"))
    one = with_row(with_row(held, shape), made)
    gain = F.col("total") / F.greatest("symbols_used", F.lit(1))
    return one.select(
        "benchmark_return",
        gain.alias("strategy_return"),
        (gain - F.col("benchmark_return")).alias("excess_return"),
        F.coalesce("benchmark_max_drawdown", F.lit(0.0)).alias("benchmark_max_drawdown"),
        "benchmark_sharpe",
        "symbols_used",
    )


def random_pool(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Every return over the average holding time, with the trade statistics."""
    stats = trades.agg(
        F.greatest(F.lit(1), F.floor(F.avg("holding_days")).cast("int")).alias("hold"),
        F.count("*").alias("n"),
        F.avg("return_pct").alias("strategy_avg"),
    ).first()  # one row
    own = Window.partitionBy("symbol").orderBy("date")
    later = F.lead("close", stats.hold or 1).over(own)
    pos = bars.select("symbol", "close", F.row_number().over(own).alias("i"), later.alias("exit_close"))
    return pos.where(F.col("exit_close").isNotNull() & (F.col("close") > 0)).select(
        "symbol",
        "i",
        F.lit(stats.n).alias("n"),
        F.lit(stats.strategy_avg).cast("double").alias("strategy_avg"),
        ((F.col("exit_close") - F.col("close")) / F.col("close")).alias("r"),
    )


def draws(sims: int, each: int, among: int, spark_df: DataFrame, seed: int) -> DataFrame:
    """(sim, place): ``each`` draws with replacement per simulation among ``among`` places.

    A draw is the md5 of seed, simulation and its number, so any engine can
    repeat it.  Draws of a simulation are split over tasks by their number.
    """
    spark = spark_df.sparkSession
    numbers = spark.range(sims * each).select(F.expr(f"id div {each}").alias("sim"), (F.col("id") % each).alias("k"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sim").cast("string"), F.col("k").cast("string")))
    return numbers.select("sim", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(among)).alias("place"))


def random_baseline(bars: DataFrame, trades: DataFrame, *, sims: int = 100, seed: int = 42) -> DataFrame:
    """Bootstrap of random entries: mean, spread, 5/95 borders, beaten share.

    Sampling with replacement: the draws are made first and joined to the pool
    by place, so the work is the number of draws plus the pool, not their
    product.  Places count through the symbols by their pool sizes.
    """
    pool = stage(random_pool(bars, trades))
    size = pool.agg(F.count("*").alias("pool"), F.first("n").alias("n"), F.first("strategy_avg").alias("strategy_avg")).first()  # one row
    spark = pool.sparkSession
    if size.pool < 10:
        return spark.createDataFrame([], _BASELINE_SCHEMA)
    sizes = running(pool.groupBy("symbol").agg(F.count("*").alias("size")), [], ["symbol"], {"upto": F.col("size")})
    own = Window.partitionBy("symbol").orderBy("i")
    base = sizes.select("symbol", (F.col("upto") - F.col("size")).alias("before"))
    placed = pool.withColumn("at", F.row_number().over(own) - 1).join(base, "symbol").select((F.col("before") + F.col("at")).alias("place"), "r")
    drawn = draws(sims, min(size.n, size.pool), size.pool, pool, seed)
    means = drawn.join(placed, "place").groupBy("sim").agg(F.avg("r").alias("m"))
    ranked = means.withColumn("p", F.row_number().over(Window.orderBy("m")))  # ``sims`` rows
    low, high = max(0, int(sims * 0.05)) + 1, min(sims - 1, int(sims * 0.95)) + 1
    return ranked.agg(
        F.avg("m").alias("random_mean"),
        F.coalesce(F.stddev_samp("m"), F.lit(0.0)).alias("random_std"),
        F.max(F.when(F.col("p") == low, F.col("m"))).alias("ci_lower"),
        F.max(F.when(F.col("p") == high, F.col("m"))).alias("ci_upper"),
        (F.count_if(F.lit(size.strategy_avg) > F.col("m")) / F.lit(sims)).alias("beat_fraction"),
        F.count("*").alias("n_simulations"),
    )


_BASELINE_SCHEMA = "random_mean double, random_std double, ci_lower double, ci_upper double, beat_fraction double, n_simulations long"


def stress_windows(index: DataFrame, *, days: int = 20, top_k: int = 3) -> DataFrame:
    """Worst non-overlapping windows of an index (one row per calendar day)."""
    w = Window.orderBy("date")
    frame = w.rowsBetween(1 - days, 0)
    rows = index.select("date", "close", (F.row_number().over(w) - 1).alias("end")).select(
        "*", F.collect_list("close").over(frame).alias("p"), F.first("date").over(frame).alias("start_date")
    )
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def walk(acc: Column, price: Column) -> Column:
        peak = F.greatest(acc["peak"], price)
        return F.struct(peak.alias("peak"), F.greatest(acc["dd"], (peak - price) / peak).alias("dd"))

    cand = rows.where((F.size("p") == days) & (F.get("p", F.lit(0)) > 0)).select(
        (F.col("close") / F.get("p", F.lit(0)) - 1).alias("ret"),
        (-F.aggregate("p", start, walk, lambda a: a["dd"])).alias("neg_dd"),
        "end",
        "start_date",
        F.col("date").alias("end_date"),
    )
    ordered = cand.agg(F.array_sort(F.collect_list(F.struct("ret", "neg_dd", "end", "start_date", "end_date"))).alias("c"))
    none = F.array().cast("array<struct<ret:double,neg_dd:double,end:int,start_date:date,end_date:date>>")

    def choose(acc: Column, c: Column) -> Column:
        clash = F.exists(acc, lambda s: F.abs(s["end"] - c["end"]) < days)
        return F.when(clash | (F.size(acc) >= top_k), acc).otherwise(F.concat(acc, F.array(c)))

    picked = ordered.select(F.posexplode(F.aggregate("c", none, choose)).alias("pos", "s"))
    return picked.select(
        (F.col("pos") + 1).alias("window_num"),
        "s.start_date",
        "s.end_date",
        F.round("s.ret", 4).alias("benchmark_return"),
        F.round(-F.col("s.neg_dd"), 4).alias("benchmark_drawdown"),
        F.col("s.ret").alias("_ret"),
    )


def stress_cases(trades: DataFrame, windows: DataFrame) -> DataFrame:
    """Trades that overlap each stress window, against the index move.

    The few windows travel as one array; each trade emits only the windows it
    really overlaps.
    """
    packed = windows.agg(F.collect_list(F.struct("window_num", "start_date", "end_date")).alias("ws"))
    left = F.coalesce(F.col("exit_date"), F.col("signal_date"))
    hits = with_row(trades, packed).select(
        "return_pct",
        F.explode(
            F.filter("ws", lambda x: (F.col("signal_date") <= x["end_date"]) & (left >= x["start_date"]))
        ).alias("x"),
    )
    r = F.col("return_pct")
    per = hits.groupBy(F.col("x.window_num").alias("window_num")).agg(
        F.count("*").alias("signal_count"),
        F.avg((r > 0).cast("double")).alias("wr"),
        F.avg(r).alias("avg"),
        (F.exp(F.sum(F.log(F.greatest(1 + r, F.lit(1e-300))))) - 1).alias("tot"),
    )
    joined = windows.join(per, "window_num", "left")
    zero = F.lit(0.0)
    total = F.coalesce("tot", zero)
    return joined.select(
        "window_num",
        "start_date",
        "end_date",
        "benchmark_return",
        "benchmark_drawdown",
        F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
        F.round(F.coalesce("wr", zero), 4).alias("strategy_win_rate"),
        F.round(F.coalesce("avg", zero), 4).alias("strategy_avg_return"),
        F.round(total, 4).alias("strategy_total_return"),
        F.round(total - F.col("_ret"), 4).alias("alpha"),
    )


def stress_summary(cases: DataFrame) -> DataFrame:
    worst = F.min_by(F.struct("start_date", "end_date", "benchmark_return"), F.struct("alpha", "window_num"))
    return cases.agg(
        F.count("*").alias("total_windows"),
        F.round(F.avg((F.col("alpha") >= 0).cast("double")), 4).alias("pass_rate"),
        F.round(F.avg("alpha"), 4).alias("average_alpha"),
        F.min("alpha").alias("worst_alpha"),
        worst.alias("_w"),
    ).select(
        "total_windows",
        "pass_rate",
        "average_alpha",
        "worst_alpha",
        F.col("_w.start_date").alias("worst_window_start"),
        F.col("_w.end_date").alias("worst_window_end"),
        F.col("_w.benchmark_return").alias("worst_benchmark_return"),
    )
