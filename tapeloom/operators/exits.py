"""How good the exits of a trade table were, seen against the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Look-ahead after an exit, a meaningful move, a late give-back.
LOOKAHEAD_BARS = 5
MEANINGFUL_MOVE = 0.03
LATE_GIVEBACK = 0.05


def range_extremes(bars: DataFrame, longest: int, *, lookahead: int = LOOKAHEAD_BARS) -> DataFrame:
    """Sparse table per symbol: for every bar the extremes of 1, 2, 4, … bars from it on, up to ``longest``.

    Any span of bars is covered by two of these blocks, one from its first bar
    on and one up to its last.  ``post_high`` and ``post_low`` look at the bars
    after it.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    after = own.rowsBetween(1, lookahead)
    blocks = [own.rowsBetween(0, (1 << j) - 1) for j in range(max(1, longest.bit_length()))]
    return bars.select(
        "symbol",
        (F.row_number().over(own) - 1).alias("bar"),
        F.array(*[F.max("high").over(w) for w in blocks]).alias("tops"),
        F.array(*[F.min("low").over(w) for w in blocks]).alias("bottoms"),
        F.max("high").over(after).alias("post_high"),
        F.min("low").over(after).alias("post_low"),
    )


def trade_excursions(trades: DataFrame, bars: DataFrame, keys: list[str], *, lookahead: int = LOOKAHEAD_BARS) -> DataFrame:
    """Best and worst price while a trade was open, and just after its exit.

    A trade reads at most three bars of a sparse table, however long it was
    held: the two blocks that cover its span and its exit bar.
    """
    real = trades.where(F.col("exit_price").isNotNull() & (F.col("entry_price") > 0))
    longest = real.agg(F.max(F.col("exit_idx") - F.col("entry_idx") + 1)).first()[0] or 1  # one number
    facts = range_extremes(bars, int(longest), lookahead=lookahead)
    per_trade = [*keys, "symbol", "signal_idx"]
    level = F.floor(F.log2(F.col("exit_idx") - F.col("entry_idx") + F.lit(1.5))).cast("int")  # whole spans only, so .5 off any power of two
    reads = F.array_distinct(F.array(F.col("entry_idx"), F.col("exit_idx") - F.pow(F.lit(2), F.col("level")).cast("int") + 1, F.col("exit_idx")))
    spans = real.withColumn("level", level).select(
        *per_trade, "entry_price", "exit_price", "exit_reason", "return_pct", "entry_idx", "exit_idx", "level", F.explode(reads).alias("bar")
    )
    at_exit = F.col("bar") == F.col("exit_idx")
    # a block that begins at the exit bar would look past it, but for single bars
    inside = F.when(at_exit, F.lit(0)).otherwise(F.col("level"))
    seen = (
        spans.join(facts, ["symbol", "bar"])
        .groupBy(*per_trade)
        .agg(
            F.first("entry_price").alias("entry_price"),
            F.first("exit_price").alias("exit_price"),
            F.first("exit_reason").alias("exit_reason"),
            F.first("return_pct").alias("return_pct"),
            F.max(F.get("tops", inside)).alias("top"),
            F.min(F.get("bottoms", inside)).alias("bottom"),
            F.max(F.when(at_exit, F.col("post_high"))).alias("post_high"),
            F.max(F.when(at_exit, F.col("post_low"))).alias("post_low"),
        )
    )
    entry, out = F.col("entry_price"), F.col("exit_price")
    seen = seen.withColumns(
        {
            "mfe": (F.col("top") - entry) / entry,
            "mae": (F.col("bottom") - entry) / entry,
            "post_gain": F.when(out > 0, (F.col("post_high") - out) / out),
            "post_fall": F.when(out > 0, (out - F.col("post_low")) / out),
        }
    )
    return seen.withColumn("giveback", F.greatest(F.lit(0.0), F.col("mfe") - F.col("return_pct")))


def exit_diagnostics(excursions: DataFrame, keys: list[str]) -> DataFrame:
    move, reason = MEANINGFUL_MOVE, F.col("exit_reason")
    gained, known = F.col("post_gain") >= move, F.col("post_gain").isNotNull()
    late = known & (F.col("mfe") >= move) & (F.col("giveback") >= LATE_GIVEBACK)
    early = reason.isin("take_profit", "signal", "max_hold") & gained
    return excursions.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.round(F.avg("mfe"), 6).alias("avg_mfe"),
        F.round(F.avg("mae"), 6).alias("avg_mae"),
        F.round(F.avg("giveback"), 6).alias("avg_giveback"),
        F.count_if(early).alias("sold_early_count"),
        F.count_if(late).alias("sold_late_count"),
        F.count_if((reason == "stop_loss") & (F.col("post_fall") >= move)).alias("stop_loss_effective_count"),
        F.count_if((reason == "take_profit") & gained).alias("take_profit_truncated_count"),
    )
