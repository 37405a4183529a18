"""Book-level views of a trade table: exposure per date and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.runtime import with_row


def add_weekdays(day: Column, n: Column) -> Column:
    """The n-th weekday after a date; null when n is not positive."""
    dow = F.weekday(day)
    base = F.least(dow, F.lit(4))
    start = F.date_sub(day, (dow - base).cast("int"))
    rest = n % 5
    days = F.floor(n / 5) * 7 + rest + F.when(base + rest > 4, 2).otherwise(0)
    return F.when(n > 0, F.date_add(start, days.cast("int")))


def estimated_exit() -> Column:
    return add_weekdays(F.col("signal_date"), F.col("holding_days"))


def interpolated_price(on: Column) -> Column:
    """Straight line from entry to exit over the holding days (calendar days)."""
    held = F.datediff(on, F.col("signal_date"))
    part = F.least(F.lit(1.0), held / F.greatest(F.lit(1), F.col("holding_days")))
    moved = F.col("entry_price") + part * (F.col("exit_price") - F.col("entry_price"))
    flat = (F.col("holding_days") <= 0) | (held <= 0) | F.col("exit_price").isNull()
    return F.when(flat, F.col("entry_price")).otherwise(moved)


def exposure_curve(trades: DataFrame, *, capital: float = 100_000.0, size: float = 10_000.0) -> DataFrame:
    """Open positions and equity on every signal date, with a fixed size per trade.

    A trade is three events, whatever its length: it opens and its value starts
    to move along a line, the line ends when its holding days are over, and it
    closes.  Events are summed per day and swept along the calendar, so ordered
    steps only see one row per calendar day.
    """
    zero, one = F.lit(0.0), F.lit(1)
    t = trades.select("signal_date", "entry_price", "exit_price", "holding_days").withColumns(
        {"until": estimated_exit(), "shares": size / F.col("entry_price")}
    )
    pnl = F.coalesce(F.col("shares") * (F.col("exit_price") - F.col("entry_price")), zero)
    timed = F.col("until").isNotNull()
    slope = F.when(timed, pnl / F.greatest(one, F.col("holding_days"))).otherwise(zero)
    line_end = F.date_add("signal_date", F.greatest(one, F.col("holding_days")).cast("int"))

    def event(day: Column, opened: int, open_: int, bend: Column) -> Column:
        return F.struct(day.alias("date"), F.lit(opened).alias("opened"), F.lit(open_).alias("open"), bend.alias("bend"))

    happens = F.array(
        event(F.col("signal_date"), 1, 1, slope),
        event(F.when(timed, line_end), 0, 0, -slope),
        event(F.col("until"), 0, -1, zero),
    )
    events = t.select(F.explode(happens).alias("e")).select("e.*").where(F.col("date").isNotNull())
    daily = events.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("opened", "open", "bend")])
    span = daily.agg(F.min("date").alias("a"), F.max("date").alias("b")).where(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence("a", "b")).alias("date"))
    swept = days.join(daily, "date", "left").fillna(0)
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # calendar days
    passed = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    swept = swept.withColumn("speed", F.sum("bend").over(upto))
    # what a trade has gained stays in the book when it closes, so its line only stops moving
    curve = swept.select(
        "date",
        "opened",
        F.sum("open").over(upto).alias("positions_open"),
        (F.lit(capital) + F.coalesce(F.sum("speed").over(passed), zero)).alias("equity"),
    ).where(F.col("opened") > 0)
    before = F.lag("equity", 1, capital).over(Window.orderBy("date"))
    return curve.select(
        "date",
        "positions_open",
        "equity",
        F.when(before > 0, F.col("equity") / F.nullif(before, F.lit(0.0)) - 1).otherwise(0.0).alias("daily_return"),
    )


def book_summary(
    curve: DataFrame,
    trades: DataFrame,
    *,
    capital: float = 100_000.0,
    size_pct: float = 0.1,
    max_positions: int = 10,
    risk_free: float = 0.02,
) -> DataFrame:
    """Drawdown, Sharpe, concurrency, utilisation and win rate of a book."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # calendar days
    peak = F.max("equity").over(upto)
    walked = curve.withColumn("dd", F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0))
    moved = F.when(F.col("daily_return") != 0, F.col("daily_return"))
    stats = walked.agg(
        F.max("dd").alias("max_drawdown"),
        F.count(moved).alias("_n"),
        F.avg(moved).alias("_mean"),
        F.stddev_samp(moved).alias("_std"),
        F.max("positions_open").alias("max_concurrent_positions"),
        F.avg(F.col("positions_open") * size_pct / max_positions).alias("_use"),
        F.max_by("equity", "date").alias("last_equity"),
    )
    sharpe = (F.col("_mean") - risk_free / 252) / F.nullif("_std", F.lit(0.0)) * (252**0.5)
    won = trades.agg(
        F.count("*").alias("total_trades"),
        F.avg((F.col("exit_price") > F.col("entry_price")).cast("double")).alias("win_rate"),
    )
    return with_row(stats, won).select(
        "total_trades",
        "win_rate",
        "max_drawdown",
        F.when(F.col("_n") < 2, 0.0).otherwise(F.coalesce(sharpe, F.lit(0.0))).alias("sharpe_ratio"),
        "max_concurrent_positions",
        F.least(F.lit(1.0), F.col("_use")).alias("capital_utilization"),
        (F.col("last_equity") / capital - 1).alias("total_return"),
    )
