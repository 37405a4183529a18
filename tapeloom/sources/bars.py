"""Reading, normalising and persisting bar tables."""

from __future__ import annotations

import math
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.indicators import lookback
from tapeloom.functions.spec import Strategy, warmup_bars
from tapeloom.runtime import stage

BAR_SCHEMA = (
    "symbol string, date date, open double, high double, low double, close double, "
    "volume double, prev_close double, amount double, st boolean, name string"
)
REQUIRED = ("date", "open", "high", "low", "close", "volume")

# Provider column names and the standard names they stand for.
YAHOO_COLUMNS = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
}
CHINESE_COLUMNS = {
    "日期": "date",
    "开盘": "open",
    "最高": "high",
    "最低": "low",
    "收盘": "close",
    "成交量": "volume",
    "成交额": "amount",
}


def by_symbol() -> Window:
    """Bars of one symbol in date order: at most one row per calendar day."""
    return Window.partitionBy("symbol").orderBy("date")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def prepare_history(
    df: DataFrame,
    start: date | None = None,
    end: date | None = None,
    *,
    sequence: str | Column | None = None,
    required: tuple[str, ...] = REQUIRED,
) -> DataFrame:
    """One row per (symbol, date), previous close, then the date clip.

    ``sequence`` orders repeated rows of a day; the last one is kept, and
    without an order a repeated day is an error when the rows are read.  The
    previous close is taken before clipping, so the first bar in range still
    knows its predecessor.  A symbol with any missing previous close gets the
    whole column recomputed.
    """
    require_columns(df, required)
    df = df.withColumn("date", F.to_date("date"))
    rest = [c for c in df.columns if c not in ("symbol", "date")]
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    df = df.select(
        "symbol",
        "date",
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in numeric else c for c in rest],
        *([sequence.alias("_seq")] if isinstance(sequence, Column) else []),
    )
    if sequence is not None:
        order = F.col("_seq") if isinstance(sequence, Column) else F.col(sequence)
        latest = df.groupBy("symbol", "date").agg(F.max_by(F.struct(*rest), order).alias("_row"))
        df = latest.select("symbol", "date", "_row.*")
    w = by_symbol()
    if sequence is None:
        again = F.lag("date", 1).over(w) == F.col("date")
        told = F.raise_error(F.concat(F.lit("a day repeats and no sequence is given: "), F.concat_ws(" ", F.col("symbol").cast("string"), F.col("date").cast("string"))))
        df = df.withColumn("_again", again).withColumn("date", F.when(F.col("_again"), told.cast("date")).otherwise(F.col("date"))).drop("_again")
    if "close" in rest:
        lagged = F.lag("close", 1).over(w)
        if "prev_close" in rest:
            gaps = F.count(F.when(F.col("prev_close").isNull(), 1)).over(Window.partitionBy("symbol"))
            df = df.withColumn("prev_close", F.when(gaps > 0, lagged).otherwise(F.col("prev_close")))
        else:
            df = df.withColumn("prev_close", lagged)
    return clip_dates(df, start, end)


def clip_dates(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    if start is not None and end is not None and start > end:
        raise ValueError(f"start {start} is after end {end}")
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    return df


def normalise_yahoo(df: DataFrame) -> DataFrame:
    """Drop the time zone, use standard names, add the previous close."""
    renamed = df.withColumnsRenamed({k: v for k, v in YAHOO_COLUMNS.items() if k in df.columns})
    dated = renamed.withColumn("date", F.to_date("date"))
    return dated.withColumn("prev_close", F.lag("close", 1).over(by_symbol()))


def normalise_renamed(df: DataFrame, *, coerce: bool = False) -> DataFrame:
    """Bars from a provider with its own column names.

    A missing volume becomes 0; any other missing column gives an empty table.
    ``coerce`` turns unreadable numbers into nulls and drops rows without a
    date or price.
    """
    df = df.withColumnsRenamed({k: v for k, v in CHINESE_COLUMNS.items() if k in df.columns})
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    if any(c not in df.columns for c in REQUIRED):
        return df.sparkSession.createDataFrame(
            [], "symbol string, date date, open double, high double, low double, close double, "
            "volume double, prev_close double"
        )
    numbers = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in df.columns]
    if coerce:
        df = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
        df = df.withColumn("date", F.col("date").try_cast("date"))
        df = df.dropna(subset=["date", "open", "high", "low", "close"])
        df = df.fillna(0.0, subset=["volume"])
    else:
        df = df.withColumn("date", F.to_date("date"))
    if "prev_close" in df.columns:
        return df
    return df.withColumn("prev_close", F.lag("close", 1).over(by_symbol()))


def prefer_sources(frames: list[DataFrame]) -> DataFrame:
    """Per symbol, all rows of the first source that has any."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = both.groupBy("symbol").agg(F.min("_source").alias("_best"))
    return both.join(best, "symbol").where(F.col("_source") == F.col("_best")).drop("_source", "_best")


def read_history(
    spark: SparkSession, path: str, start: date, end: date, symbols: list[str] | None = None
) -> DataFrame:
    """Date-range read of a stored bar table; both filters reach the scan."""
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    df = spark.read.parquet(path)
    if "year" in df.columns:
        df = df.where(F.col("year").between(start.year, end.year)).drop("year")
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return clip_dates(df, start, end)


def write_history(df: DataFrame, path: str) -> None:
    """Store bars by year; only the years present in ``df`` are replaced."""
    (
        df.withColumn("year", F.year("date"))
        .repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(64)))
        .sortWithinPartitions("symbol", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def index_history(df: DataFrame) -> DataFrame:
    """Index bars; open, high and low are filled from close where absent."""
    require_columns(df, ("date", "close"))
    for c in ("open", "high", "low"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("close")) if c in df.columns else F.col("close"))
    return df


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Frozen snapshot: JSON lines with a symbol and bar columns."""
    return spark.read.schema(BAR_SCHEMA).json(path).where(F.col("symbol").isNotNull())


def universe_for(universe: DataFrame, market: str) -> DataFrame:
    return universe.where(F.col("market") == market)


def custom_universe(universe: DataFrame, market: str, symbols: list[str], list_market: str) -> DataFrame:
    """Rows of a hand-picked list; nothing when the list is for another market."""
    if market != list_market:
        return universe.limit(0)
    return universe_for(universe, market).where(F.col("symbol").isin(symbols))


def fingerprint_rows(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.round(F.max_by("close", "date"), 6).alias("last_close"),
    )


#: Digests are sums modulo this, so they merge in any order and can be taken back.
DIGEST_MODULUS = 1 << 60
_DIGEST_PARTS = ("a", "b")


def bar_digests(bars: DataFrame) -> DataFrame:
    """(year, rows, a, b): a multiset digest of the bars of every year.

    Every bar is hashed on its own and the hashes are summed, so neither an
    order nor a task that sees a year whole is needed.  Digests of disjoint
    tables add up (:func:`merged_digests`), and taking rows back subtracts
    them, so a new year is digested alone.  Prices count to six decimals.
    """
    whole = [F.round(F.col(c) * 1_000_000).cast("long").cast("string") for c in ("open", "high", "low", "close", "volume")]
    line = F.concat_ws("|", F.col("symbol").cast("string"), F.col("date").cast("string"), *[F.coalesce(c, F.lit("-")) for c in whole])
    digest = F.md5(line)

    def part(first: int) -> Column:
        return F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(20,0)")

    hashed = bars.select(F.year("date").alias("year"), part(1).alias("a"), part(17).alias("b"))
    sums = [(F.sum(c) % F.lit(DIGEST_MODULUS)).cast("long").alias(c) for c in _DIGEST_PARTS]
    return hashed.groupBy("year").agg(F.count("*").alias("rows"), *sums)


def merged_digests(*parts: DataFrame, less: DataFrame | None = None) -> DataFrame:
    """Digests of the union of disjoint tables, without the rows of ``less``."""
    signed = [p.select("year", "rows", *_DIGEST_PARTS) for p in parts]
    if less is not None:
        signed.append(less.select("year", (-F.col("rows")).alias("rows"), *[(-F.col(c)).alias(c) for c in _DIGEST_PARTS]))
    both = reduce(lambda x, y: x.unionByName(y), signed)
    sums = [F.pmod(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(DIGEST_MODULUS)).cast("long").alias(c) for c in _DIGEST_PARTS]
    return both.groupBy("year").agg(F.sum("rows").alias("rows"), *sums).where(F.col("rows") != 0)


def fingerprint(digests: DataFrame) -> DataFrame:
    """Twelve hex digits that name the content of the digested bars, one row."""
    sums = [F.coalesce(F.pmod(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(DIGEST_MODULUS)).cast("long"), F.lit(0).cast("long")).alias(c) for c in _DIGEST_PARTS]
    whole = digests.agg(F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"), *sums)
    return whole.select(F.substring(F.sha2(F.concat_ws("|", "rows", *_DIGEST_PARTS), 256), 1, 12).alias("fingerprint"), "rows")


def data_fingerprint(bars: DataFrame) -> DataFrame:
    return fingerprint(bar_digests(bars))


def date_range(bars: DataFrame) -> DataFrame:
    return bars.agg(F.min("date").alias("start"), F.max("date").alias("end"))


def lookback_start(start: date, lookback: int) -> date:
    """First calendar day to read so that ``lookback`` bars precede ``start``, without looking at a calendar."""
    days = max(60, -(-lookback * 8 // 5))
    return start - timedelta(days=days)


def strategy_lookback(strategy: Strategy, columns: list[str] | None = None) -> float:
    """Bars before a bar that a strategy's entry, stop and target depend on."""
    ex = strategy.exit
    names = list(strategy.indicators)
    if ex.stop.type == "atr":
        names.append(f"atr_{ex.stop.atr_period or 14}")
    goal = (ex.target.target or "").strip().lower().removeprefix("ma")
    average = int(goal) - 1 if goal.isdigit() else 0
    return max(lookback(names, columns), average, warmup_bars(names))


def read_widened(spark: SparkSession, path: str, start: date, end: date, bars_before: float) -> DataFrame:
    """A stored bar table from ``start`` to ``end`` with ``bars_before`` bars of every symbol ahead of it.

    Each symbol's first day is taken by rank from its own trading days, which
    only reads two columns; the earliest of them picks the year partitions, so
    that older years are not read.  Symbols with fewer bars come whole.
    """
    if start > end:
        raise ValueError(f"start {start} is after end {end}")
    stored = spark.read.parquet(path)
    upto = stored.where((F.col("year") <= end.year) & (F.col("date") <= F.lit(end)))
    if math.isinf(bars_before):
        return upto.drop("year")
    if bars_before <= 0:
        return upto.where((F.col("year") >= start.year) & (F.col("date") >= F.lit(start))).drop("year")
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    ahead = stored.where((F.col("year") <= start.year) & (F.col("date") < F.lit(start))).select("symbol", "date")
    near = ahead.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= int(bars_before))
    firsts = stage(near.groupBy("symbol").agg(F.min("date").alias("_first")))
    earliest = firsts.agg(F.min("_first")).first()[0] or start  # one day
    wide = upto.where((F.col("year") >= earliest.year) & (F.col("date") >= F.lit(earliest))).drop("year")
    # a symbol without bars before the range starts in it
    return wide.join(firsts, "symbol", "left").where(F.col("date") >= F.coalesce("_first", F.lit(start))).drop("_first")


# ── tick tables ──────────────────────────────────────────────────────────────


def bars_from_ticks(ticks: DataFrame, order: list[str]) -> DataFrame:
    """Daily bars from ticks(symbol, date, price, size); ``order`` ranks a day's ticks.

    Ticks are combined per day before the shuffle, so a busy symbol costs no
    more than its days.  A single fixed-width order column keeps this a hash
    aggregation; several columns form a struct, which Spark aggregates by
    sorting.
    """
    key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    daily = ticks.groupBy("symbol", "date").agg(
        F.min_by("price", key).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", key).alias("close"),
        F.sum("size").alias("volume"),
    )
    return daily.withColumn("prev_close", F.lag("close", 1).over(by_symbol()))


def benchmark_from_bars(bars: DataFrame) -> DataFrame:
    """Equal-weight index: mean close, high and low of all symbols per date."""
    return bars.groupBy("date").agg(
        F.avg("close").alias("close"), F.avg("high").alias("high"), F.avg("low").alias("low")
    )


def plain_code(symbol: Column) -> Column:
    """An A-share code without blanks, exchange suffix and exchange prefix, in capitals."""
    code = F.upper(F.trim(symbol))
    for suffix in (".SZ", ".SS", ".SH"):
        code = F.when(code.endswith(suffix), F.substring(code, F.lit(1), F.length(code) - len(suffix))).otherwise(code)
    for prefix in ("SZ", "SH", "SS"):
        code = F.when(code.startswith(prefix) & (F.length(code) > 2), F.substring(code, F.lit(3), F.length(code))).otherwise(code)
    return code


def exchange_code(symbol: Column) -> Column:
    """A six-digit code with its exchange: Shanghai for 6 and 9, Shenzhen for the rest; others as they are."""
    shanghai = F.substring(symbol, 1, 1).isin("6", "9")
    return F.when(symbol.rlike("^[0-9]{6}$"), F.concat(symbol, F.when(shanghai, ".SS").otherwise(".SZ"))).otherwise(symbol)
