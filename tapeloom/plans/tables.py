"""The given tables seen as ticks, bars, a universe and news."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.runtime import dealt, with_row
from tapeloom.sources.bars import bars_from_ticks, benchmark_from_bars

TICK_ORDER = ["seq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor((100 + 5 * F.ln(F.col("l_extendedprice") / F.col("l_quantity"))) * 10000 + 0.5) / 10000
    base = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        price.alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"),
    )
    # (order, line, part, price) as one number: line numbers have one digit,
    # prices seven, part keys up to eleven
    head = (F.col("k1") * 10 + F.col("k2")).cast("decimal(19,0)") * F.lit(Decimal(10**18)).cast("decimal(19,0)")
    tail = F.col("k3") * 10_000_000 + (F.col("price") * 10000 + 0.5).cast("long")
    return base.withColumn("seq", (head + tail.cast("decimal(19,0)")).cast("decimal(38,0)"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), TICK_ORDER)


def bars_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars for scans of whole symbols, dealt by symbol; a bar has a tick or more."""
    return dealt(bars(spark, sf_dir), "symbol", table(spark, sf_dir, "lineitem").count())


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_from_bars(bars(spark, sf_dir))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stocks: nation is the sector, traded value the market cap."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cap = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("market_cap"))
    )
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(cap, "s_suppkey", "left")
        .select(
            F.col("s_suppkey").alias("symbol"),
            F.col("s_name").alias("name"),
            F.lit("us").alias("market"),
            F.col("n_name").alias("sector"),
            "market_cap",
            F.lit(False).alias("is_st"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: whole texts, spread over the symbols and one year of dates."""
    docs = table(spark, sf_dir, "documents")
    size = table(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"))
    return with_row(docs, size).select(
        F.pmod("doc_id", "_n").alias("symbol"),
        F.date_add(F.lit("1998-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(365)).cast("int")).alias("date"),
        F.col("source").alias("title"),
        F.col("text").alias("summary"),
    )


# Equivalent definitions for the SQL check.
SQL_BARS = """
ticks AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         floor((100 + 5 * ln(CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE))) * 10000 + 0.5) / 10000 AS price,
         CAST(l_quantity AS DOUBLE) AS size, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3
  FROM lineitem),
daily AS (
  SELECT symbol, date,
         first(price ORDER BY k1, k2, k3, price, size) AS open,
         max(price) AS high, min(price) AS low,
         first(price ORDER BY k1 DESC, k2 DESC, k3 DESC, price DESC, size DESC) AS close,
         sum(size) AS volume
  FROM ticks GROUP BY symbol, date),
bars AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close,
         row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx
  FROM daily)"""

SQL_BENCH = """
bench AS (
  SELECT date, avg(close) AS close, avg(high) AS high, avg(low) AS low,
         row_number() OVER (ORDER BY date) - 1 AS bidx
  FROM bars GROUP BY date)"""

SQL_UNIVERSE = """
universe AS (
  SELECT s_suppkey AS symbol, s_name AS name, 'us' AS market, n_name AS sector, cap AS market_cap, false AS is_st
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cap
             FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"""


def with_ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)
