"""Joins of index, universe, sector and market context onto bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.regime import coarse_regime, with_regime
from tapeloom.runtime import with_row


def join_benchmark(bars: DataFrame, benchmark: DataFrame, *, by: str = "date", columns: tuple[str, ...] = ("close",)) -> DataFrame:
    """Left join of index columns as ``bench_<column>``.

    ``by="date"`` aligns days; ``by="position"`` aligns the n-th bars.  The
    index has one row per calendar day, so Spark broadcasts it by size.
    """
    side = benchmark.select("date", *[F.col(c).alias(f"bench_{c}") for c in columns])
    if by == "date":
        return bars.join(side, "date", "left")
    numbered = side.select(
        (F.row_number().over(Window.orderBy("date")) - 1).alias("_pos"), *[f"bench_{c}" for c in columns]
    )
    own = Window.partitionBy("symbol").orderBy("date")
    placed = bars.withColumn("_pos", F.row_number().over(own) - 1)
    return placed.join(numbered, "_pos", "left").drop("_pos")


def join_index_regime(bars: DataFrame, benchmark: DataFrame, *, by: str = "date") -> DataFrame:
    """Regime of the index on each bar; past its end its last regime holds."""
    labelled = with_regime(benchmark.withColumn("_all", F.lit(0)), ["_all"]).select("date", "regime")
    if by == "date":
        end = labelled.agg(F.max("date").alias("_end"), F.max_by("regime", "date").alias("_held"))
        joined = with_row(bars.join(labelled, "date", "left"), end)
        held = F.when(F.col("date") > F.col("_end"), F.col("_held")).otherwise(F.col("regime"))
        return joined.withColumn("regime", held).drop("_end", "_held")
    w = Window.orderBy("date")
    numbered = labelled.select((F.row_number().over(w) - 1).alias("_pos"), "regime")
    last = numbered.agg(F.max("_pos").alias("_end"))
    own = Window.partitionBy("symbol").orderBy("date")
    placed = with_row(bars.withColumn("_i", F.row_number().over(own) - 1), last)
    placed = placed.withColumn("_pos", F.least("_i", "_end"))
    return placed.join(numbered, "_pos", "left").drop("_pos", "_i", "_end")


def join_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Sector, name and ST flag by symbol; bars keep their partitioning."""
    side = universe.select("symbol", *[c for c in ("name", "sector", "market_cap", "is_st") if c in universe.columns])
    return bars.drop("name").join(side, "symbol", "left")


def join_sectors(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sector facts as ``sector_<fact>`` columns."""
    names = {
        "heat_rank": "sector_heat_rank",
        "rising_days": "sector_rising_days",
        "net_inflow": "sector_net_inflow",
        "net_inflow_days": "sector_net_inflow_days",
        "risk_flag": "sector_risk_flag",
        "change_pct": "sector_change_pct",
    }
    side = sectors.select(F.col("name").alias("sector"), *[F.col(k).alias(v) for k, v in names.items() if k in sectors.columns])
    return bars.join(side, "sector", "left")


def join_market(bars: DataFrame, market: DataFrame) -> DataFrame:
    return bars.join(market, "date", "left")


def select_sector(boards: DataFrame) -> DataFrame:
    """One board per symbol: the first industry board, else the first board."""
    industry = F.col("board_type").rlike("行业|industry|INDUSTRY")
    order = F.struct((~F.coalesce(industry, F.lit(False))).alias("other"), F.col("position"))
    named = boards.where(F.length(F.trim("board_name")) > 0)
    return named.groupBy("symbol").agg(F.min_by(F.trim("board_name"), order).alias("sector"))


def match_sector_rank(sectors: DataFrame, top: list[str], bottom: list[str]) -> DataFrame:
    """Heat rank of each sector name against a leader and a laggard list.

    Both lists are short constants, so the match is a projection: the first
    entry that is equal or contained either way.
    """
    name = F.col("sector")
    ranked = [(n, i + 1, False) for i, n in enumerate(top)]
    ranked += [(n, len(top) + i + 1, True) for i, n in enumerate(bottom)]
    rank, risk = F.lit(None).cast("int"), F.lit(False)
    for listed, place, last in reversed(ranked):
        if not listed:
            continue
        # an empty name is contained in every other and matches none
        same = (F.length(name) > 0) & ((F.lower(name) == listed.lower()) | name.contains(listed) | F.lit(listed).contains(name))
        rank = F.when(same, place).otherwise(rank)
        risk = F.when(same, last).otherwise(risk)
    return sectors.withColumns({"heat_rank": rank, "risk_flag": risk})


GRAM = 3


def _pieces(name: Column, wide: Column) -> Column:
    """All pieces of ``wide`` characters of a name that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(name) - wide + 1), lambda i: F.substring(name, i, wide))


def _grams(name: Column) -> Column:
    """All distinct pieces of up to ``GRAM`` characters."""
    none = F.array().cast("array<string>")
    sizes = [F.when(F.length(name) >= n, _pieces(name, F.lit(n))).otherwise(none) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.flatten(F.array(*sizes)))


def _full_grams(name: Column) -> Column:
    """Pieces of ``GRAM`` characters, or the whole name if it is shorter."""
    return F.array_distinct(_pieces(name, F.least(F.length(name), F.lit(GRAM))))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer): names of one column ``name`` each, the first inside the second.

    A name inside another has all its pieces there, so the one that the fewest
    outer names have is enough to find every candidate, which ``contains`` then
    decides.
    """
    index = outer.select(F.col("name").alias("outer"), F.explode(_grams(F.col("name"))).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = inner.select(F.col("name").alias("inner"), F.explode(_full_grams(F.col("name"))).alias("gram")).join(counts, "gram", "left")
    # a piece that no outer name has rules its name out
    rarest = pieces.groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return rarest.join(index, "gram").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def match_board_rank(sectors: DataFrame, board: DataFrame) -> DataFrame:
    """Heat rank of each sector name against a board (name, heat_rank, risk_flag) of any length.

    The best-ranked entry that is equal without regard to case or contained
    either way; null and empty names match nothing.
    """
    listed = board.where(F.length("name") > 0)
    entries = listed.select("name").distinct()
    names = sectors.select(F.col("sector").alias("name")).where(F.length("name") > 0).distinct()
    low = F.lower("name").alias("low")
    same = names.select(F.col("name").alias("sector"), low).join(entries.select("name", low), "low").select("sector", "name")
    around = _contained(entries, names).select(F.col("outer").alias("sector"), F.col("inner").alias("name"))
    within = _contained(names, entries).select(F.col("inner").alias("sector"), F.col("outer").alias("name"))
    pairs = same.union(around).union(within).distinct().join(listed, "name")
    best = pairs.groupBy("sector").agg(F.min(F.struct("heat_rank", "risk_flag")).alias("_best"))
    return sectors.join(best, "sector", "left").select(
        *sectors.columns, F.col("_best.heat_rank").cast("int").alias("heat_rank"), F.coalesce("_best.risk_flag", F.lit(False)).alias("risk_flag")
    )


def market_breadth(bars: DataFrame, *, limit: float = 0.098) -> DataFrame:
    """Per date: share of rising symbols and a sentiment index."""
    move = (F.col("close") - F.col("prev_close")) / F.nullif(F.col("prev_close"), F.lit(0.0))
    day = bars.where(F.col("prev_close").isNotNull()).groupBy("date").agg(
        F.count_if(move > 0).alias("up_count"),
        F.count_if(move < 0).alias("down_count"),
        F.count_if(move == 0).alias("flat_count"),
        F.count_if(move >= limit).alias("limit_up_count"),
        F.count_if(move <= -limit).alias("limit_down_count"),
    )
    active = F.col("up_count") + F.col("down_count")
    breadth = F.col("up_count") / F.nullif(active, F.lit(0))
    pressure = (F.col("limit_up_count") - F.col("limit_down_count")) / (active + F.col("flat_count"))
    mood = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (breadth - 0.5) * 0.8 + pressure * 2))
    return day.withColumns({"breadth": F.round(breadth, 4), "sentiment_index": F.round(mood, 4)})


# Names in a leader and in a laggard list.
BOARD_NAMES = 5


def leaders_and_laggards(sectors: DataFrame, names: int = BOARD_NAMES) -> DataFrame:
    """Per date: the sectors that rose and fell most, from (date, sector, change_pct).

    Each list is cut to its length by a ranked filter before it is collected;
    sectors of equal change stand by name, unnamed and unknown ones in no list.
    """
    known = sectors.where((F.length("sector") > 0) & F.col("change_pct").isNotNull())
    up = Window.partitionBy("date").orderBy(F.col("change_pct").desc(), "sector")
    down = Window.partitionBy("date").orderBy("change_pct", "sector")

    def side(order: Window, name: str) -> DataFrame:
        ranked = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= names)
        listed = F.sort_array(F.collect_list(F.struct("_n", "sector")))
        return ranked.groupBy("date").agg(F.transform(listed, lambda x: x["sector"]).alias(name))

    return side(up, "sector_leaders").join(side(down, "sector_laggards"), "date")


def market_context(benchmark: DataFrame, provider: DataFrame | None = None, boards: DataFrame | None = None) -> DataFrame:
    """Per date: index change and regime, merged with provider values.

    The provider's change wins, the index's regime wins.  ``boards`` (see
    :func:`leaders_and_laggards`) adds both lists, empty where a date has none.
    """
    if boards is not None:
        none = F.array().cast("array<string>")
        joined = market_context(benchmark, provider).join(boards, "date", "left")
        return joined.withColumns({c: F.coalesce(c, none) for c in ("sector_leaders", "sector_laggards")})
    w = Window.orderBy("date")  # one row per calendar day
    before = F.lag("close", 1).over(w)
    change = F.when(before > 0, F.round((F.col("close") - before) / before, 4))
    own = with_regime(benchmark.withColumn("_all", F.lit(0)), ["_all"])
    own = own.select("date", change.alias("index_change_pct"), "regime")
    if provider is None:
        return own.withColumns({"breadth": F.lit(None).cast("double"), "sentiment_index": F.lit(None).cast("double")})
    side = provider.select(
        "date",
        F.col("index_change_pct").alias("_move") if "index_change_pct" in provider.columns else F.lit(None).cast("double").alias("_move"),
        F.col("breadth"),
        F.col("sentiment_index"),
    ).withColumn("_regime", coarse_regime(F.col("_move"), F.col("breadth")))
    return own.join(side, "date", "full").select(
        "date",
        F.coalesce("_move", "index_change_pct").alias("index_change_pct"),
        "breadth",
        F.coalesce("regime", "_regime").alias("regime"),
        "sentiment_index",
    )
