"""Robustness of a trade table: splits, folds, holdouts and purged paths.

One distributed numbering of the trades in date order serves all of them.  It
carries the running number of wins, so any split needs only the values at its
few border positions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.metrics import win, win_share
from tapeloom.operators.ordered import running

MIN_SPLIT = 5
DATE_ORDER = ["signal_date", "symbol", "signal_idx"]


def numbered(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rn`` (position by date) and ``wins`` (wins up to it) per key."""
    slim = trades.select(*keys, *DATE_ORDER, "return_pct")
    return running(
        slim,
        keys,
        DATE_ORDER,
        {"rn": F.lit(1), "wins": win().cast("int")},
    )


def _size(order: DataFrame, keys: list[str]) -> DataFrame:
    return order.groupBy(*keys).agg(F.count("*").alias("n"))


def _wins_at(order: DataFrame, spots: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """Attach the running wins at one position per row of ``spots`` (0 at position 0)."""
    marks = order.select(*keys, F.col("rn").alias(pos), F.col("wins").alias(name))
    joined = spots.join(marks, [*keys, pos], "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0)))


def yearly_consistency(trades: DataFrame, keys: list[str]) -> DataFrame:
    per_year = (
        trades.groupBy(*keys, F.year("signal_date").alias("_y"))
        .agg(F.count("*").alias("_n"), win_share().alias("_wr"))
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("_n") >= MIN_SPLIT).alias("years"),
            F.avg(F.when(F.col("_n") >= MIN_SPLIT, F.col("_wr"))).alias("mean"),
            F.stddev_samp(F.when(F.col("_n") >= MIN_SPLIT, F.col("_wr"))).alias("std"),
        )
    )
    steady = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("std") / F.nullif("mean", F.lit(0.0))))
    value = F.when(F.col("years") < 2, 0.5).when(F.col("mean") == 0, 0.0).otherwise(steady)
    return per_year.select(*keys, value.alias("yearly_consistency"))


def split_gaps(trades: DataFrame, keys: list[str], order: DataFrame | None = None) -> DataFrame:
    """Chronological 60/20/20 win rates, their gaps and yearly consistency."""
    order = numbered(trades, keys) if order is None else order
    cuts = _size(order, keys).select(
        *keys,
        "n",
        F.floor(F.col("n") * 0.6).alias("p1"),
        F.floor(F.col("n") * (0.6 + 0.2)).alias("p2"),
        F.col("n").alias("p3"),
    )
    for i in (1, 2, 3):
        cuts = _wins_at(order, cuts, keys, f"p{i}", f"w{i}")

    def rate(wins: Column, size: Column) -> Column:
        return F.coalesce(wins / F.nullif(size, F.lit(0)), F.lit(0.0))

    train = rate(F.col("w1"), F.col("p1"))
    val = rate(F.col("w2") - F.col("w1"), F.col("p2") - F.col("p1"))
    test = rate(F.col("w3") - F.col("w2"), F.col("p3") - F.col("p2"))
    enough = F.col("n") >= 3 * MIN_SPLIT

    def kept(c: Column) -> Column:
        return F.when(enough, F.round(c, 4)).otherwise(0.0)

    steady = F.when(enough, F.round("yearly_consistency", 4)).otherwise(0.5)
    return cuts.join(yearly_consistency(trades, keys), keys).select(
        *keys,
        kept(train).alias("train_win_rate"),
        kept(val).alias("val_win_rate"),
        kept(test).alias("test_win_rate"),
        kept(F.abs(train - val)).alias("train_val_gap"),
        kept(F.abs(val - test)).alias("val_test_gap"),
        steady.alias("yearly_consistency"),
        F.lit(0.0).alias("param_sensitivity"),
    )


def is_overfit() -> Column:
    return (
        (F.col("train_val_gap") > 0.15)
        | (F.col("val_test_gap") > 0.10)
        | (F.col("param_sensitivity") > 0.3)
    )


def walk_forward(
    trades: DataFrame,
    keys: list[str],
    *,
    folds: int = 3,
    train_pct: float = 0.7,
    order: DataFrame | None = None,
) -> DataFrame:
    """Expanding train, fixed test: one row per fold."""
    order = numbered(trades, keys) if order is None else order
    n = F.col("n")
    first = F.greatest(F.lit(MIN_SPLIT), F.floor(n * train_pct))
    rest = n - F.col("first")
    size = F.greatest(F.lit(MIN_SPLIT), F.floor(rest / max(folds, 1)))
    plan = (
        _size(order, keys)
        .where(n >= 2 * MIN_SPLIT)
        .withColumn("first", first)
        .where(rest >= MIN_SPLIT)
        .withColumn("size", size)
        .withColumn("fold_num", F.explode(F.sequence(F.lit(1), F.lit(folds))))
        .withColumn("train_end", F.col("first") + (F.col("fold_num") - 1) * F.col("size"))
        .where(F.col("train_end") + MIN_SPLIT <= n)
        .withColumn("test_end", F.least(n, F.col("train_end") + F.col("size")))
    )
    plan = _wins_at(order, plan, keys, "train_end", "w_train")
    plan = _wins_at(order, plan, keys, "test_end", "w_test")
    tested = F.col("test_end") - F.col("train_end")
    train, test = F.col("w_train") / F.col("train_end"), (F.col("w_test") - F.col("w_train")) / tested
    return plan.select(
        *keys,
        "fold_num",
        F.col("train_end").cast("long").alias("train_signal_count"),
        tested.cast("long").alias("test_signal_count"),
        F.round(train, 4).alias("train_win_rate"),
        F.round(test, 4).alias("test_win_rate"),
        F.round(F.abs(train - test), 4).alias("gap"),
    )


def walk_forward_summary(folds: DataFrame, keys: list[str], pass_gap: float = 0.10) -> DataFrame:
    return folds.groupBy(*keys).agg(
        F.count("*").alias("effective_folds"),
        F.round(F.avg("gap"), 4).alias("walk_forward_gap"),
        F.round(F.avg((F.col("gap") <= pass_gap).cast("double")), 4).alias("walk_forward_pass_rate"),
    )


def regime_holdout(trades: DataFrame, keys: list[str], preferred: tuple[str, ...] = ()) -> DataFrame:
    """Each regime against all others; totals minus own counts, no re-scan."""
    per = (
        trades.where(F.col("regime").isNotNull())
        .groupBy(*keys, "regime")
        .agg(F.count("*").alias("n"), F.count_if(win()).alias("w"))
    )
    whole = Window.partitionBy(*keys)  # one row per regime
    cases = per.select(
        "*",
        (F.sum("n").over(whole) - F.col("n")).alias("n_in"),
        (F.sum("w").over(whole) - F.col("w")).alias("w_in"),
        F.count("*").over(whole).alias("regimes"),
    ).where((F.col("regimes") >= 2) & (F.col("n") >= MIN_SPLIT) & (F.col("n_in") >= MIN_SPLIT))
    inside, held = F.col("w_in") / F.col("n_in"), F.col("w") / F.col("n")
    return cases.select(
        *keys,
        "regime",
        F.col("regime").isin(list(preferred)).alias("preferred") if preferred else F.lit(False).alias("preferred"),
        F.col("n_in").alias("in_sample_signal_count"),
        F.col("n").alias("holdout_signal_count"),
        F.round(inside, 4).alias("in_sample_win_rate"),
        F.round(held, 4).alias("holdout_win_rate"),
        F.round(F.abs(inside - held), 4).alias("gap"),
    )


def regime_holdout_summary(cases: DataFrame, keys: list[str], pass_gap: float = 0.10) -> DataFrame:
    return cases.groupBy(*keys).agg(
        F.count("*").alias("total_cases"),
        F.round(F.avg((F.col("gap") <= pass_gap).cast("double")), 4).alias("pass_rate"),
        F.round(F.max("gap"), 4).alias("worst_gap"),
        F.max_by("regime", "gap").alias("worst_regime"),
    )


def cpcv_paths(
    trades: DataFrame,
    keys: list[str],
    *,
    groups: int = 6,
    test_groups: int = 2,
    purge_days: int = 5,
    order: DataFrame | None = None,
) -> DataFrame:
    """Purged cross-validation: one row per choice of ``test_groups`` out of ``groups``.

    Groups follow each other in time.  Of a group that is trained on, the test
    groups' purge zones take a head and a tail: those of the nearest test group
    before and after it, as farther ones reach less far.  So what a group keeps
    is worked out once for every such pair of neighbours, from its counts per
    day, and a path adds up one number a group.
    """
    if not 0 < test_groups < groups:
        raise ValueError("test_groups must lie between 0 and groups")
    order = numbered(trades, keys) if order is None else order
    sizes = _size(order, keys).where(F.col("n") >= groups * MIN_SPLIT)
    sizes = sizes.withColumn("size", F.floor(F.col("n") / groups))
    part = F.least(F.floor((F.col("rn") - 1) / F.col("size")), F.lit(groups - 1)).cast("int")
    days = (
        order.join(sizes, keys)
        .groupBy(*keys, part.alias("g"), "signal_date")
        .agg(F.count("*").alias("n"), F.count_if(win()).alias("w"))
    )
    per_group = days.groupBy(*keys, "g").agg(
        F.min("signal_date").alias("first"), F.max("signal_date").alias("last"), F.sum("n").alias("n"), F.sum("w").alias("w"),
        F.collect_list(F.struct("signal_date", "n", "w")).alias("days"),  # one entry per calendar day
    )
    # ``groups`` entries per key
    rows = per_group.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("g", "first", "last", "n", "w", "days"))).alias("_g"))

    def group(i: int) -> Column:
        return F.get(F.col("_g"), F.lit(i))

    def kept(g: int, before: int | None, after: int | None) -> Column:
        def outside(d: Column) -> Column:
            ok = F.lit(True)
            if before is not None:
                ok = ok & (d["signal_date"] > F.date_add(group(before)["last"], purge_days))
            if after is not None:
                ok = ok & (d["signal_date"] < F.date_sub(group(after)["first"], purge_days))
            return ok

        nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"))
        add = lambda acc, d: F.struct((acc["n"] + d["n"]).alias("n"), (acc["w"] + d["w"]).alias("w"))
        return F.aggregate(F.filter(group(g)["days"], outside), nothing, add)

    neighbours: dict[tuple, int] = {}
    paths = []
    for tested in combinations(range(groups), test_groups):
        trained = []
        for g in set(range(groups)) - set(tested):
            near = (g, max((x for x in tested if x < g), default=None), min((x for x in tested if x > g), default=None))
            trained.append(neighbours.setdefault(near, len(neighbours)))
        paths.append((tested, trained))
    rows = rows.withColumn("_kept", F.array(*[kept(*near) for near in neighbours]))

    def total(parts: list[Column], field: str) -> Column:
        return reduce(lambda x, y: x + y, [p[field] for p in parts])

    def path(tested: tuple[int, ...], trained: list[int]) -> Column:
        test, train = [group(i) for i in tested], [F.get(F.col("_kept"), F.lit(i)) for i in trained]
        sums = {"train_n": total(train, "n"), "train_w": total(train, "w"), "test_n": total(test, "n"), "test_w": total(test, "w")}
        return F.struct(F.array(*[F.lit(i) for i in tested]).alias("tested"), *[v.alias(k) for k, v in sums.items()])

    listed = rows.select(*keys, F.explode(F.array(*[path(*p) for p in paths])).alias("_p")).select(*keys, "_p.*")
    named = [F.get("tested", F.lit(i)).alias(f"g{i + 1}") for i in range(test_groups)]
    counted = listed.where((F.col("train_n") >= MIN_SPLIT) & (F.col("test_n") >= MIN_SPLIT))
    return counted.select(
        *keys,
        *named,
        "train_n",
        "test_n",
        (F.col("train_w") / F.col("train_n")).alias("train_win_rate"),
        (F.col("test_w") / F.col("test_n")).alias("test_win_rate"),
    ).withColumn("gap", F.abs(F.col("train_win_rate") - F.col("test_win_rate")))


def cpcv(paths: DataFrame, keys: list[str]) -> DataFrame:
    return paths.groupBy(*keys).agg(
        F.count("*").alias("n_paths"),
        F.round(F.avg("gap"), 4).alias("mean_gap"),
        F.round(F.max("gap"), 4).alias("max_gap"),
        F.round(F.avg("test_win_rate"), 4).alias("mean_test_win_rate"),
        F.round(F.coalesce(F.stddev_samp("test_win_rate"), F.lit(0.0)), 4).alias("std_test_win_rate"),
    )


def purged_train(trades: DataFrame, ranges: DataFrame, purge_days: int = 5) -> DataFrame:
    """Trades outside every test range widened by the purge (anti interval join).

    Ranges collapse to the distinct dates they cover, which the calendar bounds,
    so the anti join is an equi join on the date.
    """
    covered = ranges.select(
        F.explode(
            F.sequence(F.date_sub("start_date", purge_days), F.date_add("end_date", purge_days))
        ).alias("signal_date")
    ).distinct()
    return trades.join(covered, "signal_date", "left_anti")
