"""Scores, gates, verdicts and rankings over evaluation tables.

An evaluation row carries the trade metrics, the split gaps and, when folds were
computed, ``walk_forward_gap`` and ``walk_forward_pass_rate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators.metrics import clamp
from tapeloom.operators.robust import is_overfit
from tapeloom.runtime import stage, with_row

OBJECTIVES = (
    "confidence",
    "win_rate",
    "avg_return",
    "drawdown",
    "quality",
    "profit_quality",
    "robust_profit_quality",
)


def _scaled(name: str, base: float, span: float) -> Column:
    return clamp((F.col(name) - base) / span)


def _drawdown(limit: float) -> Column:
    return clamp(1 - F.col("max_drawdown") / limit)


def _trust() -> Column:
    return clamp(F.col("signal_count") / 30.0)


def quality_score() -> Column:
    raw = (
        0.30 * _scaled("win_rate", 0.45, 0.15)
        + 0.30 * _scaled("avg_return", 0.0, 0.02)
        + 0.20 * _scaled("profit_loss_ratio", 1.0, 1.0)
        + 0.20 * _drawdown(0.40)
    )
    return F.round(raw * _trust(), 6)


def profit_quality_score() -> Column:
    raw = (
        0.35 * _scaled("avg_return", 0.0, 0.015)
        + 0.20 * _scaled("total_return", 0.0, 0.20)
        + 0.20 * _scaled("profit_loss_ratio", 1.0, 1.5)
        + 0.15 * _scaled("win_rate", 0.45, 0.15)
        + 0.10 * _drawdown(0.35)
    )
    poor = (F.col("avg_return") <= 0) | (F.col("profit_loss_ratio") < 1.0)
    return F.round(raw * F.when(poor, 0.25).otherwise(1.0) * _trust(), 6)


def robustness_score(columns: list[str]) -> Column:
    """Walk-forward parts are neutral where no folds were computed."""
    fold_gap, fold_pass = F.lit(0.65), F.lit(0.65)
    if "walk_forward_gap" in columns:
        fold_gap = F.coalesce(clamp(1 - F.col("walk_forward_gap") / 0.25), F.lit(0.65))
        fold_pass = F.coalesce(clamp(F.col("walk_forward_pass_rate")), F.lit(0.65))
    return F.round(
        0.30 * clamp(1 - F.col("train_val_gap") / 0.20)
        + 0.25 * clamp(1 - F.col("val_test_gap") / 0.15)
        + 0.20 * fold_gap
        + 0.15 * fold_pass
        + 0.10 * F.when(is_overfit(), 0.0).otherwise(1.0),
        6,
    )


def high_win_return_score() -> Column:
    raw = (
        0.30 * _scaled("win_rate", 0.45, 0.15)
        + 0.30 * _scaled("avg_return", 0.0, 0.02)
        + 0.25 * _scaled("total_return", 0.0, 0.50)
        + 0.10 * _scaled("profit_loss_ratio", 1.0, 1.5)
        + 0.05 * _drawdown(0.35)
    )
    return F.round(raw * _trust(), 6)


def with_scores(evals: DataFrame) -> DataFrame:
    df = evals.withColumns(
        {
            "quality": quality_score(),
            "profit_quality": profit_quality_score(),
            "robustness": robustness_score(evals.columns),
        }
    )
    return df.withColumn(
        "robust_profit_quality", F.round(0.65 * F.col("profit_quality") + 0.35 * F.col("robustness"), 6)
    )


def objective(name: str) -> Column:
    key = name.strip().lower()
    if key not in OBJECTIVES:
        raise ValueError(f"unsupported objective {name}; one of {', '.join(OBJECTIVES)}")
    if key == "drawdown":
        return -F.col("max_drawdown")
    return F.col("confidence_score" if key == "confidence" else key)


def gate_reasons(
    *,
    min_win_rate: float | None = None,
    min_avg_return: float | None = None,
    min_total_return: float | None = None,
    min_profit_loss_ratio: float | None = None,
    max_drawdown: float | None = None,
    min_signals: int | None = None,
    reject_overfit: bool = False,
    max_train_val_gap: float | None = None,
    max_val_test_gap: float | None = None,
    max_walk_forward_gap: float | None = None,
    min_walk_forward_pass_rate: float | None = None,
    full: bool = True,
) -> Column:
    """Array of failed gates; robust gates need a full evaluation."""

    def below(name: str, limit: float | None, text: str) -> list[Column]:
        return [] if limit is None else [F.when(F.col(name) < limit, text)]

    def above(name: str, limit: float | None, text: str) -> list[Column]:
        return [] if limit is None else [F.when(F.col(name) > limit, text)]

    def show(v: float | None, spec: str) -> str:
        return "" if v is None else format(v, spec)

    plain = [
        *below("win_rate", min_win_rate, f"win_rate<{show(min_win_rate, '.1%')}"),
        *below("avg_return", min_avg_return, f"avg_return<{show(min_avg_return, '.2%')}"),
        *below("total_return", min_total_return, f"total_return<{show(min_total_return, '.2%')}"),
        *below("profit_loss_ratio", min_profit_loss_ratio, f"profit_loss_ratio<{show(min_profit_loss_ratio, '.2f')}"),
        *above("max_drawdown", max_drawdown, f"max_drawdown>{show(max_drawdown, '.1%')}"),
        *below("signal_count", min_signals, f"signals<{min_signals}"),
    ]
    robust = [
        *([F.when(is_overfit(), "overfit_detected")] if reject_overfit else []),
        *above("train_val_gap", max_train_val_gap, f"train_val_gap>{show(max_train_val_gap, '.1%')}"),
        *above("val_test_gap", max_val_test_gap, f"val_test_gap>{show(max_val_test_gap, '.1%')}"),
        *above("walk_forward_gap", max_walk_forward_gap, f"walk_forward_gap>{show(max_walk_forward_gap, '.1%')}"),
        *below(
            "walk_forward_pass_rate",
            min_walk_forward_pass_rate,
            f"walk_forward_pass_rate<{show(min_walk_forward_pass_rate, '.1%')}",
        ),
    ]
    if robust and not full:
        robust = [F.lit("full_eval_required_for_robust_gates")]
    checks = plain + robust
    if not checks:
        return F.array().cast("array<string>")
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def sort_key(goal: str) -> list[Column]:
    """The eleven ranking parts, best first."""
    parts = [
        F.col("passed_gate").cast("int"),
        objective(goal),
        F.col("robustness"),
        F.col("profit_quality"),
        F.col("quality"),
        F.col("confidence_score"),
        F.col("avg_return"),
        F.col("total_return"),
        F.col("profit_loss_ratio"),
        F.col("signal_count"),
        -F.col("max_drawdown"),
    ]
    return [c.desc() for c in parts]


def rank_candidates(evals: DataFrame, goal: str = "confidence", *, id_col: str = "candidate_id", limit: int | None = None, **gates) -> DataFrame:
    """Gate, score and order candidates; ``rank`` 1 is the best.

    The order is a distributed sort; ranks come from numbering its ranges, so a
    large candidate table never meets in one task.
    """
    scored = with_scores(evals).withColumn("gate_reasons", gate_reasons(**gates))
    scored = scored.withColumn("passed_gate", F.size("gate_reasons") == 0)
    if limit is not None:
        scored = scored.orderBy(*sort_key(goal), id_col).limit(limit)
        return scored.withColumn("rank", F.row_number().over(Window.orderBy(*sort_key(goal), id_col)))
    from tapeloom.operators.ordered import running

    order = [*sort_key(goal), F.col(id_col)]
    return running(scored, [], order, {"rank": F.lit(1)})


def diverse_seeds(ranked: DataFrame, limit: int, *, min_avg_return: float | None = None, min_total_return: float | None = None, min_profit_loss_ratio: float | None = None, min_signals: int | None = None, id_col: str = "candidate_id") -> DataFrame:
    """Best overall, then the best not yet taken per metric, then by rank.

    Each pick is a top-1 over the eligible table; five small picks are unioned.
    """
    ok = F.lit(True)
    if min_signals is not None:
        ok = ok & (F.col("signal_count") >= min_signals)
    if min_avg_return is not None:
        ok = ok & (F.col("avg_return") >= min_avg_return * 0.5)
    if min_total_return is not None:
        ok = ok & (F.col("total_return") >= min_total_return * 0.5)
    if min_profit_loss_ratio is not None:
        ok = ok & (F.col("profit_loss_ratio") >= max(0.8, min_profit_loss_ratio * 0.8))
    pool = ranked.where(ok)
    picked = ranked.where(F.col("rank") == 1).where(ok).select(id_col).withColumn("pick", F.lit(0))
    for i, name in enumerate(("win_rate", "avg_return", "total_return", "profit_loss_ratio"), start=1):
        rest = pool.join(picked.select(id_col), id_col, "left_anti")
        best = rest.orderBy(F.col(name).desc(), "rank").limit(1).select(id_col).withColumn("pick", F.lit(i))
        picked = picked.unionByName(best)
    rest = pool.join(picked.select(id_col), id_col, "left_anti").orderBy("rank").limit(limit)
    fill = rest.select(id_col, (F.col("rank") + 4).cast("int").alias("pick"))
    chosen = picked.unionByName(fill).orderBy("pick").limit(limit)
    # nothing eligible: the first ranks stand in
    none = chosen.agg((F.count("*") == 0).alias("_none"))
    spare = with_row(ranked, none).where(F.col("_none") & (F.col("rank") <= limit))
    spare = spare.select(id_col, F.col("rank").cast("int").alias("pick"))
    return ranked.join(chosen.unionByName(spare), id_col)


def high_win_return_pick(evals: DataFrame, group: list[str]) -> DataFrame:
    scored = evals.withColumn("high_win_return", high_win_return_score())
    key = F.struct(
        F.col("passed_gate").cast("int"),
        "high_win_return",
        "win_rate",
        "avg_return",
        "total_return",
        "profit_loss_ratio",
        -F.col("max_drawdown"),
    )
    return scored.groupBy(*group).agg(F.max_by(F.struct("candidate_id", "high_win_return"), key).alias("_b")).select(
        *group, "_b.*"
    )


def screened_pick(evals: DataFrame, group: list[str], *, min_signals: int = 30) -> DataFrame:
    """Best screened candidate per base; the order depends on the base's signals.

    Needs ``base_signals``, ``base_score`` and the candidate's metrics.
    """
    n, base = F.col("signal_count"), F.col("base_signals")
    enough = (n >= min_signals).cast("double")
    sound = (~is_overfit()).cast("double")
    kept = n / F.greatest(F.lit(1), base)
    delta = F.col("confidence_score") - F.col("base_score")
    sparse = F.array(
        enough, (n > base).cast("double"), n.cast("double"), sound, delta, F.col("confidence_score"), F.lit(0.0)
    )
    full = F.array(
        enough, sound, (kept >= 0.70).cast("double"), kept.cast("double"), delta, F.col("confidence_score"), n.cast("double")
    )
    key = F.when(base < min_signals, sparse).otherwise(full)
    return evals.groupBy(*group).agg(
        F.max_by(F.struct("candidate_id", "confidence_score", "signal_count"), F.struct(key.alias("k"), F.col("candidate_id"))).alias("_b")
    ).select(*group, "_b.*")


# ── verdicts ─────────────────────────────────────────────────────────────────


# Thresholds and texts of the verdicts.
GUARD_TEXTS = {
    "sparse": "Sparse-signal result (%d/%d)",
    "overfit": "Overfit detected (train_val_gap=%.1f%%)",
    "payoff": "Non-positive trade payoff (avg_return=%.2f%%, total_return=%.2f%%)",
}
ANALYST_LIMITS = {
    "signals_fail": 30, "signals_watch": 60, "payoff_watch": 1.0, "drawdown_fail": 0.45, "drawdown_watch": 0.30, "losses_watch": 8, "symbols_watch": 5,
}
ADVICE_LIMITS = {"exit_gain": 0.03, "good_win_rate": 0.52, "payoff": 1.2, "fold_gap": 0.12, "weak_win_rate": 0.45}


def promotion_guard(min_signals: int = 30) -> Column:
    """Why a version must not become champion; null when it may."""
    n = F.col("signal_count")
    unpaid = (F.col("avg_return") <= 0) & (F.col("total_return") <= 0)
    reasons = [
        (n < min_signals, F.format_string(GUARD_TEXTS["sparse"], n, F.lit(min_signals))),
        (is_overfit(), F.format_string(GUARD_TEXTS["overfit"], F.col("train_val_gap") * 100)),
        (unpaid, F.format_string(GUARD_TEXTS["payoff"], F.col("avg_return") * 100, F.col("total_return") * 100)),
    ]
    return F.coalesce(*[F.when(found, text) for found, text in reasons])


def committee(evals: DataFrame, keys: list[str], *, symbols: Column, proxy_share: Column, planned_changes: Column) -> DataFrame:
    """One row per analyst plus the overall verdict of each evaluation.

    An analyst fails an evaluation, or watches it, by the first list that has a
    true entry; the overall verdict is the worst of all.
    """
    n, low, x = F.col("signal_count"), ANALYST_LIMITS, F.col
    few = n < low["signals_fail"]
    findings: dict[str, tuple[list[Column], list[Column]]] = {
        "technical": ([few, x("avg_return") <= 0], [x("profit_loss_ratio") < low["payoff_watch"]]),
        "risk": ([x("max_drawdown") > low["drawdown_fail"]], [x("max_drawdown") > low["drawdown_watch"], x("max_consecutive_loss") >= low["losses_watch"]]),
        "overfit": ([few, is_overfit()], [n < low["signals_watch"]]),
        "data_quality": ([], [symbols < low["symbols_watch"], F.coalesce(proxy_share, F.lit(0.0)) > 0]),
        "mutation": ([], [planned_changes == 0]),
    }

    def any_of(found: list[Column]) -> Column:
        return F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in found], F.lit(False)), lambda c: c)

    def status(fails: Column, watches: Column) -> Column:
        return F.when(fails, "fail").when(watches, "watch").otherwise("pass")

    verdicts = evals.select(*keys, *[status(any_of(f), any_of(w)).alias(k) for k, (f, w) in findings.items()])
    worst = status(any_of([x(k) == "fail" for k in findings]), any_of([x(k) == "watch" for k in findings]))
    return verdicts.withColumn("overall", worst).unpivot(keys, [*findings, "overall"], "analyst", "status")


def research_status(best_score: Column, *, min_signals: int = 30) -> Column:
    """What to do next with an evaluation: the first advice that applies."""
    low, x = ADVICE_LIMITS, F.col
    unsteady = F.coalesce(x("walk_forward_gap"), F.lit(0.0)) > low["fold_gap"]
    unpaid = (x("avg_return") <= 0) | (x("profit_loss_ratio") < low["payoff"])
    advice = {
        "insufficient_evidence": x("signal_count") < min_signals,
        "promote_optimized_exit": best_score >= x("confidence_score") + low["exit_gain"],
        "optimize_exits": (x("win_rate") >= low["good_win_rate"]) & unpaid,
        "simplify_structure": is_overfit() | unsteady,
        "revise_entry": (x("win_rate") < low["weak_win_rate"]) | (x("avg_return") < 0),
    }
    return F.coalesce(*[F.when(applies, F.lit(name)) for name, applies in advice.items()], F.lit("continue_validation"))


def hypothesis_status(evals: DataFrame, regimes: DataFrame, keys: list[str], preferred: tuple[str, ...], *, excess_return: Column | None = None) -> DataFrame:
    """Whether the market belief, the numbers or the execution is at fault."""
    weak = (F.col("win_rate") < 0.45) | (F.col("avg_return") < 0)
    weak_keys = regimes.where(F.col("regime").isin(list(preferred)) & weak).select(*keys).distinct()
    df = evals.join(weak_keys.withColumn("_weak", F.lit(True)), keys, "left")
    trails = F.lit(False)
    if excess_return is not None:
        trails = F.coalesce((excess_return < -0.03) & (F.col("win_rate") < 0.48), F.lit(False))
    broken = F.coalesce("_weak", F.lit(False)) | trails
    fragile = is_overfit() | (F.col("train_val_gap") > 0.10) | (F.col("param_sensitivity") > 0.30)
    status = (
        F.when(F.col("signal_count") < 30, "unproven_small_sample")
        .when((F.col("win_rate") >= 0.52) & (F.col("avg_return") <= 0), "execution_misaligned")
        .when(
            broken & ((F.col("win_rate") < 0.46) | (F.col("avg_return") <= 0) | (F.col("train_val_gap") <= 0.20)),
            "thesis_misaligned",
        )
        .when(fragile, "parameter_misaligned")
        .otherwise("partially_validated")
    )
    return df.withColumn("hypothesis_status", status).drop("_weak")


def problem_labels() -> Column:
    checks = [
        F.when(F.col("signal_count") < 25, "low_signals"),
        F.when(F.col("win_rate") < 0.45, "low_win_rate"),
        F.when(F.col("max_drawdown") > 0.20, "high_drawdown"),
        F.when((F.col("profit_loss_ratio") < 1.5) & (F.col("win_rate") >= 0.45), "low_pl_ratio"),
        F.when(F.col("train_val_gap") > 0.10, "overfit"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


# ── evaluation tables ────────────────────────────────────────────────────────


def latest_evaluations(log: DataFrame) -> DataFrame:
    """Upsert of an append-only log: first insert fixes a row, the newest score wins.

    ``log`` holds id, confidence_score, json_content, created_at and the rest.
    Rows of one time are told apart by their content.
    """
    scored = "scored_at" if "scored_at" in log.columns else "created_at"
    rest = [c for c in log.columns if c not in ("id", "confidence_score", "json_content", "scored_at")]
    content = ("confidence_score", "json_content")
    merged = log.groupBy("id").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", *content)).alias("_first"),
        F.max_by(F.struct(*content), F.struct(scored, *content)).alias("_last"),
        *([F.max("scored_at").alias("scored_at")] if scored == "scored_at" else []),
    )
    return merged.select("id", "_first.*", "_last.*", *([scored] if scored == "scored_at" else []))


# The same as a store: base and delta files by bucket of the id.
STORE_BUCKETS = 64


def _bucketed(log: DataFrame, buckets: int) -> DataFrame:
    return log.withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(buckets)).cast("int"))


def append_evaluations(log: DataFrame, path: str, *, buckets: int = STORE_BUCKETS) -> None:
    """Add rows to the store's delta; nothing that is stored is read or written again."""
    parts = _bucketed(log.withColumn("scored_at", F.col("created_at")), buckets).repartition("bucket")
    parts.write.mode("append").partitionBy("bucket").parquet(f"{path}/delta")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """The store as it stands: buckets without a delta are read as they are, only the others are grouped."""
    base, delta = _stored(spark, f"{path}/base"), _stored(spark, f"{path}/delta")
    if delta is None:
        if base is None:
            raise ValueError(f"nothing is stored in {path}")
        return base.drop("bucket", "scored_at")
    touched = [r.bucket for r in delta.select("bucket").distinct().collect()]  # at most the number of buckets
    if base is None:
        return latest_evaluations(delta.drop("bucket")).drop("scored_at")
    open_ = base.where(F.col("bucket").isin(touched)).unionByName(delta)
    shut = base.where(~F.col("bucket").isin(touched)).drop("bucket")
    return shut.unionByName(latest_evaluations(open_.drop("bucket"))).drop("scored_at")


def compact_evaluations(spark: SparkSession, path: str, *, buckets: int = STORE_BUCKETS) -> list[int]:
    """Fold the delta into the base and drop it; only the buckets it touches are written, which are returned."""
    delta = _stored(spark, f"{path}/delta")
    if delta is None:
        return []
    touched = sorted(r.bucket for r in delta.select("bucket").distinct().collect())
    base = _stored(spark, f"{path}/base")
    rows = delta if base is None else base.where(F.col("bucket").isin(touched)).unionByName(delta)
    merged = stage(_bucketed(latest_evaluations(rows.drop("bucket")), buckets))  # read before its buckets are replaced
    writer = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("bucket").parquet(f"{path}/base")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/delta")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched


def leaderboard(evals: DataFrame, strategies: DataFrame, *, limit: int = 20, min_signals: int = 30) -> DataFrame:
    """Best evaluation per strategy, top ``limit`` by score."""
    rest = [c for c in evals.columns if c != "strategy_id"]
    best = (
        evals.where(F.col("signal_count") >= min_signals)
        .groupBy("strategy_id")
        .agg(F.max_by(F.struct(*rest), F.struct("confidence_score", "id")).alias("_b"))
        .select("strategy_id", "_b.*")
    )
    return best.join(strategies, "strategy_id").orderBy(F.col("confidence_score").desc(), "strategy_id").limit(limit)


def newest_per_strategy(evals: DataFrame) -> DataFrame:
    rest = [c for c in evals.columns if c != "strategy_id"]
    return evals.groupBy("strategy_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_b")).select(
        "strategy_id", "_b.*"
    )


def comparison(evals: DataFrame, metrics: list[str]) -> DataFrame:
    """Newest evaluation per strategy, one row per metric and strategy."""
    newest = newest_per_strategy(evals)
    return newest.select("strategy_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["strategy_id"], metrics, "metric", "value"
    )


def family_champions(evals: DataFrame) -> DataFrame:
    return evals.groupBy("family_id").agg(
        F.max("confidence_score").alias("best_score"),
        F.max_by("strategy_id", F.struct("confidence_score", "strategy_id")).alias("champion_id"),
    )


def history(evals: DataFrame, strategy_id: str) -> DataFrame:
    return evals.where(F.col("strategy_id") == strategy_id).orderBy(F.col("created_at").desc())


def round_progress(rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Per round: score change.  Runs hold a handful of rounds."""
    w = Window.partitionBy(*keys).orderBy("round_num")
    return rounds.withColumn("velocity", F.col("confidence_score") - F.lag("confidence_score", 1).over(w))


def round_summary(rounds: DataFrame, keys: list[str]) -> DataFrame:
    return rounds.groupBy(*keys).agg(
        (F.max("confidence_score") - F.min_by("confidence_score", "round_num")).alias("improvement"),
        F.avg(F.col("improved").cast("double")).alias("efficiency"),
        F.count("*").alias("rounds"),
    )


def step_outcomes(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Score after a step is the next step's score before; the last takes the best."""
    w = Window.partitionBy(*keys).orderBy("step")
    after = F.coalesce(F.lead("score_before", 1).over(w), F.col("best_score"))
    df = steps.withColumns(
        {
            "score_after": after,
            "win_rate_after": F.coalesce(F.lead("win_rate_before", 1).over(w), F.col("win_rate_before")),
        }
    )
    df = df.withColumn("score_delta", F.col("score_after") - F.col("score_before"))
    return df.withColumn("improved", F.col("score_delta") > 0)


def champion_spread(groups: DataFrame) -> DataFrame:
    """How far apart group champions are, and the best group."""
    good = F.when(F.col("champion_score") > 0, F.col("champion_score"))
    return groups.agg(
        F.when(
            F.count(good) >= 2,
            F.least(F.lit(1.0), F.stddev_samp(good) / F.nullif(F.avg(good), F.lit(0.0))),
        )
        .otherwise(0.0)
        .alias("diversity"),
        F.max_by("group_id", F.struct("champion_score", "group_id")).alias("best_group"),
    )
