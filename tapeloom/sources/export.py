"""Exports of steps, conversations and evaluations, and experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the experiment result files.
EXPERIMENT_SCHEMA = (
    "strategy string, mode string, initial_score double, final_score double, rounds int, error string"
)


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def step_records(steps: DataFrame) -> DataFrame:
    """One nested record per step: input, reasoning, action, outcome."""
    return steps.select(
        "trajectory_id",
        "strategy_family",
        F.col("round_num").alias("round"),
        "strategy_id",
        F.struct(
            F.col("score_before").alias("score"),
            F.col("win_rate_before").alias("win_rate"),
            F.col("signal_count_before").alias("signal_count"),
            "failure_patterns",
        ).alias("input"),
        F.struct("diagnosis", "hypothesis", "expected_outcome").alias("reasoning"),
        F.struct("changes", "method").alias("action"),
        F.struct("score_after", "win_rate_after", "signal_count_after", "improved", "score_delta").alias("outcome"),
    )


# Lines of an answer that only steps with such a column and a value in it have.
OPTIONAL_LINES = {
    "critic_verdict": "\nCritic verdict: %s\n",
    "playbook_used": "Playbook used: %s\n",
    "llm_telemetry": "LLM telemetry: path=%s, total_duration_ms=%d, calls=%d\n",
}


def _optional_lines(columns: list[str]) -> list[Column]:
    lines = []
    for name, text in OPTIONAL_LINES.items():
        if name not in columns:
            continue
        c = F.col(name)
        if name == "llm_telemetry":
            duration = F.coalesce(c["total_duration_ms"], F.lit(0)).cast("long")
            filled = F.format_string(text, F.coalesce(c["path"], F.lit("")), duration, F.coalesce(F.size(c["calls"]), F.lit(0)))
            lines.append(F.when(c.isNotNull(), filled).otherwise(""))
        else:
            lines.append(F.when(F.length(c) > 0, F.format_string(text, c)).otherwise(""))
    return lines


def conversation_records(steps: DataFrame) -> DataFrame:
    """A question and an answer per step, as text built from its columns.

    ``critic_verdict``, ``playbook_used`` and ``llm_telemetry`` (path,
    total_duration_ms, calls) add a line where a step has them.
    """
    problems = F.when(F.size("failure_patterns") > 0, F.array_join("failure_patterns", "; ")).otherwise("none identified")
    asked = F.concat(
        F.lit("Strategy: "),
        "strategy_id",
        F.lit("\nCurrent score: "),
        _percent(F.col("score_before")),
        F.lit("\nWin rate: "),
        _percent(F.col("win_rate_before")),
        F.lit("\nSignal count: "),
        F.col("signal_count_before").cast("string"),
        F.lit("\nProblems: "),
        problems,
        F.lit("\n\nHow should we improve this strategy?"),
    )
    line = F.transform(
        "changes",
        lambda c: F.concat(
            F.lit("  - "), c["change_type"], F.lit(": "), c["target"], F.lit(" ("), c["from_value"], F.lit(" → "), c["to_value"], F.lit(")")
        ),
    )
    changes = F.when(F.size("changes") > 0, F.array_join(line, "\n")).otherwise("  No changes proposed")
    answered = F.concat(
        F.lit("Diagnosis: "),
        "diagnosis",
        F.lit("\n\nHypothesis: "),
        "hypothesis",
        F.lit("\nExpected: "),
        "expected_outcome",
        F.lit("\n\nProposed changes:\n"),
        changes,
        F.lit("\n"),
        *_optional_lines(steps.columns),
        F.lit("\nResult: "),
        F.when(F.col("improved"), "improved").otherwise("no improvement"),
        F.lit(" (score "),
        _percent(F.col("score_before")),
        F.lit(" → "),
        _percent(F.col("score_after")),
        F.lit(", delta="),
        F.format_string("%+.1f%%", F.col("score_delta") * 100),
        F.lit(")"),
    )
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return steps.select(
        F.array(turn("human", asked), turn("gpt", answered)).alias("conversations"),
        F.struct("trajectory_id", F.col("round_num").alias("round"), "improved").alias("metadata"),
    )


def preference_sides(steps: DataFrame) -> DataFrame:
    """Chosen and rejected steps of trajectories that have both.

    Pairs are every chosen with every rejected step of one trajectory; the
    table keeps the two sides, which grow with the steps and not their product.
    """
    both = steps.groupBy("trajectory_id").agg(
        F.count_if("improved").alias("chosen_steps"), F.count_if(~F.col("improved")).alias("rejected_steps")
    )
    both = both.where((F.col("chosen_steps") > 0) & (F.col("rejected_steps") > 0))
    return steps.join(both, "trajectory_id").select(
        "trajectory_id",
        "round_num",
        F.when(F.col("improved"), "chosen").otherwise("rejected").alias("side"),
        "strategy_id",
        "diagnosis",
        "score_before",
        "score_after",
        "chosen_steps",
        "rejected_steps",
    )


def evaluation_records(evals: DataFrame, strategies: DataFrame | None = None) -> DataFrame:
    """Nested evaluation documents, with the strategy block when given."""
    rest = [c for c in evals.columns if c != "strategy_id"]
    docs = evals.select("strategy_id", F.struct(*rest).alias("evaluation"))
    if strategies is None:
        return docs
    block = [c for c in strategies.columns if c != "strategy_id"]
    return docs.join(strategies.select("strategy_id", F.struct(*block).alias("strategy")), "strategy_id", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """Experiment results: improvement per row, error rows marked."""
    df = spark.read.schema(EXPERIMENT_SCHEMA).option("header", True).csv(path)
    return df.withColumns(
        {
            "improvement": F.col("final_score") - F.col("initial_score"),
            "failed": F.coalesce(F.col("error"), F.lit("")) != "",
        }
    )
