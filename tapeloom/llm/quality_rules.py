"""Quality rules as a short-circuit cascade.

Every rule says which texts it rejects and how much work that takes.  Work and
rejections are measured on a sample, the rules are put into the order of most
rejections per unit of work among the texts that earlier rules let through,
and the verdict becomes one ``CASE WHEN``: a text leaves at its first failing
rule, later rules never touch it.  The order changes the cost, not the verdict.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.words import SPACES, chars, count_of, let, words

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` and ``work`` are columns made from the text column.

    ``work`` counts the characters and array elements the rule has to touch.
    """

    name: str
    fails: Callable[[Column], Column]
    work: Callable[[Column], Column]


# ── counts ───────────────────────────────────────────────────────────────────


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return chars(F.regexp_replace(text, SPACES, ""))


def n_symbols(text: Column) -> Column:
    return count_of(text, SYMBOLS)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _window_marks(w: Column) -> Column:
    """Three-word windows as (hash, place), equal windows side by side."""
    places = F.sequence(F.lit(0), F.size(w) - 3)
    marks = F.transform(
        places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    )
    return F.sort_array(F.when(F.size(w) >= 3, marks))


def _covered(marks: Column) -> Column:
    """Places inside a window that occurs twice or more.

    Windows are compared by a 64-bit hash, within one text.
    """
    twice = F.filter(
        marks,
        lambda x, k: F.coalesce(x["h"] == F.get(marks, k - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(marks, k + 1)["h"], F.lit(False)),
    )
    spread = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.coalesce(F.size(F.array_distinct(spread)), F.lit(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    return let(words(text), lambda w: let(_window_marks(w), _covered))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The five counts, each intermediate computed once per row."""
    t = F.col("text")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    counted = packed.withColumn("words", words(t)).withColumn("marks", _window_marks(F.col("words")))
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": word_chars(t),
        "n_symbols": n_symbols(t),
        "n_dup_lines": n_dup_lines(t),
        "n_repeat_words": _covered(F.col("marks")),
    }
    return counted.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in counts], *[v.alias(k) for k, v in counts.items()])


# ── rules ────────────────────────────────────────────────────────────────────


def base_fails(n: Column, repeated: Column) -> Column:
    return (n < 50) | (100 * repeated > 50 * n)


def _upper(text: Column) -> Column:
    return count_of(text, "\\p{Lu}")


def _letters(text: Column) -> Column:
    return count_of(text, "\\p{L}")


def _lines(text: Column) -> Column:
    return F.size(F.split(F.coalesce(text, F.lit("")), "\n"))


SHORT = Rule("short", lambda t: n_words(t) < 50, lambda t: chars(t))
REPEATS = Rule("repeats", lambda t: 100 * n_repeat_words(t) > 50 * n_words(t), lambda t: chars(t) + 12 * n_words(t))
BASE_RULES = (SHORT, REPEATS)

RULES = (
    # more than 30 symbol characters to 100 words
    Rule("symbols", lambda t: 100 * n_symbols(t) > 30 * n_words(t), lambda t: 2 * chars(t)),
    # most letters are capitals
    Rule("shouting", lambda t: 2 * _upper(t) > _letters(t), lambda t: 2 * chars(t)),
    # words of fewer than 2 or more than 15 characters on average
    Rule(
        "word_length",
        lambda t: (word_chars(t) < 2 * n_words(t)) | (word_chars(t) > 15 * n_words(t)),
        lambda t: 2 * chars(t),
    ),
    # most lines repeat an earlier one
    Rule("dup_lines", lambda t: 2 * n_dup_lines(t) > _lines(t), lambda t: chars(t) + 4 * _lines(t)),
)


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[Rule]:
    """Rules by rejections per work, each measured behind the ones before it.

    The sample has about ``sample_rows`` rows; only one row for every pattern
    of verdicts (at most 2 to the number of rules) comes to the driver.  An
    empty table keeps the given order.
    """
    total = docs.count()
    sample = docs if total <= sample_rows else docs.sample(sample_rows / total, seed)
    t = F.col(text)
    measured = sample.select(
        F.array(*[F.coalesce(x.fails(t), F.lit(False)) for x in rules]).alias("pattern"),
        *[x.work(t).cast("double").alias(f"w{i}") for i, x in enumerate(rules)],
    )
    seen = (
        measured.groupBy("pattern")
        .agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(len(rules))])
        .collect()
    )
    left, ordered = list(range(len(rules))), []
    while left:

        def gain(i: int) -> float:
            rejected = sum(x["n"] for x in seen if x["pattern"][i])
            return rejected / max(1.0, sum(x[f"w{i}"] for x in seen))

        best = max(left, key=lambda i: (gain(i), -i))
        ordered.append(rules[best])
        left.remove(best)
        seen = [x for x in seen if not x["pattern"][best]]
    return ordered


def passes(rules: list[Rule], text: Column) -> Column:
    """True where no rule rejects the text; evaluation stops at the first that does."""
    verdict = F.lit(True)
    for x in reversed(rules):
        verdict = F.when(x.fails(text), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns, the five counts, ``base_failed`` and ``kept``.

    A null or empty text has no words, so it fails the base rule.  Repeated
    rows are judged alike, other columns pass through; columns named like the
    results are replaced.
    """
    ordered = order_rules(docs, rules, text)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    failed = base_fails(F.col("n_words"), F.col("n_repeat_words"))
    judged = with_counts(packed).withColumn("base_failed", failed)
    judged = judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(passes(ordered, F.col("text"))))
    added = [c for c in judged.columns if c not in ("row", "text")]
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE_RULES, *RULES), text: str = "text") -> DataFrame:
    """Only the rows that pass all rules, base rules included, columns unchanged."""
    return docs.where(passes(order_rules(docs, rules, text), F.col(text)))
