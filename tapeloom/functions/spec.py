"""Declarative strategy specs and their compilation to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.functions.indicators import is_registered


@dataclass(frozen=True)
class Condition:
    """``indicator op value``; the value may be a candidate column."""

    indicator: str
    op: str
    value: object


@dataclass(frozen=True)
class Entry:
    conditions: tuple[Condition, ...] = ()
    triggers: tuple[Condition, ...] = ()
    guards: tuple[Condition, ...] = ()
    filters: tuple[Condition, ...] = ()
    logic: str = "and"
    timing: str = "next_open"
    slippage: float | None = None


@dataclass(frozen=True)
class Stop:
    type: str = "pct"
    value: object = None
    multiplier: object = None
    atr_period: int | None = None
    reference: str | None = None
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Target:
    type: str = "rr"
    value: object = None
    target: str | None = None
    trigger_pct: object = None
    trail_pct: object = None


@dataclass(frozen=True)
class Exit:
    stop: Stop = field(default_factory=Stop)
    target: Target = field(default_factory=Target)
    max_holding_days: object = 10
    triggers: tuple[Condition, ...] = ()
    horizon: int | None = None  # upper bound when max_holding_days is a column


@dataclass(frozen=True)
class MarketRules:
    t_plus_1: bool = False
    limit_up_down: bool = False
    suspension: bool = False


# Default trading rules of each market.
DEFAULT_RULES = {
    "a_share": MarketRules(t_plus_1=True, limit_up_down=True, suspension=True),
    "hk": MarketRules(suspension=True),
    "us": MarketRules(suspension=True),
}


@dataclass(frozen=True)
class Strategy:
    id: str
    entry: Entry
    exit: Exit
    market: str = "us"
    preferred_regimes: tuple[str, ...] = ()
    rules: MarketRules | None = None

    @property
    def market_rules(self) -> MarketRules:
        return self.rules or DEFAULT_RULES.get(self.market, MarketRules())

    @property
    def entry_conditions(self) -> tuple[Condition, ...]:
        e = self.entry
        return (*e.conditions, *e.triggers, *e.filters, *e.guards)

    @property
    def indicators(self) -> list[str]:
        used = (*self.entry_conditions, *self.exit.triggers, *self.exit.stop.conditions)
        return sorted({c.indicator for c in used})

    @property
    def complexity(self) -> float:
        """Share of the tolerated rule count; three rules are free, the exit is one."""
        rules = len(self.entry_conditions) + len(self.exit.triggers) + len(self.exit.stop.conditions) + 1
        return max(0.0, min(1.0, (rules - 3) / 10))


def family_id(strategy_id: Column) -> Column:
    return F.regexp_replace(strategy_id, r"_v\d+$", "")


_OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def condition_column(c: Condition, actual: Column | None = None) -> Column:
    """Unknown indicators and operators block; nulls never match."""
    if c.op not in _OPS or not (actual is not None or is_registered(c.indicator)):
        return F.lit(False)
    actual = F.col(c.indicator) if actual is None else actual
    if isinstance(c.value, bool):
        actual, expected = actual.cast("boolean"), F.lit(c.value)
    elif isinstance(c.value, (int, float)):
        actual, expected = actual.cast("double"), F.lit(float(c.value))
    elif isinstance(c.value, Column):
        actual, expected = actual.cast("double"), c.value
    else:
        expected = F.lit(c.value)
    return F.coalesce(_OPS[c.op](actual, expected), F.lit(False))


def group_column(conditions: tuple[Condition, ...], logic: str = "and") -> Column:
    if not conditions:
        return F.lit(True)
    join = (lambda a, b: a | b) if logic == "or" else (lambda a, b: a & b)
    return reduce(join, [condition_column(c) for c in conditions])


def entry_column(entry: Entry) -> Column:
    """(triggers, or else conditions) under the logic; guards and filters all hold."""
    return group_column(entry.triggers or entry.conditions, entry.logic) & group_column(
        (*entry.guards, *entry.filters)
    )


def regime_gate(preferred: tuple[str, ...], regime: Column) -> Column:
    if not preferred:
        return F.lit(True)
    return regime.isNull() | regime.isin(list(preferred))


def warmup_bars(names: list[str]) -> int:
    """First bar position that may signal, from the periods in the indicator names."""
    periods = [int(n) for name in names for n in re.findall(r"\d+", name) if 2 <= int(n) <= 500]
    smooth = any(tag in n.lower() for n in names for tag in ("rsi", "macd", "ema", "ewm", "bollinger"))
    if any("macd" in n.lower() for n in names):
        periods.append(35)
    longest = max(periods, default=0)
    return max(30, longest + (longest if smooth else max(5, longest // 4)))


# ── market rules ─────────────────────────────────────────────────────────────


def limit_threshold(columns: list[str]) -> Column:
    """Daily move that counts as a limit, by ST flag or name and by board code."""
    has = set(columns)
    code = F.element_at(F.split(F.col("symbol" if "symbol" in has else "code").cast("string"), r"\."), 1)
    rule = F.when(F.coalesce(F.col("st"), F.lit(False)), 0.048) if "st" in has else None
    if "name" in has:
        name = F.upper(F.coalesce("name", F.lit("")))
        special = name.contains("ST ") | name.startswith("ST") | name.contains("*ST")
        rule = F.when(special, 0.048) if rule is None else rule.when(special, 0.048)
    board = code.startswith("688") | code.startswith("300")
    rule = F.when(board, 0.196) if rule is None else rule.when(board, 0.196)
    return rule.when(code.startswith("8") | code.startswith("43"), 0.294).otherwise(0.098)


def _limit_move(columns: list[str]) -> Column:
    prev = F.col("prev_close")
    return F.when(prev > 0, (F.col("close") - prev) / prev)


def is_limit_up(columns: list[str]) -> Column:
    return F.coalesce(_limit_move(columns) >= limit_threshold(columns), F.lit(False))


def is_limit_down(columns: list[str]) -> Column:
    return F.coalesce(_limit_move(columns) <= -limit_threshold(columns), F.lit(False))


def _suspended() -> Column:
    return F.coalesce(F.col("volume"), F.lit(0.0)) == 0


def buy_allowed(rules: MarketRules, columns: list[str]) -> Column:
    ok = F.lit(True)
    if rules.limit_up_down:
        ok = ok & ~is_limit_up(columns)
    if rules.suspension:
        ok = ok & ~_suspended()
    return ok


def sell_allowed(rules: MarketRules, columns: list[str]) -> Column:
    """The per-bar part; T+1 depends on the entry bar and is applied with it."""
    ok = F.lit(True)
    if rules.limit_up_down:
        ok = ok & ~is_limit_down(columns)
    if rules.suspension:
        ok = ok & ~_suspended()
    return ok


def fingerprint(parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", parts), 256), 1, 16)
