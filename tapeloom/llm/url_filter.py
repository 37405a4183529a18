"""URL filters: host and path rules, then a list of blocked canonical URLs.

A blocked Bloom filter of the listed URLs lets possible hits through, and an
exact hash join of those hits with the list removes the false ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import bloom
from tapeloom.runtime import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``action`` for a host with its subdomains and a path prefix."""

    action: str
    host: str
    path: str = "/"


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling for addresses of the same page; null for null or without ``://``.

    Scheme, fragment, a leading ``www.``, one trailing slash and tracking
    parameters (``utm_…``, ``ref``) go; the others are sorted.
    """
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[^=]*|ref)(=|$)"))
    )
    bare = F.concat(F.regexp_replace(host(url), "^www\\.", ""), F.regexp_replace(path(url), "/$", ""))
    return F.when(
        F.instr(url, "://") > 0,
        F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.array_join(kept, "&"))).otherwise(bare),
    )


def _fits(rule: UrlRule, host_: Column, path_: Column) -> Column:
    return ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)


def decide_by_rules(rules: tuple[UrlRule, ...], host_: Column, path_: Column) -> Column:
    """(rule, action) of the longest rule that fits, null without one.

    Of two that fit with equally many characters, the longer host wins.
    """
    decided = F.lit(None).cast("struct<rule:string,action:string>")
    for x in sorted(rules, key=lambda x: (len(x.host) + len(x.path), len(x.host))):
        found = F.struct(F.lit(x.host + x.path).alias("rule"), F.lit(x.action).alias("action"))
        decided = F.when(_fits(x, host_, path_), found).otherwise(decided)
    return decided


def listed(pages: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    """(row, url, listed) of all pages: the row, its address, and whether its canonical URL is in ``blocked.canonical``.

    The list may hold repeats, nulls or nothing.  Only possible hits are
    shuffled; a URL that very many pages share is dealt out by the skew join,
    as both sides are plain exchanges.
    """
    listing = stage(blocked.select("canonical").where(F.col("canonical").isNotNull()).distinct())
    filter_ = bloom.build(listing, "canonical")
    seen = pages.select(F.struct(*pages.columns).alias("row"), F.col(url).alias("url"), canonical(F.col(url)).alias("seen"))
    maybe = filter_.might_contain(F.col("seen"))
    sure = seen.where(~maybe).select("row", "url", F.lit(False).alias("listed"))
    hits = seen.where(maybe).join(listing.withColumn("hit", F.lit(True)), F.col("seen") == F.col("canonical"), "left")
    return sure.unionByName(hits.select("row", "url", F.coalesce("hit", F.lit(False)).alias("listed")))


def judge(pages: DataFrame, blocked: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url") -> DataFrame:
    """All columns with ``host``, ``path``, ``rule`` and ``verdict``.

    A null URL or one without ``://`` has an empty host and path, fits no rule
    and is listed nowhere: allowed.  Repeated rows are judged alike, URLs of
    any length are read whole; columns named like the results are replaced, all
    others pass through whatever their names.
    """
    u = F.col("url")
    marked = listed(pages, blocked, url).select("row", "listed", F.coalesce(host(u), F.lit("")).alias("host"), F.coalesce(path(u), F.lit("")).alias("path"))
    marked = marked.withColumn("by_rule", decide_by_rules(rules, F.col("host"), F.col("path")))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return marked.select(
        *kept, "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.action", by_list).alias("verdict")
    )
