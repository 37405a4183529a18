"""Language identification by Bayesian evidence fusion.

Every text has a likelihood under each language (naive Bayes over hashed words,
trained on all labelled documents).  Besides, a text may declare a language and
has an address.  How far declarations can be trusted, and how languages are
spread over addresses, is counted over the whole table: the global spread
smooths that of an address suffix, that one the spread of a domain, and that
one the spread of a host.  The posterior of a language is the product of the
tempered text likelihood, the likelihood of the declaration and the prior of
the host.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.runtime import stage

BUCKETS = 1 << 13
MAX_LANGUAGES = 64
#: Weight of one word beside declaration and address, and the number of words that count in full.
TEMPER, FULL_WORDS = 0.5, 50
SMOOTHING = 8.0
UNKNOWN = "und"
CACHE_WORDS = 300_000

_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", re.IGNORECASE | re.DOTALL)


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode()) % BUCKETS
        if len(self) < CACHE_WORDS:
            self[word] = bucket
        return bucket


_buckets = _Buckets()


def train(texts: DataFrame, language: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood of every word bucket under each.

    Counted over all texts with a language; at most ``MAX_LANGUAGES`` times
    ``BUCKETS`` counts come to the driver.
    """
    words = F.explode(F.array_remove(F.split(F.lower(F.col(text)), "[^\\p{L}]+"), ""))
    counts = (
        texts.where(F.col(language).isNotNull())
        .select(F.lower(F.col(language)).alias("l"), words.alias("w"))
        .groupBy("l", (F.crc32(F.col("w").cast("binary")) % BUCKETS).cast("int").alias("b"))
        .count()
    )
    rows = stage(counts)
    names = [r.l for r in rows.groupBy("l").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names.sort()
    table = np.full((BUCKETS, max(1, len(names))), 0.5)
    for r in rows.collect():
        table[r.b, names.index(r.l)] += r["count"]
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


#: The same letters as in training: number letters such as ½ are none.
_LETTERS = regex.compile(r"\p{L}+")


def _likelihoods(model: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part, rows = batch.slice(s, 500), []
                for text, markup in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    plain = (_MARKUP.sub(" ", text) if markup else text) if text else ""
                    words = _LETTERS.findall(plain.lower())
                    marks = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
                    total = np.bincount(marks, minlength=BUCKETS).astype(np.float32) @ model if words else np.zeros(model.shape[1], np.float32)
                    # words are not independent: beyond the first ones their number stops to add confidence
                    rows.append((total * (TEMPER * min(1.0, FULL_WORDS / max(1, len(words))))).tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["key", "likelihood"])

    return run


def declared_in(markup: Column) -> Column:
    """Primary language subtag of a page's ``html`` element, null without one."""
    found = F.regexp_extract(F.coalesce(markup, F.lit("")), "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})\\b", 1)
    return F.when(found != "", F.lower(found))


def _share(level: DataFrame, parent: str, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: (F.get("counts", i) + SMOOTHING * F.get(parent, i)) / (F.col("total") + SMOOTHING),
    )


def _counts(table: DataFrame, key: list[str], n: int) -> DataFrame:
    """Texts per language (by text alone) for every key."""
    return table.groupBy(*key).agg(
        F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(n)]).alias("counts"), F.count("*").cast("double").alias("total")
    )


def identify(table: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """Adds ``language``, ``probability`` and ``text_language`` to every row.

    ``table`` has ``text``, ``markup`` (the text is HTML), ``declared``,
    ``suffix``, ``domain`` and ``host``; these columns stay, the text goes.
    Nulls are no evidence: a text without letters has equal likelihoods, an
    unknown declaration counts as none, null and new addresses share the level
    above (host, domain, suffix, all).  Repeated rows get equal results, texts of
    any length are read whole, columns named like the results are replaced.
    With no language known every row is ``und``.
    """
    n = len(languages)
    others = [c for c in table.columns if c not in ("text", "markup", "language", "probability", "text_language")]
    if not n:
        return table.select(*others, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"))
    names = F.array(*[F.lit(x) for x in languages])
    packed = table.select(F.struct(*others).alias("key"), "text", F.coalesce("markup", F.lit(False)).alias("markup"))
    fields = packed.schema["key"].dataType.simpleString()
    seen = packed.mapInArrow(_likelihoods(model), f"key {fields}, likelihood array<double>")
    top = F.array_max("likelihood")
    best = F.when(top > F.array_min("likelihood"), F.array_position("likelihood", top) - 1)
    said = F.when(F.lower(F.col("key.declared")).isin(languages), F.array_position(names, F.lower(F.col("key.declared"))) - 1)
    seen = stage(seen.select("key", "likelihood", best.cast("int").alias("best"), said.cast("int").alias("said"), "key.suffix", "key.domain", "key.host"))

    # one row each: the spread of languages, and of declarations under each language (at most MAX_LANGUAGES squared)
    known = seen.where(F.col("best").isNotNull())
    base = known.agg(*[(F.sum((F.col("best") == i).cast("double"))).alias(f"n{i}") for i in range(n)], F.count("*").alias("n")).first()
    overall = [((base[f"n{i}"] or 0.0) + 1) / (base["n"] + n) for i in range(n)]
    pairs = {(r.best, r.said): r["count"] for r in known.where(F.col("said").isNotNull()).groupBy("best", "said").count().collect()}
    trust = [[(pairs.get((i, j), 0) + 0.5) / (sum(pairs.get((i, k), 0) for k in range(n)) + 0.5 * n) for j in range(n)] for i in range(n)]

    prior = F.array(*[F.lit(x) for x in overall])
    suffixes = _counts(known.where(F.col("suffix").isNotNull()), ["suffix"], n).withColumn("above", prior)
    suffixes = stage(suffixes.select(F.col("suffix").alias("s"), _share(suffixes, "above", n).alias("p_suffix")))
    domains = _counts(known.where(F.col("domain").isNotNull()), ["domain", "suffix"], n).join(suffixes, F.col("suffix") == F.col("s"), "left")
    domains = domains.withColumn("above", F.coalesce("p_suffix", prior))
    domains = stage(domains.select(F.col("domain").alias("d"), F.col("suffix").alias("ds"), _share(domains, "above", n).alias("p_domain")))
    hosts = _counts(known.where(F.col("host").isNotNull()), ["host", "domain", "suffix"], n)
    hosts = hosts.join(domains, (F.col("domain") == F.col("d")) & F.col("suffix").eqNullSafe(F.col("ds")), "left").withColumn("above", F.coalesce("p_domain", prior))
    hosts = stage(hosts.select(F.col("host").alias("h"), F.col("domain").alias("hd"), F.col("suffix").alias("hs"), _share(hosts, "above", n).alias("p_host")))

    placed = seen.join(
        hosts, (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("hd")) & F.col("suffix").eqNullSafe(F.col("hs")), "left"
    )
    placed = placed.join(domains, (F.col("domain") == F.col("d")) & F.col("suffix").eqNullSafe(F.col("ds")), "left")
    placed = placed.join(suffixes, F.col("suffix") == F.col("s"), "left")
    from_address = F.coalesce("p_host", "p_domain", "p_suffix", prior)
    table_of_trust = F.array(*[F.array(*[F.lit(x) for x in row]) for row in trust])
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.get("likelihood", i)
        + F.log(F.get("from_address", i))
        + F.when(F.col("said").isNull(), F.lit(0.0)).otherwise(F.log(F.get(F.get(table_of_trust, i), F.col("said")))),
    )
    scored = placed.withColumn("from_address", from_address).withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    odds = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    return scored.select(
        *[F.col("key")[c].alias(c) for c in others],
        F.get(names, (F.array_position("logs", F.col("most")) - 1).cast("int")).alias("language"),
        (1 / odds).alias("probability"),
        F.get(names, F.col("best")).alias("text_language"),
    )
