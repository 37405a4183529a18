"""Benchmark decontamination by spaced-seed hashing.

A mask is laid over every window of a text and only the words at its set
places are hashed, so a window still matches after words at the other places
were substituted.  The masks are those of a block with one place left open; an
overlap always holds a block with at most one substitution (``complete_masks``),
so no overlap goes unseen.  Training windows meet benchmark windows of the same mask in
a hash join; a blocked Bloom filter of the benchmark's hashes keeps all other
training windows out of the shuffle.  A hit names a document, an item and a
shift between them.  There both are laid side by side, and the overlap counts
if some stretch of ``STRETCH`` words (or the whole item, where it is shorter)
agrees in at least ``AGREE`` percent of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import bloom
from tapeloom.llm.words import plain_words
from tapeloom.runtime import stage

#: An item with fewer words is no evidence.
SHORTEST = 5
STRETCH, AGREE = 20, 80


def complete_masks(agree: int = AGREE) -> tuple[str, ...]:
    """Masks of which one at least hits every overlap of ``SHORTEST`` words or more.

    Of n words at most n (100 - agree) / 100 differ.  The block of b words is
    chosen so that this is at most n / b: there are as many whole blocks as
    differences or more, so some block has one difference or none.  It matches
    one of the masks that leave a single place open.
    """
    b = SHORTEST if agree == 100 else min(SHORTEST, 100 // (100 - agree))
    if b < 2:
        raise ValueError("less than half of the words would have to agree")
    # open at either end is the same run of b - 1 words
    return ("1" * (b - 1), *("1" * i + "0" + "1" * (b - 1 - i) for i in range(1, b - 1)))


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def word_codes(text: Column) -> Column:
    """64-bit hashes of the plain words."""
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))


def _seed_hash(codes: Column, at: Column, mask: str) -> Column:
    """Hash of a masked window; null where the window leaves the text."""
    inside = at + (len(mask) - 1) < F.size(codes)
    return F.when(inside, F.xxhash64(F.lit(mask), *[F.get(codes, at + i) for i in _places(mask)]))


def _windows(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """One row per window start and mask with the start ``at`` and the hash ``h``.

    The hashes become rows before anything looks at them: a condition on a
    plain column stays small in generated code.
    """
    shortest = min(map(len, masks))
    starts = F.when(F.size("codes") >= shortest, F.sequence(F.lit(0), F.size("codes") - shortest))
    spread = rows.withColumn("at", F.explode(starts))
    hashes = F.array(*[_seed_hash(F.col("codes"), F.col("at"), m) for m in masks])
    return spread.withColumn("h", F.explode(hashes)).drop("codes")


def _agreement(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x == y).cast("int"))


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda s, x: s + x)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    stretch: int = STRETCH,
    agree: int = AGREE,
) -> DataFrame:
    """(document, item, matched, aligned) for every verified overlap.

    ``matched`` is the largest number of equal words side by side at any shift,
    ``aligned`` the words compared there.  Null and empty texts overlap with
    nothing, repeated rows are reported once, a null id is an id like others.
    The benchmark is hashed with Spark too, so its size is free.
    """
    masks = complete_masks(agree)
    items = stage(
        benchmark.select(F.col(item).alias("_item"), word_codes(F.col(text)).alias("codes")).where(F.size("codes") >= SHORTEST)
    )
    seeds = stage(_windows(items, masks).where(F.col("h").isNotNull()).distinct())
    known = bloom.build(seeds.select("h").distinct(), "h")

    source = docs.select(F.col(doc).alias("_doc"), F.xxhash64(F.col(text)).alias("_copy"), F.col(text).alias("_text"))
    coded = source.withColumn("codes", word_codes(F.col("_text"))).drop("_text")
    hits = stage(_windows(coded, masks).where(known.might_contain(F.col("h"))))
    shifts = (
        hits.join(seeds.select("_item", F.col("at").alias("item_at"), F.col("h").alias("seed")), F.col("h") == F.col("seed"))
        .select("_doc", "_copy", "_item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    shifts = stage(shifts)

    # the words of the documents that were hit, and of their items
    touched = shifts.select("_copy").distinct()
    wanted = bloom.build(touched, "_copy")
    again = coded.where(wanted.might_contain(F.col("_copy"))).dropDuplicates(["_doc", "_copy"])
    paired = shifts.join(
        again.withColumnsRenamed({"_doc": "_d", "_copy": "_c"}),
        F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_copy") == F.col("_c")),
    ).drop("_d", "_c")
    paired = paired.join(
        items.select(F.col("_item").alias("_i"), F.col("codes").alias("item_codes")), F.col("_item").eqNullSafe(F.col("_i"))
    ).drop("_i")

    first = F.greatest(F.lit(0), -F.col("shift"))  # the first item word that has a partner
    last = F.least(F.size("item_codes"), F.size("codes") - F.col("shift"))
    laid = paired.withColumn("first", first).withColumn("aligned", last - first)
    need = F.least(F.lit(stretch), F.size("item_codes"))
    laid = laid.withColumn("need", need).where(F.col("aligned") >= F.col("need"))
    flags = _agreement(
        F.slice("codes", F.col("first") + F.col("shift") + 1, F.col("aligned")),
        F.slice("item_codes", F.col("first") + 1, F.col("aligned")),
    )
    laid = laid.select("_doc", "_item", "aligned", "need", flags.alias("flags"))
    enough = F.exists(
        F.sequence(F.lit(1), F.col("aligned") - F.col("need") + 1),
        lambda i: 100 * _total(F.slice("flags", i, F.col("need"))) >= agree * F.col("need"),
    )
    found = laid.where(enough).select("_doc", "_item", F.struct(_total(F.col("flags")).alias("m"), (-F.col("aligned")).alias("a")).alias("best"))
    return (
        found.groupBy("_doc", "_item")
        .agg(F.max("best").alias("best"))
        .select(
            F.col("_doc").alias(doc),
            F.col("_item").alias(item),
            F.col("best.m").cast("long").alias("matched"),
            (-F.col("best.a")).cast("long").alias("aligned"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", **kwargs) -> DataFrame:
    """Only the documents without a verified overlap, columns unchanged."""
    dirty = overlaps(docs, benchmark, doc, **kwargs).select(F.col(doc).alias("_dirty")).distinct()
    return docs.join(dirty, F.col(doc).eqNullSafe(F.col("_dirty")), "left_anti")
