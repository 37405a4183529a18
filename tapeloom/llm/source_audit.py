"""How far the sources of a language diverge, by chunk factorization.

Texts are cut at ASCII white space into chunks, which repeat far more often
than texts do.  Chunks are counted per document; all counts of a chunk meet in
one task, where each globally distinct chunk is split into terms once and its
terms get the chunk's counts; counts of a term meet again for documents and
occurrences.  A term is a run of ASCII letters and non-ASCII characters, A-Z
lower-cased, so no term crosses a chunk's edge.

A partial count carries the documents it comes from as long as they are fewer
than ``min_docs``, else the mark ``sure``: a term is kept where a part is sure
or the distinct documents of all its parts reach ``min_docs``.  That is exact
and bounds what a row carries, however common a term is.

Kept terms of a language are compared source by source: p and q are whole
numbers of parts in 10^9 (add-two smoothing over all kept terms) and a term
adds floor((p - q)^2 / (p + q)).  All of it is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.runtime import stage

MIN_DOCS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: Words that one block of the first pass holds, entries of a block of the later ones, entries of a group of terms (at least the square of a language's sources).
BLOCK_WORDS, BLOCK_ENTRIES, GROUP_ENTRIES = 1_500_000, 500_000, 50_000
#: Sources and terms that are compared at a time.
SOURCE_BLOCK, CELLS = 64, 4_000_000

_COUNT = np.dtype([("group", "<i8"), ("n", "<i8")])
_PACKED = pa.schema([("lang", pa.string()), ("key", pa.string()), ("counts", pa.binary()), ("sure", pa.bool_()), ("docs", pa.binary())])
_PACKED_DDL = "lang string, key string, counts binary, sure boolean, docs binary"
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("group", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("first", pa.int64())])
_KEPT_DDL = "lang string, term string, group long, n long, total long, first long"


def group_code(lang: Column, source: Column) -> Column:
    """The number under which the counts of a (language, source) group travel."""
    return F.xxhash64(lang, source)


# ── packed counts ────────────────────────────────────────────────────────────


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One value per key from contiguous bytes; ``ends`` in bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _records(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records of a packed column and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    return np.frombuffer(raw, dtype), np.diff(offsets) // dtype.itemsize


def _pack(keys: int, owner: np.ndarray, group: np.ndarray, n: np.ndarray, doc_owner: np.ndarray, doc: np.ndarray, sure: np.ndarray, min_docs: int):
    """Counts, marks and documents per key (0 to ``keys`` - 1) from loose entries."""
    order = np.lexsort((group, owner))
    owner, group, n = owner[order], group[order], n[order]
    at = _starts(owner, group)
    out = np.empty(len(at), _COUNT)
    out["group"], out["n"] = group[at], np.add.reduceat(n, at) if len(at) else 0
    entries = np.bincount(owner[at], minlength=keys)
    counts = _binary(out.view(np.uint8), np.cumsum(entries) * _COUNT.itemsize)

    order = np.lexsort((doc, doc_owner))
    doc_owner, doc = doc_owner[order], doc[order]
    at = _starts(doc_owner, doc)
    doc_owner, doc = doc_owner[at], doc[at]
    found = np.bincount(doc_owner, minlength=keys)
    sure = sure | (found >= min_docs)
    keep = ~sure[doc_owner]
    docs = _binary(doc[keep].astype("<i8").view(np.uint8), np.cumsum(np.where(sure, 0, found)) * 8)
    return counts, sure, docs


def _merged(keys: int, owner: np.ndarray, counts: pa.Array, sure: pa.Array, docs: pa.Array, min_docs: int):
    """The packed rows of every key as one; ``owner`` is each row's key."""
    records, entries = _records(counts, _COUNT)
    ids, many = _records(docs, np.dtype("<i8"))
    flags = np.zeros(keys, bool)
    flags[owner[sure.to_numpy(zero_copy_only=False)]] = True
    return _pack(keys, np.repeat(owner, entries), records["group"], records["n"], np.repeat(owner, many), ids, flags, min_docs)


# ── passes ───────────────────────────────────────────────────────────────────


def _count_chunks(min_docs: int):
    """Chunks of every document, counted and put together over a block of documents."""

    def counted(slices: list[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array([s[0] for s in slices], pa.string()).combine_chunks().dictionary_encode()
        lengths, groups, docs = (np.concatenate([s[i] for s in slices]) for i in (1, 3, 4))
        langs = pa.chunked_array([s[2] for s in slices], pa.string()).combine_chunks().dictionary_encode()
        names, vocabulary = langs.dictionary, words.dictionary
        n_words, n_groups = len(vocabulary), 0
        if not n_words:
            return
        # distinct words of every document and how often it has them
        pair = np.repeat(np.arange(len(lengths)), lengths) * n_words + words.indices.to_numpy()
        pair.sort()
        at = _starts(pair)
        n = np.diff(np.append(at, len(pair)))
        row, word = np.divmod(pair[at], n_words)
        # keys are (language, word) in that order
        key = langs.indices.to_numpy().astype(np.int64)[row] * n_words + word
        kinds, owner = np.unique(key, return_inverse=True)
        n_groups = len(kinds)
        counts, sure, ids = _pack(n_groups, owner, groups[row], n, owner, docs[row], np.zeros(n_groups, bool), min_docs)
        lang, word = np.divmod(kinds, n_words)
        for s in range(0, n_groups, 50_000):
            e = slice(s, s + 50_000)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(lang[e])), vocabulary.take(pa.array(word[e])), counts[e], pa.array(sure[e]), ids[e]], schema=_PACKED
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                lang, group, text, doc = part.columns
                lists = pc.ascii_split_whitespace(text)
                flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
                full = pc.greater(pc.binary_length(flat), 0)
                rows = np.repeat(np.arange(len(lengths)), lengths)[full.to_numpy(zero_copy_only=False)]
                flat, lengths = flat.filter(full), np.bincount(rows, minlength=len(lengths))
                held.append((flat, lengths, lang, group.to_numpy(), doc.to_numpy()))
                words += len(flat)
                if words >= BLOCK_WORDS:
                    yield from counted(held)
                    held, words = [], 0
        if held:
            yield from counted(held)

    return run


def _runs(batches: Iterable[pa.RecordBatch], entries: int) -> Iterator[pa.Table]:
    """Sorted rows in blocks of about ``entries`` bytes' worth that never part equal (lang, key)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows + batch.column(2).nbytes // _COUNT.itemsize
        if size < entries:
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(table.num_rows - 1).to_pylist()[0]
        same = pc.and_(pc.equal(table["lang"], last["lang"]), pc.equal(table["key"], last["key"]))
        cut = pc.index(same, True).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        size = sum(b.num_rows for b in held) if cut else 0
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table) -> list[pa.Array]:
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]


def _keys(lang: pa.Array, key: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the runs of equal (lang, key), and the run of every row."""
    new = np.ones(len(key), bool)
    if len(key) > 1:
        same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(key) - 1)), pc.equal(key.slice(1), key.slice(0, len(key) - 1)))
        new[1:] = ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new), np.cumsum(new) - 1


def terms_of(chunks: pa.Array) -> pa.Array:
    """The terms of every chunk: ASCII letters and non-ASCII characters, A-Z lower-cased."""
    plain = pc.replace_substring_regex(pc.ascii_lower(chunks), pattern="[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", replacement=" ")
    return pc.ascii_split_whitespace(plain)


def _chunks_to_terms(min_docs: int):
    """Rows sorted by (chunk, language): every distinct chunk is split once and its terms get its counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, BLOCK_ENTRIES):
            lang, key, counts, sure, docs = _columns(table)
            first, owner = _keys(pa.array(np.zeros(len(key), np.int8)), key)
            lists = terms_of(key.take(pa.array(first)))
            flat = lists.flatten()
            filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            per_chunk = pc.list_value_length(lists).to_numpy().astype(np.int64)
            chunk_of = np.repeat(np.arange(len(first)), per_chunk)[filled]
            flat = flat.filter(pa.array(filled)).dictionary_encode()
            per_chunk = np.bincount(chunk_of, minlength=len(first))
            begin = np.cumsum(per_chunk) - per_chunk
            # every row of a chunk once for each of its terms
            repeat = per_chunk[owner]
            row = np.repeat(np.arange(len(key)), repeat)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            term = flat.indices.to_numpy().astype(np.int64)[begin[owner[row]] + nth]
            langs = lang.dictionary_encode()
            n_terms = max(1, len(flat.dictionary))
            kinds, of = np.unique(langs.indices.to_numpy().astype(np.int64)[row] * n_terms + term, return_inverse=True)
            at = pa.array(row)
            out = _merged(len(kinds), of, counts.take(at), sure.take(at), docs.take(at), min_docs)
            who, what = np.divmod(kinds, n_terms)
            for s in range(0, len(kinds), 50_000):
                e = slice(s, s + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(who[e])), flat.dictionary.take(pa.array(what[e])), out[0][e], pa.array(out[1][e]), out[2][e]],
                    schema=_PACKED,
                )

    return run


def _kept_terms(min_docs: int):
    """Rows sorted by (language, term): counts of the terms that enough documents have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, BLOCK_ENTRIES):
            lang, key, counts, sure, docs = _columns(table)
            first, owner = _keys(lang, key)
            packed, kept, _ = _merged(len(first), owner, counts, sure, docs, min_docs)
            records, entries = _records(packed.filter(pa.array(kept)), _COUNT)
            entries = entries[entries > 0]
            at = pa.array(np.repeat(first[kept], entries))
            begin = np.cumsum(entries) - entries
            total = np.add.reduceat(records["n"], begin) if len(begin) else np.zeros(0, np.int64)
            leads = np.zeros(len(records), np.int64)
            leads[begin] = 1
            columns = [lang.take(at), key.take(at), records["group"].copy(), records["n"].copy(), np.repeat(total, entries), leads]
            whole = pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_KEPT)
            yield from whole.to_batches(max_chunksize=50_000)

    return run


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, group, n, total, first): occurrences of the kept terms of every language per source.

    ``group`` is :func:`group_code`, ``total`` the term's occurrences in the
    language, ``first`` is 1 in one row of every term.  A row is a document,
    repeated ones too.  Null text, language and source are empty strings.
    """
    empty = F.lit("")
    who, where = F.coalesce(F.col(lang).cast("string"), empty), F.coalesce(F.col(source).cast("string"), empty)
    rows = docs.select(
        who.alias("lang"), group_code(who, where).alias("group"), F.coalesce(F.col(text), empty).alias("text"), F.monotonically_increasing_id().alias("doc")
    )
    chunks = rows.mapInArrow(_count_chunks(min_docs), _PACKED_DDL)
    by_chunk = chunks.repartition("key").sortWithinPartitions("key", "lang")
    parts = by_chunk.mapInArrow(_chunks_to_terms(min_docs), _PACKED_DDL)
    by_term = parts.repartition("lang", "key").sortWithinPartitions("lang", "key")
    return by_term.mapInArrow(_kept_terms(min_docs), _KEPT_DDL)


# ── comparison ───────────────────────────────────────────────────────────────


def share(count: Column, of: Column, terms: Column) -> Column:
    """Parts in 10^9 of a count among ``of`` with two added to each of ``terms`` terms; null without terms."""
    whole = of.cast("decimal(20,0)") + F.lit(2) * terms.cast("decimal(20,0)")
    parts = F.lit(SCALE) * (count.cast("decimal(20,0)") + F.lit(2))
    return F.lit(1) + _div(parts, whole)


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.call_function("div", a, b))


def _pair_sums(key, kept: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms of one group for every two sources of its language."""
    codes, base = sources["group"].to_numpy(), sources["p0"].to_numpy()
    order = np.argsort(codes)
    codes, base = codes[order], base[order]
    term = kept["term"].combine_chunks().dictionary_encode() if kept.num_rows else None
    n_terms = len(term.dictionary) if kept.num_rows else 0
    row = term.indices.to_numpy() if kept.num_rows else np.zeros(0, np.int64)
    column = np.searchsorted(codes, kept["group"].to_numpy())
    p = kept["p"].to_numpy()
    # entries by source, so that a block of sources is a slice
    by_source = np.argsort(column, kind="stable")
    row, column, p = row[by_source], column[by_source], p[by_source]
    left, right, value = [], [], []

    def block(a: int, t: int, u: int) -> np.ndarray:
        """Shares of sources ``a`` on for the terms ``t`` to ``u``."""
        b = min(a + SOURCE_BLOCK, len(codes))
        out = np.repeat(base[None, a:b], u - t, axis=0)
        s = slice(*np.searchsorted(column, [a, b]))
        inside = (row[s] >= t) & (row[s] < u)
        out[row[s][inside] - t, column[s][inside] - a] = p[s][inside]
        return out

    for a in range(0, len(codes), SOURCE_BLOCK):
        for b in range(0, len(codes), SOURCE_BLOCK):
            wide = min(SOURCE_BLOCK, len(codes) - a), min(SOURCE_BLOCK, len(codes) - b)
            total = np.zeros(wide, np.int64)
            step = max(1, CELLS // (wide[0] * wide[1]))
            for t in range(0, n_terms, step):
                u = min(t + step, n_terms)
                x, y = block(a, t, u)[:, :, None], block(b, t, u)[:, None, :]
                total += ((x - y) ** 2 // (x + y)).sum(axis=0)
            i, j = np.indices(wide)
            left.append(codes[a + i.ravel()])
            right.append(codes[b + j.ravel()])
            value.append(total.ravel())
    lang = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, value)]
    return pa.table({"lang": pa.array([lang] * len(flat[0]), pa.string()), "left": flat[0], "right": flat[1], "value": flat[2]})


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source) group.

    Part ``pair``: the divergence from each other source of the language, all
    of them.  Part ``term``: the ``top_terms`` terms that stand out most
    against the whole language.  Ranks go by falling value, then by the item's
    bytes.  Groups without terms have pairs too (value 0 where the language
    keeps no term).  Null columns are empty strings, empty texts have no terms,
    repeated rows count as documents of their own, other columns are not
    looked at; an empty table gives no row.
    """
    empty = F.lit("")
    kept = stage(term_counts(docs, text, lang, source, min_docs))
    named = docs.select(F.coalesce(F.col(lang).cast("string"), empty).alias("lang"), F.coalesce(F.col(source).cast("string"), empty).alias("source"))
    named = named.distinct().withColumn("group", group_code(F.col("lang"), F.col("source")))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("first").alias("v"), F.count("*").alias("entries"))
    many = named.groupBy("lang").agg(F.count("*").alias("sources"))
    of_group = kept.groupBy("lang", "group").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    groups = (
        named.join(many, "lang")
        .join(of_lang, "lang", "left")
        .join(of_group, ["lang", "group"], "left")
        .select("lang", "source", "group", "sources", *[F.coalesce(c, zero).alias(c) for c in ("lang_n", "v", "entries", "group_n")])
    )
    groups = stage(groups.withColumn("p0", F.coalesce(share(zero, F.col("group_n"), F.col("v")), zero)))
    # a group gives a row for every two sources, so it holds no fewer entries than that
    salts = F.ceil(F.col("entries") / F.greatest(F.lit(GROUP_ENTRIES), F.col("sources") * F.col("sources"))).cast("int")
    shares = kept.join(groups.drop("p0"), ["lang", "group"]).select(
        "lang", "source", "group", "term", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), F.pmod(F.xxhash64("term"), salts).cast("int").alias("salt"),
    )

    # every group of terms meets all sources of its language
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))).select("lang", "salt", "group", "p0")
    sums = (
        shares.select("lang", "salt", "term", "group", "p")
        .groupBy("lang", "salt")
        .cogroup(copies.groupBy("lang", "salt"))
        .applyInArrow(_pair_sums, "lang string, left long, right long, value long")
    )
    pairs = sums.where(F.col("left") != F.col("right")).groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "group", "source")
    pairs = (
        pairs.join(names.toDF("lang", "left", "source"), ["lang", "left"])
        .join(names.toDF("lang", "right", "item"), ["lang", "right"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    p, q = F.col("p"), F.col("q")
    ahead = shares.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div((p - q) * (p - q), p + q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
