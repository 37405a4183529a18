"""Token ids in wavelet-matrix shards.

Documents are ordered by id or by given columns, encoded and packed into shards of about
``SHARD_TOKENS`` ids, cut between documents.  A shard is a wavelet matrix: one
bit plane for every bit of an id, highest first, each followed by a stable move
of its zeros before its ones.  Counts of ones per block of 512 bits give rank
in constant and select in logarithmic time, so a shard answers what id stands
at a place, how often an id occurs and where, without being unpacked.

Shards are rows of Parquet files (zstd) that Spark writes and commits, a file
for every range of documents, so a lost executor costs its own files only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 16
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
END_ID = 2
CACHE_WORDS = 700_000
#: Text that is encoded at a time.
BLOCK_BYTES = 8_000_000
#: Pieces that the tokenizer's model gets in one call.
PIECES_AT_ONCE = 4096

SHARD_SCHEMA = (
    "part int, seq int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "zeros array<long>, planes array<binary>, ranks array<binary>"
)


# ── encoding ─────────────────────────────────────────────────────────────────

#: How the tokenizer splits a lower-cased word without spaces.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_LATIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII or Latin-1 in UTF-8, and the full stop or comma that most often follows.
_PLAIN = re.compile(rb"((?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc2[\xaa\xb5\xba])++)([.,]?)")
_ODD = re.compile(r"[\x00-\x1f\x7f\x80-\xa0]|<\|")


#: Byte-level tokenizers write every byte as one character: printable Latin-1 as itself, the others from 256 on, in order.
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PLAIN_BYTES} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN_BYTES)))}


class _Recent:
    """A bounded cache of two generations: what is used moves into the new one."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict = {}
        self.old: dict = {}

    def absent(self, keys: set) -> set:
        """Of keys that ``new`` lacks the ones without a value; the others are in ``new`` afterwards."""
        back = {k: v for k in keys if (v := self.old.get(k)) is not None}
        if len(self.new) + len(keys) > self.limit:
            self.old, self.new = self.new, {}
        self.new.update(back)
        return keys.difference(back)


class WordEncoder:
    """Ids of texts by a tokenizer that never looks across white space.

    The library's model encodes every distinct piece of a word once, many in
    one call.  Texts are put together block by block: Arrow numbers a block's
    distinct words, one bounded cache of words and pieces (a lower-case word is
    its own piece) has their ids, and the numbers gather these.  Only words of
    Latin-1 letters are split here, all others go to the library whole.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model alone, for pieces that are already normalised and split
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = getattr(self.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << BITS, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self.latin = regex.compile(_LATIN_PIECES)
        self.words = _Recent(limit)

    def encode(self, text: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 16-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        words = split.flatten().view(pa.binary()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.words.new.get, distinct))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        if gaps:
            self._learn(self.words.absent({distinct[i] for i in gaps}))
            for i in gaps:
                got[i] = self.words.new[distinct[i]]
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 2
        known = np.frombuffer(b"".join(got), "<u2")
        codes = words.indices.to_numpy()
        many = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(many)])
        shift = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        raw = known[np.repeat(shift, many) + np.arange(ends[-1])].tobytes()
        cuts = (2 * ends[split.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, missing: set[bytes]) -> None:
        made, old, plain = self.words.new, self.words.old, _PLAIN.fullmatch
        # words, their pieces one after the other, and where each word's end: lists of plain values cost the collector nothing
        words: list[bytes] = []
        pieces: list[bytes] = []
        upto: list[int] = []
        whole: list[bytes] = []
        for w in missing:
            if w.isalpha():  # ASCII letters only
                pieces.append(w.lower())
            elif match := plain(w):
                stem, last = match.groups()
                pieces.append(stem.lower() if stem.isascii() else stem.decode().lower().encode())
                if last:
                    pieces.append(last)
            else:
                s = w.decode()
                if s and (max(s) > "\xff" or _ODD.search(s)):
                    whole.append(w)
                    continue
                parts = _ASCII_PIECES.findall(s.lower()) if w.isascii() else self.latin.findall(s.lower())
                pieces.extend([p.encode() for p in parts])
            words.append(w)
            upto.append(len(pieces))
        unknown = {p for p in pieces if p not in made}
        for p in list(unknown):
            if p in old:
                made[p] = old[p]
                unknown.discard(p)
        new = sorted(unknown)  # neighbours share merges
        for i in range(0, len(new), PIECES_AT_ONCE):
            some = new[i : i + PIECES_AT_ONCE]
            made.update(zip(some, self._pieces(some), strict=True))
        ids, start = [made[p] for p in pieces], 0
        for w, end in zip(words, upto, strict=True):
            made[w] = ids[start] if end == start + 1 else b"".join(ids[start:end])
            start = end
        if whole:
            encoded = self.tokenizer.encode_batch([w.decode() for w in whole], add_special_tokens=False)
            for w, e in zip(whole, encoded, strict=True):
                made[w] = np.array(e.ids, "<u2").tobytes()

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of lower-case pieces, cut where the model's ids end a word."""
        texts = [p.decode() if p.isascii() else p.decode("latin-1").translate(_BYTE_CHARS) for p in pieces]
        ids = np.array(self.bare.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u2")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):  # a model whose ids do not tell
            return [np.array([x.id for x in self.model.tokenize(t)], "<u2").tobytes() for t in texts]
        raw, cuts = ids.tobytes(), [0, *(2 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ── wavelet matrix ───────────────────────────────────────────────────────────


class WaveletMatrix:
    """Sequence of ids below 2**16 as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seq, n = ids.astype(np.uint16), len(ids)
        zeros, planes, ranks = [], [], []
        for bit in range(BITS - 1, -1, -1):
            ones = (seq & np.uint16(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-n // BLOCK_BITS) * (BLOCK_BITS // 8), np.uint8)
            padded[: len(packed)] = packed
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4").tobytes())
            low = seq[~ones]
            zeros.append(len(low))
            seq = np.concatenate([low, seq[ones]])
        return cls(n, zeros, planes, ranks)

    def ids(self) -> np.ndarray:
        """The whole sequence, undone from the last plane to the first."""
        seq = np.zeros(self.n, np.uint16)
        for bit, plane, z in zip(range(BITS), reversed(self.planes), reversed(self.zeros), strict=True):
            ones = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, np.uint16)
            above[~ones] = seq[:z]
            above[ones] = seq[z:] | np.uint16(1 << bit)
            seq = above
        return seq

    def _ones_before(self, level: int, i: int) -> int:
        block, plane = i // BLOCK_BITS, self.planes[level]
        base = int.from_bytes(self.ranks[level][4 * block : 4 * block + 4], "little")
        begin = block * (BLOCK_BITS // 8)
        head = int.from_bytes(plane[begin : -(-i // 8)], "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
        return base + head.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return self.planes[level][i // 8] >> (i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(BITS):
            ones, bit = self._ones_before(level, i), self._bit(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Range of the symbol among the first ``i`` places, on the last plane."""
        begin, end = 0, i
        for level in range(BITS):
            b, e = self._ones_before(level, begin), self._ones_before(level, end)
            if symbol >> (BITS - 1 - level) & 1:
                begin, end = self.zeros[level] + b, self.zeros[level] + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def rank(self, symbol: int, i: int) -> int:
        """How often the id occurs before place ``i``."""
        begin, end = self._range(symbol, min(max(i, 0), self.n))
        return end - begin

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones_before(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of the id."""
        begin, end = self._range(symbol, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in range(BITS - 1, -1, -1):
            bit = symbol >> (BITS - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


# ── shards ───────────────────────────────────────────────────────────────────


def _shard(part: int, seq: int, before: int, ids: list[bytes], keys: list[int | None]) -> dict:
    m = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u2"))
    return {
        "part": part, "seq": seq, "before": before, "n_tokens": m.n, "doc_ids": keys, "lengths": [len(x) // 2 for x in ids],
        "zeros": m.zeros, "planes": m.planes, "ranks": m.ranks,
    }


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
    ]
)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts in blocks of some bytes of text; a longer text is a block of its own."""
    for batch in batches:
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset : batch.column(1).offset + batch.num_rows + 1]))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
            part = batch.slice(start, end - start)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            start = end


def _pack(tokenizer: str, shard_tokens: int, end_id: int, keep_words: bool = True):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from packed(batches)
        finally:
            if not keep_words:
                _encoders.pop(tokenizer, None)

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u2").tobytes()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0
        for keys_read, texts in _blocks(batches):
            for key, got in zip(keys_read, encoder.encode_many(texts), strict=True):
                ids.append(got + end)
                keys.append(key)
                held += len(ids[-1]) // 2
                if held >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard(part, seq, before, ids, keys)], _ARROW)
                    ids, keys, seq, before, held = [], [], seq + 1, before + held, 0
        if ids:
            yield pa.RecordBatch.from_pylist([_shard(part, seq, before, ids, keys)], _ARROW)

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    doc: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    order: tuple[str, ...] = (),
    keep_words: bool = True,
) -> None:
    """Write the shards of all documents below ``path``, in ascending order of id or of the columns ``order``.

    ``tokenizer`` is the file's path, the same on every machine.  Null and
    empty texts have the end id alone; repeated and null ids (first) are kept,
    equal ids stand in the order of their texts; an empty table writes no rows.
    A text longer than a shard gets a longer shard.

    A worker keeps the words it learnt for its next task.  Workers serve other
    stages as well, so where those need the memory, ``keep_words=False`` lets
    go of the words with the task.
    """
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(order)] or [F.col(doc).cast("long").alias("_by0")]
    places = [f"_by{i}" for i in range(len(by))]
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *by)
    ordered = rows.repartitionByRange(*places).sortWithinPartitions(*places, "doc", "text").select("doc", "text")
    shards = ordered.mapInArrow(_pack(tokenizer, shard_tokens, end_id, keep_words), SHARD_SCHEMA)
    # small row groups: a writer never buffers more than a few shards
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).ids()
            raw = memoryview(ids.astype("<u4").tobytes())
            edges = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
            cuts = edges.tolist()
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(crcs), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(edges[:-1] + row["before"], pa.int64()),
                    pa.array(row["lengths"], pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["part", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, out of the planes."""
    shards = read_shards(spark, path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    docs = shards.mapInArrow(_unpack, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(bases, F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
