"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its word shingles.  Two documents link when their sets
have a Jaccard similarity of ``percent`` / 100 or more.

* Sets are put into bands of sizes that overlap so far that two linked sets are
  always in one band together.  In a band, linked sets differ in at most k
  shingles.
* The domain of shingles (their hashes) is cut into first-level parts, each of
  these into ``n2`` second-level ones.  Every subset of ``n2`` - ``k2`` of a
  part's pieces gives a signature: the hash of what the set has there.  With
  more than k / (k2 + 1) first-level parts, linked sets agree on some subset,
  so they share a signature.
* A subset where a set has nothing would be shared by all that have nothing
  there, so empty subsets give no signature.  Bands have some parts to spare
  for that; a set with more gaps than those is hashed anew with another seed,
  and as its partner either has fewer gaps or does the same, none is missed.

Signatures only name candidates; every link is decided by the sets themselves.
Equal sets are one class from the start and candidates are tried class by
class: first every class with the smallest one it shares a signature with, and
only between components that are still apart after that all of them, block by
block and by bounds on what they have in common before the sets are fetched.  Sets of shingles
are compared by 64-bit hashes, classes by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import bloom
from tapeloom.runtime import bucket_count, stage

WORDS, PERCENT = 5, 80
BAND_GROWTH = 1.25
#: Second-level pieces of a part and how many of them may differ; the cheapest is taken per band.
SPLITS = ((3, 2), (3, 1), (4, 2), (4, 1))
SEEDS = 8
CELLS, PARITIES = 256, 1024
#: Bits of a signature, and signatures that a task holds at a time.
SIGN_BITS, SIGNS_HELD = 56, 4_000_000
#: Members of a signature that one task compares with each other; larger groups are compared block by block.
BLOCK_ROWS = 2000
#: One in so many signatures is looked at first where components meet.
FIRST_SHARE = 16

#: A-Z lower-cased, ASCII white space as blanks.
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if 9 <= i <= 13 else i for i in range(256))
_U = np.uint64
#: Odd multipliers and shifts of a 64-bit mixing function.
_M1, _M2, _ROLL = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


# ── sets ─────────────────────────────────────────────────────────────────────


#: A number for every byte, and an odd base whose powers place it in its word.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ROLL)
_BASE = 0xD6E8FEB86659FD93
_PIECE = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` or more of them."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def _piece_codes(text: bytes) -> np.ndarray:
    letters = np.frombuffer(text, np.uint8)
    n = len(letters)
    up, down = _power_tables(n + 1)
    solid = np.zeros(n + 2, bool)
    np.not_equal(letters, 32, out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[letters] * up[:n], out=sums[1:])
    return _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * _M1)


def word_codes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased, in order.

    A word's hash is a polynomial in its bytes, taken from running sums over
    the whole text; long texts are read in pieces that end at white space.
    """
    plain = text.translate(_LOWER)
    out, start = [], 0
    while start < len(plain):
        end = start + _PIECE
        if end < len(plain):
            gap = plain.find(b" ", end)
            end = len(plain) if gap < 0 else gap
        out.append(_piece_codes(plain[start:end]))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text, A-Z lower-cased.

    With fewer words than a shingle has, the whole sequence is the only one.
    """
    c = word_codes(text)
    n = len(c)
    if not n:
        return c
    span = min(words, n)
    h = c[: n - span + 1].copy()
    for i in range(1, span):
        h *= _ROLL
        h += c[i : n - span + 1 + i]
    h = _mix(h + _U(span))
    h.sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


# ── bands and signatures ─────────────────────────────────────────────────────


def bands(percent: int, largest: int, growth: float = BAND_GROWTH) -> list[tuple[int, int]]:
    """(smallest, largest) set size of every band up to one that holds ``largest``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1 to 100")
    if percent == 100:
        return []  # equal sets only
    top = 0
    while 100 * top < percent * (top + 1):
        top += 1  # sets up to this size link with equal ones only
    out: list[tuple[int, int]] = []
    while not out or out[-1][1] < largest:
        low = max(1, -(-percent * (top + 1) // 100))
        top = max(top + 1, int(top * growth))
        out.append((low, top))
    return out


def _plan(k: int, low: int) -> tuple[int, int, int, list[tuple[int, ...]]]:
    """First-level parts, spare ones among them, pieces and subsets for k differences.

    Gaps are expected as in the band's smallest set.  Of the plans under which
    at most one set in eight needs another seed, the one with the fewest
    signatures; without any, the one that needs other seeds least.
    """
    found = []
    for n2, k2 in SPLITS:
        subsets = list(combinations(range(n2), n2 - k2))
        need = k // (k2 + 1) + 1
        for spare in range(need // 2 + 5):
            n1 = need + spare
            gaps = n1 * len(subsets) * float(np.exp(-low * (n2 - k2) / (n1 * n2)))
            term = total = float(np.exp(-gaps))
            for i in range(1, spare + 1):
                term *= gaps / i
                total += term
            again = max(0.0, 1 - total)
            cost = n1 * len(subsets) / max(1 - again, 1e-9)
            found.append(((0, cost) if again <= 0.125 else (1, again), n1, spare, n2, subsets))
            if again <= 0.125:
                break  # more parts only cost more
    _, n1, spare, n2, subsets = min(found, key=lambda p: p[0])
    return n1, spare, n2, subsets


class _Band:
    """What every set of a band needs to be signed."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        k = 2 * high * (100 - percent) // (100 + percent)
        n1, self.spare, self.n2, subsets = _plan(k, low)
        self.n1 = n1
        pieces = n1 * self.n2
        self.edges = np.array([i * (1 << 64) // pieces for i in range(1, pieces)], np.uint64)
        self.subsets = np.array(subsets)  # one row of pieces per subset
        self.weights = np.array([int(_ROLL) * (2 * i + 3) % (1 << 64) for i in range(self.n2)], np.uint64)
        places = np.arange(n1 * len(subsets), dtype=np.uint64)
        self.tags = _mix(places + _U((number + 1) << 32)).reshape(n1, len(subsets))

    def sign(self, h: np.ndarray, sums: np.ndarray, seed: int) -> tuple[np.ndarray, bool]:
        """Signatures of a sorted set and whether it has more gaps than the band can spare.

        ``sums`` are the running sums of the mixed members, from 0.
        """
        cuts = np.empty(len(self.edges) + 2, np.int64)
        cuts[0], cuts[-1] = 0, len(h)
        cuts[1:-1] = np.searchsorted(h, self.edges)
        upto = sums[cuts]
        parts = (upto[1:] - upto[:-1]).reshape(self.n1, self.n2) * self.weights
        filled = (cuts[1:] > cuts[:-1]).reshape(self.n1, self.n2)
        full, signs = filled[:, self.subsets[:, 0]], parts[:, self.subsets[:, 0]] + (self.tags + _U(seed))
        for j in range(1, self.subsets.shape[1]):
            full |= filled[:, self.subsets[:, j]]
            signs += parts[:, self.subsets[:, j]]
        signs = _mix(signs)
        gaps = self.n1 - int(full.all(axis=1).sum())
        return signs.ravel() if seed == SEEDS - 1 else signs[full], gaps > self.spare


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(_mix(h + _ROLL), out=out[1:])
    return out


@lru_cache(maxsize=16)
def _all_bands(percent: int, power: int) -> list[tuple[int, int, _Band]]:
    """Bands for sets of up to 2 ** power shingles."""
    return [(a, b, _Band(i, a, b, percent)) for i, (a, b) in enumerate(bands(percent, 1 << power))]


def signatures(h: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set; linked sets that differ share at least one."""
    out, views = [], []  # views: the set under each seed
    for low, high, band in _all_bands(percent, max(12, len(h).bit_length())):
        if low > len(h):
            break
        if len(h) > high:
            continue
        for seed in range(SEEDS):
            if len(views) == seed:
                view = h if seed == 0 else np.sort(_mix(h ^ _mix(np.full(1, seed, np.uint64))))
                views.append((view, _sums(view)))
            signs, gaps = band.sign(*views[seed], seed)
            out.append(signs)
            if not gaps:
                break
    return np.concatenate(out) >> _U(64 - SIGN_BITS) if out else np.zeros(0, np.uint64)


def signature_count(n: int, percent: int) -> int:
    """At most so many signatures has a set of ``n`` shingles under its first seed."""
    fitting = (band for low, high, band in _all_bands(percent, max(12, n.bit_length())) if low <= n <= high)
    return sum(band.tags.size for band in fitting)


def cell_counts(h: np.ndarray) -> np.ndarray:
    """Shingles per cell of the domain, at most 255: a lower bound for differences."""
    counts = np.bincount((h >> _U(56)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8)


def parities(h: np.ndarray) -> np.ndarray:
    """One bit per cell, whether it holds an odd number: two sets differ in at least as many shingles as bits."""
    counts = np.bincount((h >> _U(54)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(bool))


def _linked(same: int, a: int, b: int, percent: int) -> bool:
    return 100 * same >= percent * (a + b - same)


# ── passes over the documents ────────────────────────────────────────────────


def _distinct_sets(batches: Iterable[pa.RecordBatch], words: int, column: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(class, set) of the texts of one task, every class once."""
    seen: set[bytes] = set()
    for batch in batches:
        for text in batch.column(column):
            h = shingles(text.as_py() or b"", words)
            if len(h) and (fp := xxhash.xxh3_128_digest(h.tobytes())) not in seen:
                seen.add(fp)
                yield fp, h


def _describe_documents(words: int, percent: int):
    schema = pa.schema(
        [("doc", pa.int64()), ("copy", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("cells", pa.binary()), ("parity", pa.binary()), ("signs", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # one description per class and task
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                piece = batch.slice(start, 500)
                for doc, copy, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2), strict=True):
                    h = shingles(text.as_py() or b"", words)
                    if not len(h):
                        rows.append((doc, copy, 0, None, None, None, None))
                        continue
                    fp = xxhash.xxh3_128_digest(h.tobytes())
                    if fp in seen:
                        rows.append((doc, copy, len(h), fp, None, None, None))
                        continue
                    seen.add(fp)
                    rows.append((doc, copy, len(h), fp, cell_counts(h).tobytes(), parities(h).tobytes(), signature_count(len(h), percent)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


# ── which signatures several classes have ────────────────────────────────────


def _packed_runs(values: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(range, first value, bytes a step, steps) of sorted 56-bit values, cut at equal ranges of the domain."""
    edges = np.array([i * (1 << SIGN_BITS) // ranges for i in range(1, ranges)], np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a == b:
            continue
        steps = np.diff(values[a:b])
        wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
        yield i, int(values[a]), wide, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpacked(first: int, wide: int, steps: bytes) -> np.ndarray:
    raw = np.frombuffer(steps, np.uint8).reshape(-1, wide)
    full = np.zeros((len(raw) + 1, 8), np.uint8)
    full[1:, :wide] = raw
    out = full.view("<u8").ravel()
    out[0] = first
    return np.cumsum(out, dtype=np.uint64)


def _sign_ranges(words: int, percent: int, ranges: int):
    """Signatures of a task's classes as a few sorted runs of short steps."""
    schema = pa.schema([("range", pa.int32()), ("first", pa.int64()), ("wide", pa.int32()), ("steps", pa.binary())])

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        for row in _packed_runs(values, ranges):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for _, h in _distinct_sets(batches, words, 0):
            held.append(signatures(h, percent))
            size += len(held[-1])
            if size >= SIGNS_HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values that stand in the runs of a range twice or more; rows come sorted by range."""

    def found(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        twice = np.unique(values[1:][values[1:] == values[:-1]]).view(np.int64)
        for s in range(0, len(twice), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(twice[s : s + 100_000])], ["sign"])

    held: list[np.ndarray] = []
    now = None
    for batch in batches:
        for number, first, wide, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != now and held:
                yield from found(held)
                held = []
            now = number
            held.append(_unpacked(first, wide, steps))
    if held:
        yield from found(held)


def _signs_of(words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps: list[bytes] = []
        signs: list[np.ndarray] = []
        for fp, h in _distinct_sets(batches, words, 0):
            fps.append(fp)
            signs.append(signatures(h, percent).view(np.int64))
            if len(fps) == 200:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["fp", "signs"])
                fps, signs = [], []
        if fps:
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["fp", "signs"])

    return run


def _shared_signatures(rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(sign, fp) of the signatures that two classes or more have, staged.

    Classes are signed once to find the values that repeat, sent as sorted runs
    of a few bytes a value, and once more to name the classes of those; no
    signature is written in between.  Each class is signed where its first
    document is read.
    """
    wanted = bloom.build(classes, "rep")
    first = rows.where(wanted.might_contain(_key(F.col("doc")))).select("text")
    total = classes.agg(F.sum("signs")).first()[0] or 0
    ranges = max(bucket_count(rows), -(-total // SIGNS_HELD))
    runs = first.mapInArrow(_sign_ranges(words, percent, ranges), "range int, first long, wide int, steps binary")
    dealt = runs.repartition(F.col("range")).sortWithinPartitions("range")
    several = stage(dealt.mapInArrow(_repeated, "sign long"))
    maybe = bloom.build(several, "sign")
    spread = first.mapInArrow(_signs_of(words, percent), "fp binary, signs array<long>").select("fp", F.explode("signs").alias("sign"))
    return stage(spread.where(maybe.might_contain(F.col("sign"))).select("sign", "fp").join(several, "sign").distinct())


# ── passes over pairs ────────────────────────────────────────────────────────


def _sets_of(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = [shingles(t.as_py() or b"", words) for t in batch.slice(start, 500).column(0)]
                sets = [h for h in sets if len(h)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                        pa.array([h.tobytes() for h in sets], pa.binary()),
                    ],
                    ["fp", "members"],
                )

    return run


def _could_link(percent: int):
    """Drops pairs whose cell counts already differ too much."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, na, nb, ca, cb = batch.columns
            na, nb = na.to_numpy(), nb.to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 4000):
                x = np.frombuffer(b"".join(ca.slice(i, 4000).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
                y = np.frombuffer(b"".join(cb.slice(i, 4000).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
                apart = np.abs(x - y).sum(axis=1)
                total = na[i : i + 4000] + nb[i : i + 4000]
                # |A ∪ B| - |A ∩ B| >= apart, so |A ∩ B| <= (total - apart) / 2
                keep[i : i + 4000] = 100 * (total - apart) >= percent * (total + apart)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def _bucket_pairs(percent: int, one_each: bool):
    """Pairs of a signature's members in different components that could link.

    Rows come sorted by (sign, lo, hi): two blocks of one signature's members,
    or one block with itself.  With ``one_each`` only the first partner of
    every member is named.
    """

    def compare(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        lo, hi = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == lo]
        right = left if lo == hi else [r for r in rows if r[3] == hi]
        if not left or not right:
            return
        fields = [
            (np.array([r[6] for r in side]), np.frombuffer(b"".join(r[7] for r in side), np.uint64).reshape(-1, PARITIES // 64))
            for side in (left, right)
        ]
        names = {r[5]: i for i, r in enumerate(rows)}
        root_l, root_r = (np.array([names[r[5]] for r in side]) for side in (left, right))
        (n_l, c_l), (n_r, c_r) = fields
        for i in range(len(left)):
            from_ = i + 1 if lo == hi else 0
            total = n_r[from_:] + n_l[i]
            fits = (root_r[from_:] != root_l[i]) & (100 * np.minimum(n_r[from_:], n_l[i]) >= percent * np.maximum(n_r[from_:], n_l[i]))
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            apart = np.bitwise_count(c_r[from_ + at] ^ c_l[i]).sum(axis=1, dtype=np.int64)
            at = at[100 * (total[at] - apart) >= percent * (total[at] + apart)]
            for j in at[:1] if one_each else at:
                a, b = left[i][4], right[from_ + int(j)][4]
                yield (a, b) if a < b else (b, a)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    out.update(compare(held))
                    held = []
                held.append(row)
            if len(out) > 50_000:
                yield _pair_batch(out)
                out = set()
        if held:
            out.update(compare(held))
        yield _pair_batch(out)

    return run


def _pair_batch(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])


def _do_link(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep, left, left_raw = [], None, None
            for p, q in zip(x, y, strict=True):
                raw = p.as_py()
                if raw != left_raw:
                    left, left_raw = np.frombuffer(raw, np.uint64), raw
                right = np.frombuffer(q.as_py(), np.uint64)
                at = np.searchsorted(left, right)
                at[at == len(left)] = 0
                keep.append(_linked(int((left[at] == right).sum()), len(left), len(right), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


# ── links and components ─────────────────────────────────────────────────────


class _Links:
    """Decides candidate pairs of classes."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int):
        self.docs, self.classes, self.words, self.percent = docs, classes, words, percent

    def among(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b), staged."""
        side = self.classes.select("fp", "n", "cells")
        near = (
            pairs.join(side.toDF("a", "na", "ca"), "a")
            .join(side.toDF("b", "nb", "cb"), "b")
            .select("a", "b", "na", "nb", "ca", "cb")
            .mapInArrow(_could_link(self.percent), "a binary, b binary")
        )
        near = stage(near)
        # the sets of these classes, made again from one document of each
        named = stage(near.select("a").union(near.select("b")).distinct().join(self.classes, F.col("a") == F.col("fp")).select("fp", "rep"))
        wanted = bloom.build(named, "rep")
        sets = (
            self.docs.where(wanted.might_contain(_key(F.col("doc"))))
            .select("text")
            .mapInArrow(_sets_of(self.words), "fp binary, members binary")
            .join(named.select("fp"), "fp", "left_semi")
            .groupBy("fp")
            .agg(F.first("members").alias("members"))
        )
        sets = stage(sets)
        return stage(
            near.join(sets.toDF("b", "y"), "b")
            .join(sets.toDF("a", "x"), "a")
            .select("a", "b", "x", "y")
            .mapInArrow(_do_link(self.percent), "a binary, b binary")
        )


def _key(*columns: Column) -> Column:
    """A document's id (and text) as a key that null has too."""
    return F.xxhash64(*columns)


def components(links: DataFrame) -> DataFrame:
    """(fp, root) for every class with a link; the root is the component's smallest class.

    Every round hands the smallest root to all neighbours and then follows each
    root's own root, so the longest way halves; the tables stay on shared disk.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    roots = stage(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        offered = both.join(roots.toDF("b", "offer"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("offer").alias("offer"))
        lower = roots.join(offered, "fp").select("fp", F.least("root", "offer").alias("root"), F.col("root").alias("was"))
        lower = stage(lower)
        jumped = lower.join(lower.select(F.col("fp").alias("root"), F.col("root").alias("next")), "root").select(
            "fp", F.least("root", "next").alias("root"), "was"
        )
        jumped = stage(jumped)
        roots = jumped.select("fp", "root")
        if jumped.where(F.col("root") != F.col("was")).isEmpty():
            return roots


def _apart(shared: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of signatures that several components share, with what is needed to compare them."""
    named = shared.join(roots, "fp", "left").select("sign", "fp", F.coalesce("root", "fp").alias("root"))
    named = stage(named)
    several = (
        named.groupBy("sign")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"))
        .where(F.col("low") != F.col("high"))
        .select("sign", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    return named.join(stage(several), "sign").join(classes.select("fp", "n", "parity"), "fp")


def _compared(meeting: DataFrame, percent: int, one_each: bool) -> DataFrame:
    """Distinct pairs that could link, staged; every two blocks of a signature meet in one group."""
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = meeting.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select(
        "sign", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "root", "n", "parity"
    )
    dealt = keyed.repartition("sign", "lo", "hi").sortWithinPartitions("sign", "lo", "hi", "fp")
    return stage(dealt.mapInArrow(_bucket_pairs(percent, one_each), "a binary, b binary").distinct())


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(document, n_shingles, component_id) for every row of ``docs``.

    Null and empty texts have no shingles and link with nothing; their
    component is their own id, also where that is null.  A component whose ids
    are all null has the id null.  Repeated rows are linked like any equal
    texts.  Other columns are not looked at.
    """
    return _grouped(docs, doc, text, words, percent).select(F.col("doc").alias(doc), "n_shingles", "component_id")


def _grouped(docs: DataFrame, doc: str, text: str, words: int, percent: int) -> DataFrame:
    """The same with ``copy``, a hash of the text."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("copy"), F.col(text).cast("binary").alias("text"))
    signed = stage(
        rows.mapInArrow(
            _describe_documents(words, percent), "doc long, copy long, n long, fp binary, cells binary, parity binary, signs long"
        )
    )
    members = signed.select("doc", "copy", "n", "fp")
    classes = stage(
        signed.where(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(F.min("doc").alias("first_doc"), *[F.max(c).alias(c) for c in ("n", "cells", "parity", "signs")])
        .withColumn("rep", _key(F.col("first_doc")))
    )
    shared = _shared_signatures(rows, classes, words, percent)

    links = _Links(rows, classes, words, percent)
    # every class with the smallest one of all its signatures
    smallest = shared.groupBy("sign").agg(F.min("fp").alias("low"))
    first = shared.join(stage(smallest), "sign").groupBy(F.col("fp").alias("b")).agg(F.min("low").alias("a"))
    found = links.among(first.where(F.col("a") != F.col("b")).select("a", "b"))
    roots = components(found)
    # where components still meet: one candidate for every member, over a share of the signatures and then over all, which
    # joins what links at many places with few candidates; then all candidates of all signatures, so nothing is left out
    for share, one_each in ((FIRST_SHARE, True), (1, True), (1, False)):
        part = shared if share == 1 else shared.where(F.pmod(F.xxhash64("sign"), F.lit(share)) == 0)
        candidates = _compared(_apart(part, classes, roots), percent, one_each)
        if candidates.isEmpty():
            if share > 1:
                continue
            break
        more = links.among(candidates)
        if not more.isEmpty():
            found = stage(found.union(more))
            roots = components(found)

    named = classes.select("fp", "first_doc").join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = stage(named)
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_class = stage(named.join(least, "root").select(F.col("fp").alias("class"), "component_id"))
    return members.join(by_class, F.col("fp") == F.col("class"), "left").select(
        "doc",
        "copy",
        F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of every group, the one with the smallest id, columns unchanged.

    Of repeated rows (equal id and text) one stays, and so does one of a
    group's rows with different ids; texts without words all stay.  In a group
    without any id every text stays once.  Only rows that may go are shuffled.
    """
    grouped = stage(_grouped(docs, doc, text, words, percent)).where(F.col("n_shingles") > 0)
    going = grouped.where(~F.col("doc").eqNullSafe(F.col("component_id"))).select("doc", "copy", F.lit(True).alias("goes"))
    leading = grouped.where(F.col("doc").eqNullSafe(F.col("component_id")))
    # several texts of one id lead the same group: the smallest hash stays
    heads = leading.groupBy("doc").agg(F.min("copy").alias("first"), F.max("copy").alias("other"), F.count("*").alias("n"))
    several = heads.where((F.col("n") > 1) & F.col("doc").isNotNull())
    extra = leading.join(several, "doc").select("doc", "copy", (F.col("copy") != F.col("first")).alias("goes"))
    nameless = leading.where(F.col("doc").isNull()).select("doc", "copy", F.lit(False).alias("goes"))
    touched = stage(going.union(extra).union(nameless).distinct())
    touched = touched.withColumn("k", _key(F.col("doc"), F.col("copy")))
    copy = F.xxhash64(text)
    maybe = bloom.build(touched, "k").might_contain(_key(F.col(doc), copy))
    packed = F.struct(*docs.columns).alias("row")
    sure = docs.where(~maybe)
    some = docs.where(maybe).select(packed, F.col(doc).alias("d"), copy.alias("h"), F.col(text).alias("t"))
    gone = touched.where("goes").select("doc", "copy")
    left = some.join(gone, F.col("d").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("copy")), "left_anti")
    # rows that are here by mistake of the filter, or repeats of which one stays
    again = touched.where(~F.col("goes")).select(F.col("doc").alias("d2"), F.col("copy").alias("h2"))
    same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2"))
    once = left.join(again, same, "left_semi").dropDuplicates(["d", "h"])
    rest = left.join(again, same, "left_anti")
    return sure.union(rest.select("row.*")).union(once.select("row.*"))
