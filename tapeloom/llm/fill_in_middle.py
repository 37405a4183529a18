"""Fill-in-the-middle with an indexable skip list.

A text is a row of tokens, runs of ASCII letters or single other characters.
Its boundaries are the nodes of a skip list: lane 0 links every boundary with
the next, each higher lane about a quarter of them, and every link carries how
many tokens and how many code points it spans.  Going down from the highest
lane by summed widths reaches the boundary of any rank, and with it the place
in the text, in a logarithmic number of steps.

Two ranks drawn by a hash of the document's id cut the text into prefix, middle
and suffix, which are put together again as prefix, suffix, middle (psm) or
suffix, prefix, middle (spm), or the text stays as it is (plain).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SPM_PERCENT = 1, 90, 20
LANE_BITS = 2
#: Characters of text that one result batch holds.
BATCH_CHARS = 8_000_000

_RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class SkipList:
    """Boundaries between tokens with lanes of token and code-point widths."""

    def __init__(self, offsets: np.ndarray):
        """``offsets``: the place of every boundary in code points, the first 0."""
        places = np.arange(len(offsets))
        height = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        height ^= height >> np.uint64(32)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # token widths, code-point widths, place in the lane below
        down = places
        nodes = places
        while True:
            self.lanes.append((np.diff(nodes), np.diff(offsets[nodes]), down))
            if len(nodes) <= 1 << LANE_BITS:
                break
            height >>= np.uint64(LANE_BITS)
            stays = (height[nodes] & np.uint64((1 << LANE_BITS) - 1)) == 0
            stays[0] = True
            if stays.all() or len(self.lanes) > 30:
                break
            down = np.flatnonzero(stays)
            nodes = nodes[down]

    def seek(self, rank: int) -> int:
        """Code points before the boundary that has ``rank`` tokens before it."""
        at = tokens = chars = 0
        for units, points, down in reversed(self.lanes):
            while at < len(units) and tokens + units[at] <= rank:
                tokens += int(units[at])
                chars += int(points[at])
                at += 1
            at = int(down[at])
        if tokens != rank:
            raise IndexError(rank)
        return chars


def boundaries(text: str) -> np.ndarray:
    """Places between the tokens of a text, its begin and end included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    begins = np.ones(len(points) + 1, bool)
    begins[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins) if len(points) else np.zeros(1, np.int64)


def _cut(text: str, form: str, h1: int, h2: int) -> tuple:
    offsets = boundaries(text)
    n = len(offsets) - 1
    if form == "plain":
        return n, form, None, None, text
    lanes = SkipList(offsets)
    a, b = sorted((lanes.seek(h1 % (n + 1)), lanes.seek(h2 % (n + 1))))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if form == "psm":
        out = PREFIX + head + SUFFIX + tail + MIDDLE + middle
    else:
        out = SUFFIX + tail + PREFIX + head + MIDDLE + middle
    return n, form, a, b - a, out


def _cut_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, form, h1, h2, text = batch.columns
        forms, first, second = form.to_pylist(), h1.to_pylist(), h2.to_pylist()
        rows: list[tuple] = []
        start = size = 0
        for i in range(batch.num_rows):
            rows.append(_cut(text[i].as_py(), forms[i], first[i], second[i]))
            size += len(rows[-1][4])
            if size >= BATCH_CHARS or i == batch.num_rows - 1:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                results = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([key.slice(start, len(rows)), *results], ["key", *_RESULTS])
                rows, start, size = [], i + 1, 0


def _draw(digest: Column, number: int) -> Column:
    """The ``number``-th (from 1) group of eight hexadecimal digits."""
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """All columns but the text with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Null and empty texts have no tokens and stay plain, and so do texts that
    contain a marker and a share of 100 - ``cut_percent`` of all.  A null id
    draws like an empty one; repeated rows get equal results.  Texts of any
    length are cut whole.  Columns named like the results are replaced.
    """
    others = [c for c in docs.columns if c != text and c not in _RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc).cast("string"), F.lit(""))), 256)
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = (whole == "") | whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    form = (
        F.when(marked | (F.pmod(_draw(digest, 3), F.lit(100)) >= cut_percent), "plain")
        .when(F.pmod(_draw(digest, 4), F.lit(100)) < spm_percent, "spm")
        .otherwise("psm")
    )
    key = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("_none"))
    packed = docs.select(key.alias("key"), form.alias("form"), _draw(digest, 1).alias("h1"), _draw(digest, 2).alias("h2"), whole.alias("text"))
    fields = packed.schema["key"].dataType.simpleString()
    got = packed.mapInArrow(_cut_rows, f"key {fields}, n long, form string, prefix_chars long, middle_chars long, output string")
    return got.select(*[F.col("key")[c].alias(c) for c in others], *_RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`transform` was given, out of its output and form."""

    def cut(first: str, second: str, ahead: bool) -> Column:
        # a marker ends where it first does: no part contains one and none overlaps itself
        begin = F.lit(len(first) + 1)
        mid = F.locate(second, output)
        last = F.call_function("locate", F.lit(MIDDLE), output, mid + len(second))
        one = F.substring(output, begin, mid - begin)
        two = F.substring(output, mid + len(second), last - mid - len(second))
        tail = F.substring(output, last + len(MIDDLE), F.char_length(output))
        return F.concat(one, tail, two) if ahead else F.concat(two, tail, one)

    return F.when(form == "psm", cut(PREFIX, SUFFIX, True)).when(form == "spm", cut(SUFFIX, PREFIX, False)).otherwise(output)
