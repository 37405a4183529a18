"""Toxicity by noisy-channel deobfuscation.

What someone meant to write goes through a channel that swaps letters for look-alikes
(leetspeak), puts separators between letters and repeats letters.  A character
trigram model of the whole corpus says how likely a piece of writing is; each
suspicious span becomes a lattice of readings, and a Viterbi search takes the
reading whose channel and language costs are lowest.  Spans that the channel
cannot have touched (letters only, no run of three) have one reading, themselves.

Restored texts are scored by a logistic model over words and word beginnings:
what tells toxic from other texts best is selected by grouped counts over a
bounded set of labelled rows (``MAX_LABELLED``), then weighted on those rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.runtime import stage

#: Bound of the labelled rows that are fitted, a third of them at most of the rarer label 1.
MAX_LABELLED = 12_000
SELECTED, THRESHOLD = 1024, 0.7
PREFIXES = (4, 5, 6, 7)
CACHE_TOKENS, SLICE = 300_000, 200

# ── alphabet and language model ──────────────────────────────────────────────

#: Classes of characters: 0 a boundary, 1-26 a-z, 27-58 the letters of Latin-1, then other letters, digits and signs.
CLASSES, OTHER, DIGIT, SIGN = 64, 59, 60, 61
_KNOWN = 0x250


def _class_of(char: str) -> int:
    if char.isspace():
        return 0
    low = char.lower()
    if "a" <= low <= "z" and len(low) == 1:
        return ord(low) - 96
    if low.isalpha():
        return 27 + ord(low) - 0xDF if len(low) == 1 and 0xDF <= ord(low) <= 0xFE else OTHER
    return DIGIT if low.isdigit() else SIGN


_CLASS = np.array([_class_of(chr(i)) for i in range(_KNOWN)], np.int32)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of the class trigrams of texts, each text between boundaries."""
    points = np.frombuffer(("  " + "  ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(points < _KNOWN, _CLASS[np.minimum(points, _KNOWN - 1)], OTHER)
    # one boundary between words
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    return np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=CLASSES**3)


def _count_trigrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for s in range(0, batch.num_rows, SLICE):
            total += trigram_counts([t for t in batch.column(0).slice(s, SLICE).to_pylist() if t])
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (nats) of every class after every two others, from all texts.

    Tasks send their counts of at most 64^3 trigrams; so many sums reach the
    driver at most, whatever the size of the corpus.
    """
    counted = docs.select(F.col(text)).mapInArrow(_count_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros(CLASSES**3)
    for row in counted.collect():  # at most 64^3 sums
        n[row.code] = row.n
    return costs(n)


def costs(counts: np.ndarray, strength: float = 8.0) -> np.ndarray:
    """Trigrams backed off to pairs and single classes."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + strength * p1) / (two.sum(axis=1, keepdims=True) + strength)
    p3 = (three + strength * p2[None]) / (three.sum(axis=2, keepdims=True) + strength)
    return -np.log(p3).astype(np.float32).ravel()


# ── channel and decoder ──────────────────────────────────────────────────────

#: The letters that a sign stands for in leetspeak.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (nats) of what the channel does, besides nothing.
SWAP, RUN, PAIR, DROP_LONE, DROP, BREAK, BREAK_INSIDE, BREAK_EDGE = 1.5, 1.0, 3.0, 0.5, 5.0, 1.0, 4.0, 0.5

_SIGNS = re.escape("".join(LOOK_ALIKES))
_MIXED = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_PARTED = re.compile(rf"(?<![^\W_])(?:[^\W\d_]|[{_SIGNS}])(?:[.\-_*~,/]+(?:[^\W\d_]|[{_SIGNS}])){{2,}}(?![^\W_])")
_WORDS = re.compile(r"[^\W\d_]+")


def _code(char: str) -> int:
    point = ord(char)
    return int(_CLASS[point]) if point < _KNOWN else OTHER


class Decoder:
    """Readings of suspicious spans under a language model."""

    def __init__(self, model: np.ndarray):
        self.costs = model.tolist()
        self.cache: dict[str, tuple[str, ...]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        """Lower-cased words of a text's token, restored where it is suspicious."""
        found = self.cache.get(token)
        if found is None:
            if len(self.cache) >= CACHE_TOKENS:
                self.cache.clear()
            found = self.cache[token] = self._read(token)
        return found

    def _read(self, token: str) -> tuple[str, ...]:
        core = token.rstrip("!?.,;:'\")]}").lstrip("?.,;:'\"([{")
        if _TRIPLE.search(core) or (not core.isalpha() and (_MIXED.search(core) or _PARTED.search(core))):
            return self.decode(core)
        return tuple(_WORDS.findall(core.lower()))

    def decode(self, span: str) -> tuple[str, ...]:
        """Words of the cheapest reading."""
        s = span.lower()
        n = len(s)
        letters = [i for i, c in enumerate(s) if c.isalpha()]
        inside = (letters[0], letters[-1]) if letters else (n, -1)
        cost = self.costs
        # hypotheses at every place: (last two classes) -> (cost, (earlier, letters))
        at: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(n + 1)]
        at[0][0] = (0.0, ())

        def offer(place: int, state: int, total: float, path: tuple) -> None:
            here = at[place]
            if state not in here or total < here[state][0]:
                here[state] = (total, path)

        for i in range(n):
            c = s[i]
            end = i + 1
            while end < n and s[end] == c:
                end += 1
            run = end - i
            alone = (i == 0 or not s[i - 1].isalnum()) or (end == n or not s[end].isalnum())
            steps: list[tuple[int, str, float]] = []  # next place, letters, channel cost
            if c.isalpha():
                steps.append((i + 1, c, 0.0))
                if run >= 2:
                    steps.append((end, c, RUN if run > 2 else PAIR))
                if run >= 3:
                    steps.append((end, c + c, RUN))
            else:
                edge = i < inside[0] or i > inside[1]
                for x in LOOK_ALIKES.get(c, ""):
                    steps.append((i + 1, x, SWAP))
                    if run >= 2:
                        steps.append((end, x, SWAP + RUN))
                if c.isalnum() or c in LOOK_ALIKES:
                    steps.append((end, " ", BREAK_EDGE if edge else BREAK_INSIDE))
                else:
                    lone = i > 0 and (i < 2 or not s[i - 2].isalnum()) and (end + 1 >= n or not s[end + 1].isalnum()) and alone
                    steps.append((end, "", DROP_LONE if lone else DROP))
                    steps.append((end, " ", BREAK_EDGE if edge else BREAK))
            for state, (total, path) in at[i].items():
                for place, text, channel in steps:
                    if text == " ":
                        if state & 63:
                            offer(place, (state & 63) << 6, total + channel + cost[state << 6], (path, text))
                        else:
                            offer(place, state, total + channel, path)
                        continue
                    now, sum_ = state, total + channel
                    for x in text:
                        k = _code(x)
                        sum_ += cost[now << 6 | k]
                        now = (now << 6 | k) & 4095
                    offer(place, now, sum_, (path, text) if text else path)
        best = min(((total + (cost[state << 6] if state & 63 else 0.0), path) for state, (total, path) in at[n].items()), key=lambda x: x[0])[1]
        out: list[str] = []
        while best:
            best, text = best
            out.append(text)
        return tuple("".join(reversed(out)).split())

    def spans(self, text: str) -> tuple[list[str], list[str]]:
        """Tokens of a text, and its runs of three or more single characters as spans of their own."""
        tokens = text.split()
        single = [i for i, t in enumerate(tokens) if len(t) == 1]
        if len(single) < 3:
            return tokens, []
        runs, begin = [], 0
        for j in range(1, len(single) + 1):
            if j == len(single) or single[j] != single[j - 1] + 1:
                if j - begin >= 3:
                    runs.append((single[begin], single[j - 1] + 1))
                begin = j
        out = [" ".join(tokens[a:b]) for a, b in runs]
        for a, b in reversed(runs):
            del tokens[a:b]
        return tokens, out

    def restore(self, text: str) -> str:
        """The text with what suspicious spans mean in their place; other tokens stay as they are."""
        tokens = text.split()
        out: list[str] = []
        i = 0
        while i < len(tokens):
            j = i
            while j < len(tokens) and len(tokens[j]) == 1:
                j += 1
            if j - i >= 3:
                out.extend(self.decode(" ".join(tokens[i:j])))
                i = j
                continue
            t = tokens[i]
            plain = _WORDS.findall(t.lower())
            read = self.words(t)
            out.append(t if list(read) == plain else " ".join(read))
            i += 1
        return " ".join(out)


@lru_cache(maxsize=2)
def _decoder(model: bytes) -> Decoder:
    return Decoder(np.frombuffer(model, np.float32))


def restore(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """All columns with ``restored``; null stays null, a column of that name is replaced."""
    others = [c for c in docs.columns if c != "restored"]
    packed = docs.select(F.struct(*others).alias("key"), F.col(text).alias("text"))
    raw = model.astype(np.float32).tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(raw)
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                done = [None if t is None else decoder.restore(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], ["key", "restored"])

    got = packed.mapInArrow(run, f"key {packed.schema['key'].dataType.simpleString()}, restored string")
    return got.select(*[F.col("key")[c].alias(c) for c in others], "restored")


# ── features and scores ──────────────────────────────────────────────────────


def word_codes(word: str) -> list[int]:
    """A word and its beginnings as 32-bit numbers."""
    raw = word.encode()
    out = [zlib.crc32(raw)]
    out += [zlib.crc32(word[:k].encode(), 1) for k in PREFIXES if len(word) >= k]
    return out


class _Features:
    """Counts of the wanted features (all of them without a wish) of whole texts."""

    def __init__(self, decoder: Decoder, wanted: frozenset[int] | None):
        self.decoder, self.wanted = decoder, wanted
        self.cache: dict[str, tuple[int, ...]] = {}

    def of_words(self, words: Iterable[str]) -> tuple[int, ...]:
        codes = [c for w in words for c in word_codes(w)]
        return tuple(codes if self.wanted is None else [c for c in codes if c in self.wanted])

    def of(self, text: str) -> dict[int, int]:
        """How often each feature occurs."""
        tokens, spans = self.decoder.spans(text)
        out: dict[int, int] = {}
        cache = self.cache
        for token, n in Counter(tokens).items():
            codes = cache.get(token)
            if codes is None:
                if len(cache) >= CACHE_TOKENS:
                    cache.clear()
                codes = cache[token] = self.of_words(self.decoder.words(token))
            for c in codes:
                out[c] = out.get(c, 0) + n
        for span in spans:
            for c in self.of_words(self.decoder.decode(span)):
                out[c] = out.get(c, 0) + 1
        return out


def _levels(counts: dict[int, int]) -> list[int]:
    """A feature that occurs, and one more for two times or more."""
    return [2 * c for c in counts] + [2 * c + 1 for c, n in counts.items() if n > 1]


@dataclass(frozen=True)
class Scorer:
    """Language model and weights of the selected features."""

    model: bytes
    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: list[list[int]]) -> np.ndarray:
        """Scores of rows of places in ``codes``."""
        total = np.array([self.weights[f].sum() if f else 0.0 for f in features], np.float64)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def _logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, width: int, ridge: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the weighted log loss with a ridge."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = np.bincount(at, weights=weight[owner], minlength=width) / 4 + ridge
    w, b, ahead_w, ahead_b = np.zeros(width), 0.0, np.zeros(width), 0.0
    # a step per coordinate, divided by the features that a row has at most
    most = max(1.0, float(np.mean([len(r) for r in rows])) if rows else 1.0)
    for k in range(rounds):
        z = np.bincount(owner, weights=ahead_w[at], minlength=len(rows)) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        next_w = ahead_w - (np.bincount(at, weights=error[owner], minlength=width) + ridge * ahead_w) / (scale * most)
        next_b = ahead_b - float(error.sum()) / (weight.sum() / 4 * most)
        pace = k / (k + 3)
        ahead_w, ahead_b = next_w + pace * (next_w - w), next_b + pace * (next_b - b)
        w, b = next_w, next_b
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "label", limit: int = MAX_LABELLED, selected: int = SELECTED
) -> Scorer:
    """A scorer of the language model of all of ``docs`` and of at most ``limit`` labelled ones.

    Of each label a share of a hash range is taken, label 1 up to a third of
    ``limit``, and weighted back to its part of all labelled rows.  Null ids
    and labels are no examples; of conflicting labels of an id the larger
    counts; repeated rows of an id count once.  Without examples of both labels
    every score is the share of label 1, one half without any.
    """
    model = language_model(docs, text).astype(np.float32).tobytes()
    marked = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marked = stage(marked.groupBy("id").agg(F.max("label").alias("label")))
    sizes = {r.label: r.n for r in marked.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        share = 0.5 if not ones + zeros else float(bool(ones))
        return Scorer(model, np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    quota = {1: limit // 3, 0: limit - limit // 3}
    # a little under the quota is aimed at, so that its bound cuts nothing off
    tops = {k: 1.0 if n <= quota[k] else 0.9 * quota[k] / n for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, tops[1]).otherwise(tops[0])
    chosen = marked.where(F.col("label").isin(0, 1) & (draw < share)).limit(limit)
    # at most ``limit`` narrow rows go to every task
    known = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("id"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(_decoder(model), None)
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                rows = [np.array(_levels(features.of(t or "")), np.int64) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.list_(pa.int64()))], ["id", "label", "features"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = known.select("id", "label", "t").mapInArrow(read, f"id {kind}, label int, features array<long>")
    rows = stage(rows.groupBy("id", "label").agg(F.min("features").alias("features")))
    # the features that tell the labels apart best, by the likelihood ratio of their document counts
    one = F.col("label") == 1
    counts = rows.agg(F.count_if(one).alias("a"), F.count_if(~one).alias("b")).first()
    per = rows.select("label", F.explode("features").alias("code")).groupBy("code").agg(F.count_if(one).alias("x"), F.count_if(~one).alias("y"))
    x, y, a, b = F.col("x"), F.col("y"), F.lit(float(counts.a)), F.lit(float(counts.b))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rate = (x + y) / (a + b)
    ratio = part(x, a * rate) + part(y, b * rate) + part(a - x, a * (1 - rate)) + part(b - y, b * (1 - rate))
    top = per.where((x + y) >= 3).select("code", ratio.alias("ratio")).where("ratio > 6").orderBy(F.desc("ratio"), "code").limit(selected).collect()
    codes = np.sort(np.array([r.code for r in top], np.int64))
    wanted = F.array_intersect("features", F.lit(codes.tolist()).cast("array<bigint>"))
    found = rows.select("id", "label", wanted.alias("features")).limit(limit).collect()  # at most ``limit`` rows of ``selected`` numbers
    found.sort(key=lambda r: (r.id, r.label))
    places = [np.searchsorted(codes, np.sort(np.array(r.features, np.int64))) for r in found]
    truth = np.array([r.label for r in found], np.float64)
    drawn = {1: max(1.0, truth.sum()), 0: max(1.0, (1 - truth).sum())}
    total = len(found) / (ones + zeros)
    weight = np.where(truth == 1, ones / drawn[1], zeros / drawn[0]) * total
    w, bias = _logistic(places, truth, weight, len(codes))
    return Scorer(model, codes, w, bias)


def _score(scorer: Scorer):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(c): i for i, c in enumerate(scorer.codes)}
        features = _Features(_decoder(scorer.model), frozenset(c >> 1 for c in place))
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE):
                part = batch.slice(s, SLICE)
                found = [[place[c] for c in _levels(features.of(t)) if c in place] if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(found), pa.float64())], ["key", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns but the text with ``score`` and ``predicted``.

    Whole texts of any length are restored and scored; null and empty ones get
    the score of a text without any selected feature.  Repeated rows are scored
    alike; columns named like the results are replaced; an empty table gives none.
    """
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    key = F.struct(*others) if others else F.struct(F.lit(0).alias("_none"))
    packed = docs.select(key.alias("key"), F.col(text).alias("text"))
    got = packed.mapInArrow(_score(scorer), f"key {packed.schema['key'].dataType.simpleString()}, score double")
    return got.select(*[F.col("key")[c].alias(c) for c in others], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc: Column) -> Column:
    """The rows whose labels are for testing only."""
    return F.crc32(doc.cast("string")) % 3 == 1
