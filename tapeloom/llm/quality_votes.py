"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of words and word shapes.  A singular value
decomposition of the labelled texts' counts gives the latent space.  The
labelled vectors go to every task, at most ``MAX_LABELLED`` of them; each
document's cosine with every one of them is computed exactly, block by block,
and the labels of the ``NEIGHBOURS`` closest vote with the weight of their
similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.words import sampled
from tapeloom.runtime import stage

#: Bound of the labelled rows that are fitted and broadcast; about half as many are taken.
MAX_LABELLED = 8000
NEIGHBOURS, RANK, BLOCK = 15, 48, 512
WORD_DIMS, SHAPE_DIMS, EXTRA_DIMS = 1024, 256, 4
DIMS = WORD_DIMS + SHAPE_DIMS + EXTRA_DIMS
THRESHOLD = 0.7
CACHE_WORDS = 300_000


class _Codes(dict):
    """Word to its word and shape buckets in one number, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        shape = []
        for c in word:
            kind = "u" if c.isupper() else "l" if c.isalpha() else "d" if c.isdigit() else c
            if not shape or shape[-1] != kind:
                shape.append(kind)
        plain = word.lower().strip(".,;:!?\"'()")
        code = zlib.crc32(plain.encode()) % WORD_DIMS * SHAPE_DIMS + zlib.crc32("".join(shape).encode()) % SHAPE_DIMS
        if len(self) < CACHE_WORDS:
            self[word] = code
        return code


_codes = _Codes()


def features(text: str) -> np.ndarray:
    """Damped counts of a whole text; all zero without words."""
    out = np.zeros(DIMS, np.float32)
    words = text.split()
    if not words:
        return out
    codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    n = len(words)
    out[:WORD_DIMS] = np.sqrt(np.bincount(codes // SHAPE_DIMS, minlength=WORD_DIMS) / n)
    out[WORD_DIMS : WORD_DIMS + SHAPE_DIMS] = np.sqrt(np.bincount(codes % SHAPE_DIMS, minlength=SHAPE_DIMS) / n)
    repeated = float((codes[1:] == codes[:-1]).sum()) / n
    distinct = len(np.unique(codes)) / min(n, WORD_DIMS)
    out[-EXTRA_DIMS:] = (repeated, min(1.0, distinct), min(1.0, len(text) / n / 20), 0.3)
    return out


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = batch.slice(s, BLOCK)
            rows = [features(x or "").tobytes() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["label", "features"])


@dataclass(frozen=True)
class Votes:
    """Latent axes with the labelled vectors and their labels."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        x = rows @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)

    def scores(self, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Vote for label 1, between 0 and 1; the prior for rows without features."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        near = self.latent(rows) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, at, axis=1), 0, 1).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        vote = (weight * self.labels[at]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "label", limit: int = MAX_LABELLED) -> Votes:
    """Votes of at most ``limit`` labelled rows, about half as many, picked by a hash.

    Rows with a null id or label are no examples; an id that repeats is one
    example, with the larger label and, among several texts, the first by its
    features.  Without any example every score is one half.
    """
    marked = labels.select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("label"))
    marked = marked.where(F.col("_id").isNotNull() & F.col("label").isNotNull()).groupBy("_id").agg(F.max("label").alias("label"))
    chosen = sampled(stage(marked), limit // 2, 11)
    # at most ``limit`` narrow rows
    known = docs.select(F.col(doc).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_id"))
    key = known.select(F.struct("_id", "label").alias("label"), "_t")
    fields = key.schema["label"].dataType.simpleString()
    read = key.mapInArrow(_feature_rows, f"label {fields}, features binary")
    rows = read.groupBy("label._id", "label.label").agg(F.min("features").alias("features")).select("label", "features").collect()  # at most ``limit``
    if not rows:
        return Votes(np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    rows.sort(key=lambda r: (r.features, r.label))
    x = np.frombuffer(b"".join(r.features for r in rows), np.float32).reshape(-1, DIMS)
    y = np.array([r.label for r in rows], np.float64)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, : min(RANK, len(rows))].astype(np.float32)
    # damp the axes that all texts share
    strength = np.sqrt(np.maximum(values[::-1][: axes.shape[1]], 1e-9))
    axes = axes / np.sqrt(strength / strength.max()).astype(np.float32)
    votes = Votes(axes, np.zeros((0, axes.shape[1]), np.float32), y, float(y.mean()))
    return Votes(axes, votes.latent(x), y, float(y.mean()))


def _score(votes: Votes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                rows = np.stack([features(x or "") for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes.scores(rows), pa.float64())], ["key", "score"])

    return run


def score(docs: DataFrame, votes: Votes, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns but the text with ``score`` and ``predicted``.

    Null and empty texts get the labelled rows' mean.  Repeated rows are scored
    alike; columns named like the results are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    packed = docs.select(F.struct(*others).alias("key"), F.col(text).alias("text"))
    fields = packed.schema["key"].dataType.simpleString()
    got = packed.mapInArrow(_score(votes), f"key {fields}, score double")
    return got.select(*[F.col("key")[c].alias(c) for c in others], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc: Column) -> Column:
    """The rows whose labels are for testing only."""
    return F.crc32(doc.cast("string")) % 4 == 2
