"""Quality scores by supervised subword embeddings.

A document is the mean of learned vectors of its features: words, pairs of neighbouring words and
the 3 to 5 byte pieces of words, all hashed into ``BUCKETS`` rows. A softmax layer over the mean gives
the probability of label 1. Vectors and layer are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import few_rows, id_and_text
from priceforge.llm.rolling import Prefixes, mixed, pieces
from priceforge.session import materialize

#: Rows of the embedding table, 2 to the power of BITS.
BITS = 17
DIMENSIONS = 8
#: Labelled rows that the classifier is fitted on, at most; the rows with the smallest hash of their id.
SAMPLE_ROWS = 4000
EPOCHS = 8
RATE = 4.0
THRESHOLD = 0.7
#: Bytes of text that are hashed at a time.
_CHUNK = 1 << 19
_SPACES = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
_PIECES = (3, 4, 5)
_SAME = 1
_FACTORS = {3: 0x9E3779B97F4A7C15, 4: 0xC2B2AE3D27D4EB4F, 5: 0x165667B19E3779F9}


def hashed_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: bucket of every feature, and where each document's own begin and end."""
    buffer = np.frombuffer(b" " + b" ".join(texts).translate(_SPACES) + b"    ", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = begins + lengths + 1
    n = len(buffer) - 4
    space = buffer == 32
    spaces = np.cumsum(space, dtype=np.int64)
    shift = np.uint64(64 - BITS)
    wide = buffer.astype(np.uint64)
    code = wide[:n] | wide[1 : n + 1] << np.uint64(8)
    for size in _PIECES:
        code = code | wide[size - 1 : n + size - 1] << np.uint64(8 * (size - 1))
        at = np.flatnonzero(spaces[size - 2 : n + size - 2] == spaces[:n])
        # A piece may begin or end with the space beside its word, but it lies within one word.
        buckets = (code[at] * np.uint64(_FACTORS[size])) >> shift
        yield buckets.astype(np.int64), np.searchsorted(at, begins), np.searchsorted(at, ends)
    inside = ~space[: n + 1]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    words = Prefixes(buffer).of(first, last)
    from_, to = np.searchsorted(first, begins), np.searchsorted(first, ends)
    yield (words >> shift).astype(np.int64), from_, to
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:]) >> shift
    yield pairs.astype(np.int64), from_, np.maximum(to - 1, from_)
    # One more feature for a word that is followed by itself, whatever the word.
    same = np.flatnonzero(words[:-1] == words[1:])
    yield np.full(len(same), _SAME), np.searchsorted(same, from_), np.searchsorted(same, np.maximum(to - 1, from_))


def _totals(texts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its features' values, and their number."""
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, begins, ends in hashed_features(texts):
        running = np.concatenate([[0.0], np.cumsum(values[buckets], dtype=np.float64)])
        sums += running[ends] - running[begins]
        counts += ends - begins
    return sums, counts


class Scorer:
    """A trained classifier, reduced to what a score needs: one number for each bucket and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in pieces(map(len, texts), _CHUNK):
            sums, counts = _totals(texts[a:b], self.weights)
            margin = sums / np.maximum(counts, 1) + self.bias
            out[a:b] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return out


class _Example:
    """The buckets of a document and how often it has each, in as few bytes as they take."""

    __slots__ = ("low", "upper", "counts", "total")

    def __init__(self, buckets: np.ndarray):
        rows, counts = np.unique(buckets, return_counts=True)
        self.low = rows.astype(np.uint16)
        # Buckets are sorted: where each further 65,536 of them begin.
        self.upper = np.searchsorted(rows, np.arange(1, 1 << max(0, BITS - 16)) << 16).tolist()
        self.counts = counts.astype(np.min_scalar_type(int(counts.max()))) if len(counts) else counts.astype(np.uint8)
        self.total = max(1, len(buckets))

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.low.astype(np.int32)
        for at in self.upper:
            rows[at:] += 1 << 16
        return rows, (self.counts.astype(np.int64) / self.total).astype(np.float32)


def train(texts: list[bytes], labels: list[int], seed: int = 42) -> Scorer:
    """Fit by stochastic gradient descent, one document at a time with a falling rate.

    Without both labels there is nothing to tell apart: every score is then the share of label 1,
    or 0.5 without any label.
    """
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return Scorer(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    examples: list[_Example] = []
    # On the driver, so with little at a time.
    for a, b in pieces(map(len, texts), _CHUNK // 8):
        kinds = list(hashed_features(texts[a:b]))
        examples += [_Example(np.concatenate([k[f[d] : t[d]] for k, f, t in kinds])) for d in range(b - a)]
        del kinds
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            rows, weights = examples[d].weighted()
            mean = weights @ vectors[rows]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = layer.T @ p
            layer -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            vectors[rows] -= (rate * weights)[:, None] * back
    return Scorer((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Train on at most ``sample_rows`` labelled documents outside the held-out fold.

    A document with two different labels, a null label or a null id is not used.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .where(F.col("quality") == F.col("_other"))
        .select("doc_id", "quality")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # At most sample_rows pairs of numbers.
    rows = (
        id_and_text(docs)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("text").cast("binary").alias("text"), "quality")
        .collect()
    )
    found = sorted({r.doc_id: (bytes(r.text), r.quality) for r in rows}.items())
    del rows
    return train([text for _, (text, _) in found], [quality for _, (_, quality) in found])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of a score. Null and empty texts have no feature, their score is that
    of the bias. Repeated rows give repeated rows, an empty table an empty result.
    """
    scorer = fit_quality(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights.astype(np.float32), scorer.bias))

    def score(batches):
        weights, bias = shared.value
        own = Scorer(weights, bias)
        for batch in few_rows(batches):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.scores(texts), pa.float64())], names=["doc_id", "score"]
            )

    rows = id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; rows without id stay."""
    rejected = materialize(
        quality_scores(docs, labels, threshold)
        .where("predicted = 0")
        .select(F.col("doc_id").alias("_rejected"))
        .distinct()
    )
    # Stored first, so that few ids are sent to the texts and no text is moved for them.
    return docs.join(rejected, F.col("`doc_id`").cast("long") == F.col("_rejected"), "left_anti")
