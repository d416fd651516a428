"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are ordered by label and by their place on a Hilbert curve through the widest dimensions,
cut into blocks of one label and stored as Parquet. Each block has a zone map, the smallest and the
largest value of every dimension. For an anchor, interval arithmetic over a zone map bounds every inner
product with the rows of the block: ``sum of max(a*low, a*high)`` from above, of the minima from below. A block is
read for an anchor only if these bounds meet one of the anchor's windows of scores.

All arithmetic is on integers; sums are kept in a type that holds them exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.llm.corpus import shuffle_width
from priceforge.operators.joins import first_by
from priceforge.session import materialize

POSITIVES, NEGATIVES = 5, 3
EVERY = 50
#: Rows of a file of blocks and of a block, anchors of a chunk, files that one task searches at most.
FILE_ROWS, BLOCK_ROWS, CHUNK_ANCHORS, SLAB_FILES = 8192, 512, 4096, 16
#: The Hilbert curve runs through so many dimensions with so many bits each.
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

_BLOCKS = (
    "file int, block long, label long, low binary, high binary, ids binary, vectors binary, seeds binary"
)
_ANCHORS = "file int, label long, anchor_id long, vector binary, seed long"
_FOUND = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points on a Hilbert curve; ``cells`` has a row for each point.

    The transposed form of the index is built by undoing the curve's reflections and rotations from
    the highest bit down, a Gray code follows, and the bits of the dimensions are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swapped = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swapped)
            x[i] ^= swapped
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= carry
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def exact_type(width: int, a: np.ndarray, b: np.ndarray) -> np.dtype:
    """The fastest type in which every inner product of a row of ``a`` and one of ``b`` is exact."""
    most = lambda m: int(np.abs(m).max()) if m.size else 0
    bound = max(1, width) * most(a) * most(b)
    if bound >= 1 << 62:
        raise OverflowError("an inner product does not fit a long")
    return np.dtype(np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; what a short vector lacks is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(values) and (values.max() >= 1 << 31 or values.min() < -(1 << 31)):
        raise OverflowError("a component is beyond 2**23")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int32)
    if len(values) == out.size:
        out[:] = values.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def mining_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, vector: the rows that take part, with their final label and integer components."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), x.alias("vector")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    moved = usable.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("vector", lambda v: F.floor(v * 256)).alias("vector"),
    )
    return first_by(moved, ["vec_id"], ["label", "vector"])


def _dimension_stats(batches):
    total: list[np.ndarray] | None = None
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        if not len(sizes):
            continue
        m = _matrix(batch.column(0), int(sizes.max())).astype(np.float64)
        own = [m.min(0), m.max(0), m.sum(0), (m * m).sum(0)]
        if total is None:
            total = own
            continue
        width = max(len(total[0]), len(own[0]))
        total, own = ([np.pad(v, (0, width - len(v))) for v in part] for part in (total, own))
        total = [np.minimum(total[0], own[0]), np.maximum(total[1], own[1]), total[2] + own[2], total[3] + own[3]]
    if total is not None:
        columns = [pa.array(np.arange(len(total[0])), pa.int32()), *map(pa.array, total)]
        yield pa.RecordBatch.from_arrays(columns, names=["dimension", "low", "high", "total", "squares"])


def candidate_blocks(rows: DataFrame, width: int, curve: list[tuple[int, float, float]], files: int, positives: int) -> DataFrame:
    """The blocks of ``rows``, each with its zone map, in files ordered by label and Hilbert place.

    ``curve`` has (dimension, low, high) of the dimensions that the curve runs through. ``seeds`` has for
    each anchor in a block the score of its ``positives``-th best row of the same label in the same file,
    a lower bound of that score over all files.
    """

    def place(batches):
        for batch in batches:
            m = _matrix(batch.column(2), width)
            cells = np.zeros((len(m), max(1, len(curve))), dtype=np.int64)
            for i, (d, low, high) in enumerate(curve):
                cells[:, i] = (m[:, d] - low) * ((1 << CURVE_BITS) / (high - low + 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], names=["vec_id", "label", "vector", "place"]
            )

    def pack(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        file = TaskContext.get().partitionId()
        ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in (0, 1))
        m = _matrix(table.column(2), width)
        kind = exact_type(width, m, m)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
        out, block = [], 0
        for a, b in zip(edges[:-1], edges[1:]):
            own = m[a:b].astype(kind)
            for s in range(a, b, BLOCK_ROWS):
                e = min(s + BLOCK_ROWS, b)
                at = np.flatnonzero(ids[s:e] % EVERY == 0)
                seeds = np.full(len(at), _LEAST)
                if b - a > positives and len(at):
                    scores = m[s + at].astype(kind) @ own.T
                    scores[np.arange(len(at)), s + at - a] = scores.min()
                    seeds = np.partition(scores, b - a - positives, axis=1)[:, b - a - positives].astype(np.int64)
                out.append(
                    (file, (file << 32) + block, int(labels[a]), m[s:e].min(0).tobytes(), m[s:e].max(0).tobytes(),
                     ids[s:e].tobytes(), m[s:e].tobytes(), seeds.astype(np.int64).tobytes())
                )
                block += 1
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    order = ["label", "place", "vec_id"]
    return materialize(
        rows.select("vec_id", "label", "vector")
        .mapInArrow(place, "vec_id long, label long, vector array<long>, place long")
        .repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .select("vec_id", "label", "vector")
        .mapInArrow(pack, _BLOCKS)
    )


def _anchors_of(width: int) -> Callable:
    def run(batches):
        for batch in batches:
            files, labels, ids, vectors, seeds = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for f, label, i, v, s in zip(files, labels, ids, vectors, seeds):
                i = np.frombuffer(i, np.int64)
                m = np.frombuffer(v, np.int32).reshape(len(i), width)
                at = np.flatnonzero(i % EVERY == 0)
                out += [(f, label, int(i[k]), m[k].tobytes(), int(x)) for k, x in zip(at, np.frombuffer(s, np.int64))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            names = [c.split()[0] for c in _ANCHORS.split(", ")]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int32).reshape(len(column), width)


class _Windows:
    """Anchors with their windows of scores as matrices; a window that an anchor lacks is empty."""

    def __init__(self, frame: pd.DataFrame, width: int):
        self.ids = frame["anchor_id"].to_numpy()
        self.labels = frame["label"].to_numpy()
        self.vectors = _stacked(frame["vector"], width)
        sizes = frame["lows"].map(len).to_numpy()
        shape = (len(frame), int(sizes.max()))
        self.lows, self.highs = np.full(shape, _MOST), np.full(shape, _LEAST)
        for out, name in ((self.lows, "lows"), (self.highs, "highs")):
            out[np.arange(shape[1]) < sizes[:, None]] = np.concatenate(frame[name].to_list())

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest inner product that each anchor (row) can have in each block (column)."""
        kind = exact_type(self.vectors.shape[1], self.vectors, np.stack([low, high]))
        up, down = np.maximum(self.vectors, 0).astype(kind), np.minimum(self.vectors, 0).astype(kind)
        low, high = low.astype(kind), high.astype(kind)
        return (up @ low.T + down @ high.T).astype(np.int64), (up @ high.T + down @ low.T).astype(np.int64)

    def allowed(self, labels: np.ndarray, same: bool) -> np.ndarray:
        return (self.labels[:, None] == labels[None, :]) == same


def _chosen(width: int, same: bool) -> Callable:
    """(block, chunk) of the blocks that a chunk's anchors have to read in a slab."""

    def run(key, zones: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if zones.empty or anchors.empty:
            return pd.DataFrame({"block": [], "chunk": []}, dtype="int64")
        w = _Windows(anchors, width)
        least, most = w.bounds(_stacked(zones["low"], width), _stacked(zones["high"], width))
        meets = np.zeros(least.shape, dtype=bool)
        for k in range(w.lows.shape[1]):
            meets |= (most >= w.lows[:, k, None]) & (least <= w.highs[:, k, None])
        meets &= w.allowed(zones["label"].to_numpy(), same)
        block = zones["block"].to_numpy()[meets.any(axis=0)]
        return pd.DataFrame({"block": block, "chunk": np.full(len(block), key[1])})

    return run


def best_in_windows(w: _Windows, blocks: pd.DataFrame, width: int, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the first ``k`` rows in each window of each anchor; the score is the least long where none is.

    Blocks come by their upper bound. One is left out for an anchor if its bounds meet no window
    above what the anchor has found there already.
    """
    low, high = _stacked(blocks["low"], width), _stacked(blocks["high"], width)
    least, most = w.bounds(low, high)
    labels = blocks["label"].to_numpy()
    allowed = w.allowed(labels, same)
    windows = w.lows.shape[1]
    scores = np.full((len(w.ids), windows, k), _LEAST)
    ids = np.full((len(w.ids), windows, k), _MOST)
    for b in np.argsort(-np.where(allowed, most, _LEAST).max(axis=0), kind="stable"):
        floor = np.maximum(scores[:, :, -1], w.lows)
        rows = np.flatnonzero(
            allowed[:, b] & ((most[:, b, None] >= floor) & (least[:, b, None] <= w.highs)).any(axis=1)
        )
        if not len(rows):
            continue
        own = np.frombuffer(blocks["ids"].iat[b], np.int64)
        m = np.frombuffer(blocks["vectors"].iat[b], np.int32).reshape(len(own), width)
        a = w.vectors[rows]
        kind = exact_type(width, a, m)
        found = a.astype(kind) @ m.astype(kind).T
        for i in range(windows):
            # A floor or ceiling outside what the scores can be stays outside after the cast.
            near = (found >= np.clip(floor[rows, i], -(1 << 62), 1 << 62).astype(kind)[:, None]) & (
                found <= np.clip(w.highs[rows, i], -(1 << 62), 1 << 62).astype(kind)[:, None]
            )
            r, c = np.nonzero(near)
            keep = own[c] != w.ids[rows[r]]
            r, c = r[keep], c[keep]
            if not len(r):
                continue
            touched, at = np.unique(rows[r], return_inverse=True)
            who = np.concatenate([at, np.repeat(np.arange(len(touched)), k)])
            score = np.concatenate([found[r, c].astype(np.int64), scores[touched, i].ravel()])
            which = np.concatenate([own[c], ids[touched, i].ravel()])
            order = np.lexsort((which, -np.maximum(score, -_MOST), who))
            first = np.searchsorted(who[order], np.arange(len(touched)))
            top = order[first[:, None] + np.arange(k)]
            scores[touched, i], ids[touched, i] = score[top], which[top]
    return scores, ids


def _searched(width: int, same: bool, k: int) -> Callable:
    def run(key, blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        if blocks.empty or anchors.empty:
            return pd.DataFrame({n: [] for n in names}, dtype="int64")
        w = _Windows(anchors, width)
        scores, ids = best_in_windows(w, blocks, width, same, k)
        a, i, j = np.nonzero(scores > _LEAST)
        tags = np.zeros((*w.lows.shape, 2), dtype=np.int64)
        if "positive_ids" in anchors:
            there = np.arange(w.lows.shape[1]) < anchors["lows"].map(len).to_numpy()[:, None]
            for t, name in enumerate(("positive_ids", "positive_scores")):
                tags[there, t] = np.concatenate(anchors[name].to_list())
        columns = [w.ids[a], tags[a, i, 0], tags[a, i, 1], ids[a, i, j], scores[a, i, j]]
        return pd.DataFrame(dict(zip(names, columns)))

    return run


def _search(blocks: DataFrame, anchors: DataFrame, width: int, slabs: int, chunks: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of every window within each slab; zone maps choose the blocks that are read."""
    tasks = max(1, min(slabs * chunks, 16 * shuffle_width(blocks.sparkSession)))
    every_chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
    every_slab = F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab")
    keys = ["slab", "chunk"]

    def dealt(df: DataFrame):
        return df.repartition(tasks, *keys).groupBy(*keys)

    asked = dealt(anchors.select("*", every_slab))
    zones = blocks.select("slab", "block", "label", "low", "high", every_chunk)
    needed = dealt(zones).cogroup(asked).applyInPandas(_chosen(width, same), "block long, chunk long")
    read = blocks.select("slab", "block", "label", "low", "high", "ids", "vectors").join(needed, "block")
    return dealt(read).cogroup(asked).applyInPandas(_searched(width, same, k), _FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``EVERY``. Rows without id, label or vector, or with a
    null or non-finite component, take no part. Of several rows with one id the first by label and vector
    counts. A vector shorter than the longest is filled up with zeros. Equal scores go by the smaller id.
    An anchor without another row of its label, and a positive of negative score, give no row; an empty table
    gives an empty result. A component beyond 2**23, or an inner product that does not fit a long, is an
    error. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = materialize(mining_rows(vectors, id_col, vector_col, label_col))
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    sizes = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % EVERY == 0).alias("anchors"), F.max(F.size("vector")).alias("width")
    ).first()
    if not sizes["anchors"]:
        return spark.createDataFrame([], result)
    n, width = sizes["n"], max(1, sizes["width"])
    # One row for each dimension.
    stats = (
        rows.select("vector")
        .mapInArrow(_dimension_stats, "dimension int, low double, high double, total double, squares double")
        .groupBy("dimension")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("t"), F.sum("squares").alias("s"))
        .collect()
    )
    widest = sorted(stats, key=lambda d: (d["t"] ** 2 / n - d["s"], d["dimension"]))[:CURVE_DIMENSIONS]
    files = -(-n // FILE_ROWS)
    stored = candidate_blocks(rows, width, [(d["dimension"], d["low"], d["high"]) for d in widest], files, positives)
    files = stored.agg(F.max("file")).first()[0] + 1
    per_slab = min(SLAB_FILES, max(1, files // shuffle_width(spark)))
    slabs = -(-files // per_slab)
    blocks = stored.withColumn("slab", F.floor(F.col("file") / per_slab).cast("int"))
    files_a_chunk = max(1, CHUNK_ANCHORS * files // sizes["anchors"])
    chunks = -(-files // files_a_chunk)
    anchors = materialize(
        stored.select("file", "label", "ids", "vectors", "seeds")
        .mapInArrow(_anchors_of(width), _ANCHORS)
        .withColumn("chunk", F.floor(F.col("file") / files_a_chunk).cast("long"))
        .drop("file")
    )
    asked = anchors.select(
        "chunk", "anchor_id", "label", "vector", F.array("seed").alias("lows"), F.array(F.lit(_MOST)).alias("highs")
    )
    best = materialize(
        _ranked(_search(blocks, asked, width, slabs, chunks, True, positives), ["anchor_id"], positives)
        .where("score >= 0")
        .select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    pairs = F.sort_array(F.collect_list(F.struct("positive_id", "positive_score")))
    windows = best.groupBy("anchor_id").agg(pairs.alias("p"))
    asked = anchors.join(windows, "anchor_id").select(
        "chunk", "anchor_id", "label", "vector",
        F.expr("transform(p, x -> (x.positive_score + 1) div 2)").alias("lows"),
        # 95 s / 100 rounded down, without a product that may leave the range of a long.
        F.expr("transform(p, x -> x.positive_score div 100 * 95 + x.positive_score % 100 * 95 div 100)").alias("highs"),
        F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"),
    )
    found = _ranked(_search(blocks, materialize(asked), width, slabs, chunks, False, negatives), ["anchor_id", "positive_id"], negatives)
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
