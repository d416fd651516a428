"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Two 64-bit fingerprints that differ in at most ``t`` bits differ, for any cut of the bits into parts
with thresholds whose sum is ``t - parts + 1``, in at most its threshold of bits in some part. A part with
threshold -1 is not looked at. Correlated bits are put into one part, and thresholds are allocated by
dynamic programming over estimated numbers of probes and candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceforge.llm.components import connected_components
from priceforge.llm.corpus import few_rows, id_and_text
from priceforge.llm.rolling import pieces
from priceforge.operators.joins import lookup_join
from priceforge.session import materialize

BITS = 64
SEED = 42
#: From so many fingerprints in a bucket on, comparing all pairs costs more than listing neighbours.
LARGE = 2 * (BITS + 1)
#: A comparison of two fingerprints in units of one shuffled probe.
COMPARE = 0.05
_CHUNK = 1 << 19
#: For each byte the number whose k-th byte is the k-th bit of it.
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], dtype=np.uint64)


def simhashes(texts: list[bytes], words: int = 3) -> np.ndarray:
    out = np.zeros(len(texts), dtype=np.uint64)
    for a, b in pieces(map(len, texts), _CHUNK):
        out[a:b] = _simhashes(texts[a:b], words)
    return out


def _simhashes(texts: list[bytes], words: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for d, text in enumerate(texts):
        found = text.lower().split()
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            hashes.append(digest(joined, SEED))
            counts[d] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = [0, *(ends[:-words] + 1).tolist()]
        hashes += [digest(joined[x:y], SEED) for x, y in zip(starts, ends[words - 1 :].tolist())]
        counts[d] = len(starts)
    return majority(np.array(hashes, dtype=np.uint64), counts)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the number of bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), dtype=np.uint64)
    used = np.flatnonzero(counts)
    if not len(used):
        return out
    n = counts[used]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # Eight counters to a word, one byte each: runs are cut into blocks of 255.
    blocks = -(-n // 255)
    block = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    of_run = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    as_bytes = np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[as_bytes[:, k]], block).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), of_run, axis=0)
        packed = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")[:, 0]
        out[used] |= packed.astype(np.uint64) << np.uint64(8 * k)
    return out


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of documents of (doc_id, text); ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = simhashes(batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and how many have both bits of each pair, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, together = 0, np.zeros((BITS, BITS), dtype=np.int64)
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8)
            bits = np.unpackbits(values.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += (bits.T @ bits).astype(np.int64)
            total += len(bits)
        rows, columns = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *rows.ravel()], pa.int32()),
                pa.array([-1, *columns.ravel()], pa.int32()),
                pa.array([total, *together.ravel()], pa.int64()),
            ],
            names=["i", "j", "n"],
        )

    sums = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    total, together = 0, np.zeros((BITS, BITS))
    for i, j, n in sums.collect():  # 64 x 64 numbers and a count
        if i < 0:
            total = n
        else:
            together[i, j] = n
    return total, together


def correlated_parts(total: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` lists of nearly equal length, each grown by the bit most correlated with it."""
    share = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    strength = np.abs(together / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, out = set(range(BITS)), []
    for p in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - p)
        part = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (strength[b, part].sum(), -b)))
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts with the given sum and the least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for threshold, extra in cost.items():
                key = spent + threshold
                if key not in step or value + extra < step[key][0]:
                    step[key] = (value + extra, [*chosen, threshold])
        best = step
    return best.get(total, (float("inf"), []))


def plan(total: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds with the fewest estimated probes and comparisons.

    The chance that two fingerprints are within a threshold on a part is taken from the shares of
    its bits. A wrong estimate costs time, never a link.
    """
    share = np.diag(together) / max(total, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for parts in range(1, distance + 3):
        groups = correlated_parts(total, together, parts)
        costs = []
        for group in groups:
            chance = np.array([1.0])
            for b in group:
                chance = np.convolve(chance, [1 - differ[b], differ[b]])
            cost, near, ball = {-1: 0.0}, 0.0, 0
            for threshold in range(distance + 1):
                near += chance[threshold] if threshold < len(chance) else 0.0
                ball += len(list(combinations(group, threshold)))
                cost[threshold] = float(total) * (ball + 1) + COMPARE * total * total * near / 2
            costs.append(cost)
        value, thresholds = allocate(costs, distance - parts + 1)
        if value < best[0]:
            best = value, list(zip(groups, thresholds))
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _mask(bits: list[int] | tuple[int, ...]) -> Column:
    return F.lit(_signed(sum(1 << b for b in bits))).cast("long")


def _keys(distinct: DataFrame, chosen: list[tuple[list[int], int]], ball: bool) -> DataFrame:
    """(part, key, fp): the bits of each part, with ``ball`` also with as many changed as its threshold allows."""
    entries = []
    for i, (bits, threshold) in enumerate(chosen):
        if threshold < 0:
            continue
        key = F.col("fp").bitwiseAND(_mask(bits))
        changes = [c for k in range((threshold if ball else 0) + 1) for c in combinations(bits, k)]
        entries += [F.struct(F.lit(i).alias("part"), key.bitwiseXOR(_mask(c)).alias("key")) for c in changes]
    return distinct.select("fp", F.explode(F.array(*entries)).alias("_e")).select("_e.part", "_e.key", "fp")


def neighbour_links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits, without comparing pairs.

    Each fingerprint is listed under all numbers within half the distance, for an odd distance also,
    as an outer one, under those one bit further. Two under one number, not both outer, are
    within the distance, and any two within it stand so under a common number. Each is linked to the
    smallest that is not outer. What stands under a number, and the cost, is bounded by the ball.
    """
    half = distance // 2

    def masks(bits: int) -> list[int]:
        return [sum(1 << b for b in c) for c in combinations(range(BITS), bits)]

    inner = [m for k in range(half + 1) for m in masks(k)]
    outer = masks(half + 1) if distance % 2 else []
    changes = np.array([*inner, *outer], dtype=np.uint64)
    is_inner = np.arange(len(changes)) < len(inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CHUNK // 8 // len(changes))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(values), step):
                some = values[start : start + step]
                spots = (some[:, None] ^ changes[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(some, len(changes)).view(np.int64)),
                        pa.array(spots.view(np.int64)),
                        pa.array(np.tile(is_inner, len(some))),
                    ],
                    names=["fp", "spot", "inner"],
                )

    under = distinct.select("fp").mapInArrow(run, "fp long, spot long, inner boolean")
    groups = under.groupBy("spot").agg(
        F.collect_list("fp").alias("members"), F.min(F.when(F.col("inner"), F.col("fp"))).alias("a")
    )
    return (
        groups.where((F.size("members") > 1) & F.col("a").isNotNull())
        .select("a", F.explode("members").alias("b"))
        .where("a <> b")
        .distinct()
    )


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``distance`` bits."""
    total, together = bit_statistics(distinct)
    chosen = plan(total, together, distance)
    symmetric = all(threshold <= 0 for _, threshold in chosen)
    index = _keys(distinct, chosen, ball=False)
    least = 2 if symmetric else 1
    sizes = index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    sizes = materialize(sizes.select("part", "key", (F.col("n") > LARGE).alias("large")))
    kept = materialize(lookup_join(index, sizes, ["part", "key"], ["fp"], "inner"))
    if symmetric:
        probes = kept
    else:
        probes = materialize(lookup_join(_keys(distinct, chosen, ball=True), sizes, ["part", "key"], ["fp"], "inner"))
    x = probes.where("not large").select("part", "key", F.col("fp").alias("a"))
    y = kept.where("not large").select("part", "key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    ordered = F.col("a") < F.col("b") if symmetric else F.col("a") != F.col("b")
    small = (
        x.join(y, [x["part"] == y["part"], x["key"] == y["key"], ordered, near])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    crowded = probes.where("large").select("fp").distinct()
    if crowded.isEmpty():
        return small
    return small.unionByName(neighbour_links(crowded, distance)).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distance: int = 2,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    A-Z become lower case; the fingerprint is taken over all shingles of ``words`` words, repeats
    included, or the whole sequence of a shorter text. A null, empty or blank text has fingerprint
    zero and is linked like any other. Repeated rows give repeated rows, an empty table an empty
    result. ``component_id`` is the smallest id that links reach.

    Links join fingerprints that differ in at most ``distance`` bits.
    Links are sought between distinct fingerprints, so copies are never paired. Buckets of more
    than ``LARGE`` fingerprints are solved by listing neighbours, whose cost is linear.
    """
    rows = id_and_text(docs, id_col, text_col)
    marked = materialize(with_fingerprints(rows, words).withColumn("unit", F.col("fp")))
    distinct = materialize(marked.groupBy("unit").agg(F.min("doc_id").alias("smallest")))
    if distinct.isEmpty():
        return marked.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    near = links(distinct.select(F.col("unit").alias("fp"), "smallest"), distance)
    roots = connected_components(near)
    rooted = distinct.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select(
        "unit", "smallest", F.coalesce("root", "unit").alias("root")
    )
    reached = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    of_unit = materialize(rooted.join(reached, "root").select("unit", "component_id"))
    name = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of_unit, "unit").select("doc_id", name.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows without id stay."""
    gone = (
        near_duplicates(docs, words=words, distance=distance)
        .where("doc_id <> component_id")
        .select(F.col("doc_id").alias("_gone"))
        .distinct()
    )
    return docs.join(gone, F.col("`doc_id`").cast("long") == F.col("_gone"), "left_anti")
