"""Shards of nearly equal bytes by Karmarkar-Karp differencing over indivisible groups.

A partial partition is a vector of one sum per shard. Differencing takes the two partial
partitions with the largest spread and adds them in opposite order, the largest sum of one to
the smallest of the other, until one is left. Groups are dealt to chunks of bounded size; the
chunks' results are partial partitions again and are combined by the same rule, level by level.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import bucket_of, id_and_text, numbered
from priceforge.session import materialize

SHARDS = 16
#: Partial partitions that one task combines.
FAN = 2048


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """The sums of the combined partition and, for each vector, the place that each of its parts went to."""
    width = len(vectors[0])
    heap = []
    for i, vector in enumerate(vectors):
        order = sorted(range(width), key=lambda p: (-vector[p], p))
        sums = [vector[p] for p in order]
        heap.append((sums[-1] - sums[0], i, sums, [[(i, p)] for p in order]))
    heapq.heapify(heap)
    tick = len(vectors)
    while len(heap) > 1:
        _, _, a, parts_a = heapq.heappop(heap)
        _, _, b, parts_b = heapq.heappop(heap)
        joined = []
        for x, own, y, other in zip(a, parts_a, reversed(b), reversed(parts_b)):
            if len(own) < len(other):
                own, other = other, own
            own.extend(other)
            joined.append((x + y, own))
        joined.sort(key=lambda s: -s[0])
        sums = [s for s, _ in joined]
        heapq.heappush(heap, (sums[-1] - sums[0], tick, sums, [p for _, p in joined]))
        tick += 1
    _, _, sums, parts = heap[0]
    places = [[0] * width for _ in vectors]
    for place, members in enumerate(parts):
        for i, p in members:
            places[i][p] = place
    return sums, places


def _chunk_of_groups(shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["weight", "digest"], ascending=[False, True], kind="stable")
        _, places = difference([[int(w)] + [0] * (shards - 1) for w in frame["weight"]])
        return pd.DataFrame({"digest": frame["digest"], "chunk": frame["chunk"], "part": [p[0] for p in places]})

    return run


def _chunk_of_partitions(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("chunk")
    sums, places = difference([list(map(int, s)) for s in frame["sums"]])
    return pd.DataFrame(
        {"chunk": frame["chunk"], "parent": frame["parent"], "places": places, "parent_sums": [sums] * len(frame)}
    )


def differenced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1. Equal texts form a group and share a shard; a null
    text is an empty one. The law is ``bytes``: the sums of the shards are as near as whole groups
    allow, so a group above the mean makes a shard of its own. ``slot`` numbers the rows of a shard
    from 0. ``grown_shard`` is null, this law moves rows between all shards when one is added.
    Repeated rows of one id each get a slot; an empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = materialize(rows)
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("weight")))
    chunks = max(1, -(-groups.count() * 5 // (FAN * 4)))
    placed = materialize(
        groups.withColumn("chunk", bucket_of("digest", chunks))
        .groupBy("chunk")
        .applyInPandas(_chunk_of_groups(shards), "digest binary, chunk int, part int")
    )
    sums = (
        groups.join(placed, "digest")
        .groupBy("chunk")
        .agg(*[F.sum(F.when(F.col("part") == s, F.col("weight")).otherwise(0)).alias(f"_{s}") for s in range(shards)])
        .select("chunk", F.array(*[f"_{s}" for s in range(shards)]).alias("sums"))
    )
    levels = []
    while True:
        level = materialize(
            sums.withColumn("parent", (F.col("chunk") / FAN).cast("int"))
            .groupBy("parent")
            .applyInPandas(
                _chunk_of_partitions, "chunk int, parent int, places array<int>, parent_sums array<long>"
            )
        )
        levels.append(level)
        if chunks <= FAN:
            break
        chunks = -(-chunks // FAN)
        sums = level.groupBy("parent").agg(F.first("parent_sums").alias("sums")).withColumnRenamed("parent", "chunk")
    route = levels[-1].select("chunk", "places")
    for level in reversed(levels[:-1]):
        above = route.select(F.col("chunk").alias("parent"), F.col("places").alias("above"))
        route = level.join(above, "parent").select(
            "chunk", F.transform("places", lambda p: F.element_at("above", p + 1)).alias("places")
        )
    shard_of = placed.join(route, "chunk").select(
        "digest", F.element_at("places", F.col("part") + 1).alias("shard")
    )
    dealt = materialize(rows.join(shard_of, "digest").drop("digest"))
    return numbered(dealt, "shard", ["doc_id"], "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
