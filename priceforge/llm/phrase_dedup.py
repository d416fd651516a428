"""Removal of word sequences that recur anywhere, by sharded Aho-Corasick automata.

``repeats`` confirms the recurring passages. They become patterns over 32-bit word ids, dealt over shards
of bounded size, and every stretch of every document that can hold a recurring window streams through
the automaton of its shard, which reports all occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priceforge.llm.corpus import shuffle_width
from priceforge.llm.repeats import Recurring, Units, keyed, listed, merged, ranges, recurring, spans, word_units
from priceforge.llm.rolling import pieces
from priceforge.session import discard, materialize

WINDOW = 35
#: Patterns in one automaton, about, and stretches that stream through one for the same pattern.
SHARD_PATTERNS = 4000
SHARD_STRETCHES = 20000
#: Word ids in one automaton, at most; a shard beyond it streams through several, one after the other.
AUTOMATON_IDS = 1 << 21
_CHUNK = 1 << 21


def _stretches(found: Recurring, window: int) -> DataFrame:
    """doc_id, sig, lo, n words, passage, copies, first: where recurring passages may stand."""
    key = ["doc_id", "sig"]
    copied = found.copied.select(
        *key, "lo", (F.col("n") + window - 1).alias("n"), F.col("block").alias("passage"), "copies", "first"
    )
    # Neighbouring starts of one document make one passage.
    order = Window.partitionBy(*key).orderBy("lo")
    runs = (
        found.single.withColumn("_run", F.col("lo") - F.row_number().over(order))
        .groupBy(*key, "_run")
        .agg(F.min("lo").alias("lo"), F.count(F.lit(1)).alias("m"))
    )
    single = runs.select(
        *key,
        "lo",
        (F.col("m") + window - 1).cast("int").alias("n"),
        F.xxhash64(*key, "lo").alias("passage"),
        F.lit(1).cast("long").alias("copies"),
        F.lit(True).alias("first"),
    )
    return copied.union(single)


def _with_words(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """The stretches with their word ids."""
    fields = ("lo", "n", "passage", "copies", "first")
    parts = stretches.groupBy("doc_id", "sig").agg(F.collect_set(F.struct(*fields)).alias("parts"))
    schema = "doc_id long, sig int, lo int, passage long, copies long, first boolean, words array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            counts, (low, n, passage, copies, first) = listed(batch.column(3), fields)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            for a, b in pieces(map(len, texts), _CHUNK):
                values, sizes = word_units(texts[a:b])
                ids = (values >> np.uint64(32)).astype(np.uint32).view(np.int32)
                own = slice(offsets[a], offsets[b])
                doc = np.repeat(np.arange(b - a), counts[a:b])
                each = n[own].astype(np.int64)
                at = ranges(low[own] + (np.cumsum(sizes) - sizes)[doc], each)
                ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                keys = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(keys),
                        batch.column(1).take(keys),
                        pa.array(low[own]),
                        pa.array(passage[own]),
                        pa.array(copies[own]),
                        pa.array(first[own].astype(bool)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[at])),
                    ],
                    names=["doc_id", "sig", "lo", "passage", "copies", "first", "words"],
                )

    return rows.join(parts, ["doc_id", "sig"]).select("doc_id", "sig", "text", "parts").mapInArrow(run, schema)


def _sequence(words: pa.Scalar) -> tuple[int, ...]:
    return tuple(words.values.to_numpy(zero_copy_only=False).view(np.uint32).tolist())


def _compiled(patterns: list[tuple[int, ...]]):
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        automaton.add_word(p, len(p))
    automaton.make_automaton()
    return automaton


def occurrences(stretches: DataFrame) -> DataFrame:
    """doc_id, sig, lo, hi of every occurrence of a passage within the stretches of its shard.

    A passage goes to the shard of its hash. One with very many copies goes to several, and its
    copies are dealt over them.
    """
    patterns = stretches.where("first").count()
    shards = max(shuffle_width(stretches.sparkSession), -(-patterns // SHARD_PATTERNS))
    salts = F.ceil(F.col("copies") / SHARD_STRETCHES).cast("long")
    streamed = stretches.select(
        "*", F.lit(1).alias("kind"), F.pmod(F.xxhash64("doc_id", "sig", "lo"), salts).alias("salt")
    )
    sown = stretches.where("first").select(
        "*", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
    )
    dealt = (
        sown.union(streamed)
        .withColumn("shard", F.pmod(F.xxhash64("passage", "salt"), F.lit(shards).cast("long")))
        .select("shard", "kind", "passage", "doc_id", "sig", "lo", "words")
        .repartition(shards, "shard")
        # Within the shard by passage, so that a pattern stands right before what it may occur in.
        .sortWithinPartitions("shard", "passage", "kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: list[tuple[int, ...]] = []
        waiting: list[tuple[int, int, int, tuple[int, ...]]] = []
        size = held = 0

        def found() -> Iterator[pa.RecordBatch]:
            if patterns and waiting:
                automaton = _compiled(patterns)
                hits = [
                    (doc, sig, low + end + 1 - length, low + end + 1)
                    for doc, sig, low, words in waiting
                    for end, length in automaton.iter(words)
                ]
                columns = list(zip(*hits, strict=True)) if hits else [()] * 4
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "sig", "lo", "hi"]
                )

        last = None
        for batch in batches:
            kinds, passages, docs, sigs, lows = (batch.column(i).to_pylist() for i in range(1, 6))
            words = batch.column(6)
            for i, kind in enumerate(kinds):
                if kind == 0:
                    if size > AUTOMATON_IDS or held > AUTOMATON_IDS:
                        yield from found()
                        patterns, waiting, size, held = [], [], 0, 0
                    last = _sequence(words[i])
                    patterns.append(last)
                    size += len(last)
                else:
                    if held > AUTOMATON_IDS:
                        yield from found()
                        # The copies of the passage that is being read still need its pattern.
                        patterns, waiting, size, held = [last], [], len(last), 0
                    own = _sequence(words[i])
                    waiting.append((docs[i], sigs[i], lows[i], own))
                    held += len(own)
        yield from found()

    return dealt.mapInArrow(run, "doc_id long, sig int, lo int, hi int")


def removed(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, UTF-8).

    A word goes if a window of ``window`` words that starts at another place too, in any document,
    covers it. Windows never cross documents and are judged on the input. Null and blank texts have
    no words. Repeated rows are copies of each other; an empty table gives an empty result. Rows without
    id are left out.
    """
    rows = keyed(docs, id_col, text_col)
    found = recurring(rows, Units(word_units, window))
    stretches = materialize(_with_words(rows, _stretches(found, window)))
    found.discard()
    covered = materialize(spans(occurrences(stretches)))
    discard(stretches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, (low, high) = listed(batch.column(2), ("lo", "hi"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.split()
                own = slice(offsets[i], offsets[i + 1])
                kept = words
                if counts[i]:
                    from_, to = merged(low[own], high[own])
                    edges = [0, *np.stack([from_, to], axis=1).ravel().tolist(), len(words)]
                    kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined))
            n, gone, digests, left = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(left, pa.binary()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    marked = rows.join(covered, ["doc_id", "sig"], "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
