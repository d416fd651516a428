"""Recurring strings of a fixed length, by doubling ranks of positions with Spark.

A unit is a byte or a word. Naming every position of a corpus once per doubling would shuffle its
size more than a hundred times over, so the first names are sparse: the name of a start is the
smallest hash of the ``threshold // 3`` units long strings inside its window of ``threshold`` units.
Equal windows have equal names, and neighbouring starts share theirs, so a maximal run of starts
with one name is one row, a block. Then positions are reranked at growing lengths, and what is
unique drops out at each:

1. blocks whose name is unique hold no recurring window, unless its hash stands in them twice;
2. of the others, blocks of which a copy exists recur as a whole;
3. where one name has several different blocks, or is tied, one of each is cut into cells of at most
   ``cell`` starts, aligned to the place of the smallest hash. A cell is named by the units that all
   its windows share, and cells are settled like blocks;
4. what is still open is cut into single starts, ranked by the pair of names of both halves of the window.

Names are 64-bit hashes. What counts as equal rests on two of them, name and block or both halves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import few_rows, id_and_text
from priceforge.llm.rolling import Prefixes, pieces
from priceforge.session import discard, materialize

_CHUNK = 1 << 19
#: Starts that are named at a time; a longer document is cut, which changes blocks but no result.
_SLICE = 1 << 21
#: Bytes that separate words.
_SPACES = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts, and how many each has."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(b"".join(texts), dtype=np.uint8), sizes


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and how many words each has."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buffer = np.frombuffer(b" ".join(texts).translate(_SPACES), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], buffer != 32, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2]
    ends = np.cumsum(lengths + 1)
    sizes = np.diff(np.searchsorted(first, ends), prepend=0)
    return Prefixes(buffer).of(first, last), sizes


@dataclass(frozen=True)
class Units:
    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    threshold: int
    #: Starts in a cell; 0 leaves step 3 out.
    cell: int = 0


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows under a key of their own, (doc_id, sig); only repeated rows share one."""
    return id_and_text(docs, id_col, text_col).select(
        "doc_id", F.hash("text").alias("sig"), F.col("text").cast("binary").alias("text")
    )


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs_of(values: np.ndarray, sizes: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of a buffer: document, first start in it, number of starts, name, hash of all it covers, tied.

    Only in a tied block, where the smallest hash stands more than once, a window can recur within it.
    """
    short = max(1, threshold // 3)
    ends = np.cumsum(sizes)
    for cut in range(0, max(0, len(values) - threshold + 1), _SLICE):
        part = values[cut : cut + _SLICE + threshold - 1]
        n = len(part) - threshold + 1
        prefixes = Prefixes(part)
        at = np.arange(len(part) - short + 1)
        hashes, width = prefixes.of(at, at + short), threshold - short + 1
        name = _least(hashes, width)
        starts = np.arange(cut, cut + n)
        doc = np.searchsorted(ends, starts, side="right")
        valid = starts + threshold <= ends[np.minimum(doc, len(ends) - 1)]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (name[1:] != name[:-1])
        first = np.flatnonzero(fresh)
        breaks = np.append(np.flatnonzero(fresh | ~valid), n)
        last = breaks[np.searchsorted(breaks, first, side="right")]
        owner = doc[first]
        low = first + cut - (ends[owner] - sizes[owner])
        if len(first):
            wide = last - first + width - 1
            same = hashes[ranges(first, wide)] == np.repeat(name[first], wide)
            tied = np.add.reduceat(same.astype(np.int32), np.cumsum(wide) - wide) > 1
            yield owner, low, last - first, name[first], prefixes.of(first, last - 1 + threshold), tied


def blocks(rows: DataFrame, units: Units) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column(2).to_pylist()
            for a, b in pieces(map(len, texts), _CHUNK):
                values, sizes = units.split(texts[a:b])
                for owner, low, n, name, block, tied in runs_of(values, sizes, units.threshold):
                    at = pa.array(owner + a)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            batch.column(1).take(at),
                            pa.array(low.astype(np.int32)),
                            pa.array(n.astype(np.int32)),
                            pa.array(name.view(np.int64)),
                            pa.array(block.view(np.int64)),
                            pa.array(tied),
                        ],
                        names=["doc_id", "sig", "lo", "n", "name", "block", "tied"],
                    )

    return rows.mapInArrow(run, "doc_id long, sig int, lo int, n int, name long, block long, tied boolean")


def listed(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many structs each row of a list column holds, and their fields, flat."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return counts, [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


def ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... low + n - 1 for each pair."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(n) else 0) + np.repeat(low - (total - n), n)


def cells_of(
    prefixes: Prefixes, low: np.ndarray, n: np.ndarray, units: Units
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks cut into cells: block, first start, number of starts, name, hash of all the cell covers."""
    threshold, cell = units.threshold, units.cell
    short = max(1, threshold // 3)
    width = threshold - short + 1
    wide = n + width - 1
    at = ranges(low, wide)
    hashes = prefixes.of(at, at + short)
    least = np.minimum.reduceat(hashes, np.cumsum(wide) - wide) if len(n) else hashes
    hit = hashes == np.repeat(least, wide)
    apart = np.int64(len(prefixes.sums))
    marks = np.repeat(np.arange(len(n)), wide)[hit] * apart + at[hit]
    block = np.repeat(np.arange(len(n)), n)
    start = ranges(low, n)
    anchor = marks[np.searchsorted(marks, block * apart + start)] - block * apart
    shared = anchor - (anchor - start) // cell * cell
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (block[1:] != block[:-1]) | (shared[1:] != shared[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    begin, core = start[first], shared[first]
    name = prefixes.of(core, core + threshold - cell + 1)
    return block[first], begin, count, name, prefixes.of(begin, begin + count - 1 + threshold)


def starts_of(
    prefixes: Prefixes, low: np.ndarray, n: np.ndarray, units: Units
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with single starts, named by both halves of their window."""
    half, start = units.threshold // 2, ranges(low, n)
    left, right = prefixes.of(start, start + half), prefixes.of(start + half, start + units.threshold)
    return np.repeat(np.arange(len(n)), n), start, np.ones(len(start), dtype=np.int64), left, right


def cut(rows: DataFrame, wanted: DataFrame, units: Units, finer: Callable) -> DataFrame:
    """The ``wanted`` stretches of starts (doc_id, sig, lo, n, weight), cut by ``finer`` and named anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = batch.column(2).to_pylist()
            counts, (low, n, weight) = listed(batch.column(3), ("lo", "n", "weight"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            for a, b in pieces(map(len, texts), _CHUNK):
                values, sizes = units.split(texts[a:b])
                begins = np.cumsum(sizes) - sizes
                own = slice(offsets[a], offsets[b])
                doc = np.repeat(np.arange(b - a), counts[a:b])
                at, start, each, name, block = finer(
                    Prefixes(values), low[own] + begins[doc], n[own].astype(np.int64), units
                )
                keys = pa.array(doc[at] + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(keys),
                        batch.column(1).take(keys),
                        pa.array((start - begins[doc[at]]).astype(np.int32)),
                        pa.array(each.astype(np.int32)),
                        pa.array(weight[own][at].astype(np.int32)),
                        pa.array(name.view(np.int64)),
                        pa.array(block.view(np.int64)),
                    ],
                    names=["doc_id", "sig", "lo", "n", "weight", "name", "block"],
                )

    key = ["doc_id", "sig"]
    # The stretches of one document: their number is bounded by its length.
    parts = wanted.groupBy(*key).agg(F.collect_list(F.struct("lo", "n", "weight")).alias("parts"))
    # Of repeated rows one is enough, the others hold the same.
    once = rows.join(parts.select(*key), key, "left_semi").dropDuplicates(key)
    schema = "doc_id long, sig int, lo int, n int, weight int, name long, block long"
    return once.join(parts, key).select(*key, "text", "parts").mapInArrow(run, schema)


@dataclass(frozen=True)
class Recurring:
    """Where windows recur.

    ``copied``: doc_id, sig, lo, n, block, copies, first — every block that has a copy; one of each is first.
    ``single``: doc_id, sig, lo, n — every other run of starts of recurring windows; n is 1 without cells.
    """

    copied: DataFrame
    single: DataFrame
    #: Stored tables that both are read from.
    stored: tuple[DataFrame, ...] = ()

    def discard(self) -> None:
        """Remove them; what was made of them must be stored by then."""
        for table in self.stored:
            discard(table)


def recurring(rows: DataFrame, units: Units) -> Recurring:
    key = ["doc_id", "sig"]
    found = materialize(blocks(rows, units))
    count, tied = F.count(F.lit(1)).alias("m"), F.max("tied").alias("tied")
    names = found.groupBy("name").agg(count, tied).where("m > 1 or tied").select("name")
    live = materialize(found.join(names, "name", "left_semi"))
    discard(found)
    place = F.struct("doc_id", "sig", "lo", "n")
    distinct = materialize(
        live.groupBy("name", "block").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("rep"), tied)
    )
    several = distinct.groupBy("name").agg(count, tied).where("m > 1 or tied").select("name")
    unsettled = distinct.join(several, "name", "left_semi").select(
        "rep.*", F.least("copies", F.lit(2)).cast("int").alias("weight")
    )
    single, stored = None, [live, distinct]
    if units.cell:
        cells = materialize(cut(rows, unsettled, units, cells_of))
        # A cell name that only one row has is unique, unless the row stands for copies.
        shared = cells.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name")
        groups = materialize(
            cells.join(shared, "name", "left_semi")
            .groupBy("name", "block")
            .agg(F.sum("weight").alias("copies"), F.min(place).alias("rep"))
        )
        mixed = groups.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name")
        unsettled = groups.join(mixed, "name", "left_semi").select(
            "rep.*", F.least("copies", F.lit(2)).cast("int").alias("weight")
        )
        again = groups.where("copies > 1").select("name", "block")
        single = cells.where("weight = 1").join(again, ["name", "block"], "left_semi").select(*key, "lo", "n")
        stored += [cells, groups]
    starts = materialize(cut(rows, unsettled, units, starts_of))
    again = starts.groupBy("name", "block").agg(F.sum("weight").alias("m")).where("m > 1").select("name", "block")
    found_single = starts.where("weight = 1").join(again, ["name", "block"], "left_semi").select(*key, "lo", "n")
    single = found_single if single is None else single.union(found_single)
    copied = live.join(distinct.where("copies > 1").drop("tied"), ["name", "block"]).select(
        *key, "lo", "n", "block", "copies", (place == F.col("rep")).alias("first")
    )
    return Recurring(copied, single, (*stored, starts))


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the half-open intervals cover; touching ones are one run."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = low[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return low[at], reach[np.append(at[1:], len(low)) - 1] if len(low) else reach


def spans(intervals: DataFrame) -> DataFrame:
    """(doc_id, sig, spans) of rows doc_id, sig, lo, hi; a document's intervals are bounded by its length."""
    return intervals.groupBy("doc_id", "sig").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
