"""Document fingerprints: Merkle trees over segments, paragraphs and sections.

A leaf is a run of words of one paragraph (line). A paragraph ends at its line break; a long one is
cut after words chosen by their own hash, so an edit moves no cut but those beside it. A section
ends at an empty line or after a leaf chosen by its hash. The leaves of a text concatenate to the
text. The digest of a section is taken over the hashes of its leaves, the root over the sections.

A fingerprint is written ``root:section.leaves,section.leaves``: 32 hex digits for the root, 16 for
a section, 6 for each leaf. Equal texts have equal fingerprints; where roots differ, only the sections
whose digests differ have to be opened.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import id_and_text, shuffle_width
from priceforge.llm.rolling import Prefixes, pieces

#: One word in so many ends a leaf; one leaf in so many ends a section. Powers of two.
WORDS_A_LEAF = 4
LEAVES_A_SECTION = 16
_CHUNK = 1 << 20


def fingerprints(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    for a, b in pieces(map(len, texts), _CHUNK):
        out += _fingerprints(texts[a:b])
    return out


def _fingerprints(texts: list[bytes]) -> list[str]:
    joined = b"".join(texts)
    limits = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    buffer = np.frombuffer(joined, dtype=np.uint8)
    hashes = Prefixes(buffer)
    line = buffer == 10
    white = (buffer == 32) | line
    # A cut stands after a white byte: always after a line break, else where the word before it says so.
    after = np.flatnonzero(white) + 1
    begins = np.concatenate([[0], after[:-1]])
    begins = np.maximum(begins, limits[np.searchsorted(limits, after - 1, side="right") - 1])
    chosen = (hashes.of(begins, after - 1) & np.uint64(WORDS_A_LEAF - 1)) == 0
    cuts = np.unique(np.concatenate([after[line[after - 1] | chosen], limits]))
    leaves = hashes.of(cuts[:-1], cuts[1:])
    empty_line = line[cuts[1:] - 1] & (cuts[1:] - cuts[:-1] == 1)
    closes = (leaves & np.uint64((LEAVES_A_SECTION - 1) << 8)) == 0
    closes |= empty_line
    first = np.searchsorted(cuts, limits)
    raw = leaves.astype(">u8").tobytes()
    short = (leaves >> np.uint64(40)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
    out = []
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        ends = [*(np.flatnonzero(closes[a : b - 1]) + a + 1).tolist(), b] if b > a else []
        sections, root = [], hashlib.blake2b(digest_size=16)
        for end in ends:
            digest = hashlib.blake2b(raw[8 * a : 8 * end], digest_size=8)
            root.update(digest.digest())
            sections.append(f"{digest.hexdigest()}.{short[6 * a : 6 * end]}")
            a = end
        out.append(f"{root.hexdigest()}:{','.join(sections)}")
    return out


def sections_of(fingerprint: str) -> list[tuple[str, list[str]]]:
    """The sections of a fingerprint: digest and leaves."""
    body = fingerprint.partition(":")[2]
    out = []
    for section in body.split(",") if body else []:
        digest, _, leaves = section.partition(".")
        out.append((digest, [leaves[i : i + 6] for i in range(0, len(leaves), 6)]))
    return out


def _open(a: str, b: str) -> tuple[int, Counter, Counter]:
    """Leaves in sections that both have, and the leaves of the sections that only one has."""
    left, right = sections_of(a), sections_of(b)
    shared = Counter(d for d, _ in left) & Counter(d for d, _ in right)
    common, rests = 0, []
    for side in (left, right):
        open_, rest = shared.copy(), Counter()
        common = 0
        for digest, leaves in side:
            if open_[digest] > 0:
                open_[digest] -= 1
                common += len(leaves)
            else:
                rest.update(leaves)
        rests.append(rest)
    return common, rests[0], rests[1]


def likeness(a: str, b: str) -> float:
    """Twice the shared leaves over all leaves of two fingerprints: 1 for equal roots, 0 for nothing shared."""
    if a[:32] == b[:32]:
        return 1.0
    common, left, right = _open(a, b)
    total = 2 * common + left.total() + right.total()
    return 2 * (common + (left & right).total()) / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, leaf) places of ``a`` whose leaf ``b`` lacks: where the edits are."""
    if a[:32] == b[:32]:
        return []
    _, _, right = _open(a, b)
    kept = Counter(d for d, _ in sections_of(b))
    places = []
    for s, (digest, leaves) in enumerate(sections_of(a)):
        if kept[digest] > 0:
            kept[digest] -= 1
            continue
        for i, leaf in enumerate(leaves):
            if right[leaf] > 0:
                right[leaf] -= 1
            else:
                places.append((s, i))
    return places


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _described(rows: list[tuple[int, str, str]]) -> Iterator[tuple]:
    """Rows (doc_id, text, text of the next document) with all that is asked for."""
    edited = []
    for _, text, following in rows:
        k = len(text) // 3
        edited.append((text[: len(text) - k] + following[:k]).encode())
    own = fingerprints([text.encode() for _, text, _ in rows])
    # The next document is mostly the next row, whose fingerprint is there already.
    known = dict(zip((text for _, text, _ in rows), own))
    others = list(dict.fromkeys(n for _, _, n in rows if n not in known))
    known.update(zip(others, fingerprints([t.encode() for t in others])))
    changed = fingerprints(edited)
    for (doc_id, text, following), fp, new, bytes_ in zip(rows, own, changed, edited):
        near = likeness(fp, new), likeness(fp, known[following])
        yield doc_id, len(text), hashlib.sha256(bytes_).hexdigest(), fp, new, *near


def _batches(rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW
        )

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sorted row of a range with its successor; the last one's is the first row from the range behind."""

    def rows():
        last, ready, total = None, [], 0
        for batch in batches:
            for extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None:
                    ready.append((*last, text))
                    total += len(last[1])
                    if total > _CHUNK:
                        yield from _described(ready)
                        ready, total = [], 0
                if extra:
                    yield from _described(ready)
                    return
                last = doc_id, text

    return _batches(rows())


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are ordered by falling id, equal ids by text; the document after the last is the first,
    so a single one follows itself. A null text is empty; an empty text has no leaf, is like itself (1)
    and unlike any other (0). An empty table gives an empty result.

    Quantiles of the ids, one for each shuffle partition, cut the order into ranges. A row goes to the task
    of its range; the first row of a range goes to the task of the range before it as well, so every
    task has the successors of all its rows. The texts are shuffled once and nothing is stored.
    """
    rows = id_and_text(docs, id_col, text_col)
    width = shuffle_width(docs.sparkSession)
    shares = [i / width for i in range(1, width)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 100 * width).alias("cuts")).first().cuts
    # An empty table has no quantile, and any one cut will do.
    limits = [-float("inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    placed = (
        Bucketizer(splits=limits, inputCol="_id", outputCol="_range")
        .transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
        .select("doc_id", "text", (F.lit(len(limits) - 2) - F.col("_range").cast("int")).alias("range"))
    )
    # One row for each range.
    heads = placed.groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()
    before = [heads[i - 1]["range"] for i in range(len(heads))]
    copies = F.array(
        F.struct(F.col("range").alias("task"), F.lit(False).alias("extra")),
        F.struct(
            F.element_at(F.create_map(*[F.lit(x) for h, b in zip(heads, before) for x in (h["range"], b)]), F.col("range"))
            .alias("task"),
            F.lit(True).alias("extra"),
        ),
    ) if heads else F.array(F.struct(F.col("range").alias("task"), F.lit(False).alias("extra")))
    is_head = F.col("doc_id").isin([h["head"] for h in heads])
    dealt = placed.select(
        "doc_id", "text", F.explode(F.when(is_head, copies).otherwise(F.slice(copies, 1, 1))).alias("to")
    ).select("to.task", "to.extra", "doc_id", "text")
    fields = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return (
        dealt.repartitionById(width, "task")
        .sortWithinPartitions("extra", F.col("doc_id").desc(), "text")
        .select("extra", "doc_id", "text")
        .mapInArrow(_with_next, fields)
    )
