"""Removal of byte strings that recur anywhere, by distributed prefix doubling (see ``repeats``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.corpus import few_rows
from priceforge.llm.repeats import Units, byte_units, keyed, listed, merged, recurring, spans
from priceforge.session import materialize

THRESHOLD = 200


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, sig, text, spans): every row with the intervals of bytes that recurring strings cover, null if none."""
    rows = keyed(docs, id_col, text_col)
    found = recurring(rows, Units(byte_units, threshold, max(2, threshold // 16)))
    covered = ("doc_id", "sig", "lo", (F.col("lo") + F.col("n") - 1 + threshold).alias("hi"))
    intervals = found.copied.select(*covered).union(found.single.select(*covered))
    covered = materialize(spans(intervals))
    found.discard()
    return rows.join(covered, ["doc_id", "sig"], "left")


def _kept(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[bytes, int]:
    """What the intervals leave of a text, and the number of maximal runs that go."""
    if not len(low):
        return text, 0
    low, high = merged(low, high)
    edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(low)


def removed(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    as_text: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if a string of ``threshold`` bytes that starts at another place too, in any
    document, covers it. Strings never cross documents and are judged on the input. Null is empty;
    shorter texts stay whole. Repeated rows are copies of each other, so their long texts go; an
    empty table gives an empty result. Rows without id are left out. With ``as_text`` ``kept`` is a string,
    without what a cut leaves of a character.
    """
    kind = pa.string() if as_text else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            counts, (low, high) = listed(batch.column(2), ("lo", "hi"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = slice(offsets[i], offsets[i + 1])
                kept, n = _kept(text, low[own], high[own])
                digest = hashlib.sha256(kept).hexdigest()
                rows.append((len(text), len(text) - len(kept), n, digest, kept.decode("utf-8", "ignore") if as_text else kept))
            sizes, gone, runs, digests, left = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(left, kind),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    found = repeated_spans(docs, threshold, id_col, text_col).select("doc_id", "text", "spans")
    return found.mapInArrow(
        run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kind}"
    )


def without_repeated_strings(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the recurring strings cut out of ``text`` and ``n_chars`` counted anew.

    A cut may split a character; the bytes that are left of it go too. Texts that lose nothing
    stay as they are, null ones included, as do rows without id. Ids must be unique.
    """
    # Decoded by the worker that cuts: two Python steps in one stage would take two workers for each core.
    texts = (
        removed(docs, threshold, as_text=True)
        .where("n_removed > 0")
        .select(F.col("doc_id").alias("_cut_id"), F.col("kept").alias("_cut_text"))
    )
    both = docs.join(texts, F.col("`doc_id`").cast("long") == F.col("_cut_id"), "left")
    replaced = {"text": F.coalesce("_cut_text", "text")}
    if "n_chars" in docs.columns:
        counted = F.when(F.col("_cut_text").isNotNull(), F.length("_cut_text")).otherwise(F.col("n_chars"))
        replaced["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    return both.withColumns(replaced).select(*[F.col(f"`{c}`") for c in docs.columns])
