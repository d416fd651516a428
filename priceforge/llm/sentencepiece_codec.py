"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch (a run of spaces and the word behind it) are concatenated and indexed
by a suffix array. Every piece of the vocabulary is searched in it; a range of suffixes that begin
with a piece gives the occurrences. The occurrences are edges; sorted by position they are relaxed
from left to right under the rule of pair merging. Decoding joins the bytes of the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.bpe import Fits, Relaxed
from priceforge.llm.corpus import id_and_text
from priceforge.llm.rolling import pieces

MODEL = "piece_bpe_32k.model"
_CHUNK = 1 << 21
_UNITS = 1 << 18
_REMEMBERED = 400_000
_SPACE_MARK = "▁"
_UNIT = regex.compile(" *[^ ]+| +")
#: Between units; no byte of UTF-8.
_GAP = 0xFF


def symbols(text: bytes) -> list[bytes]:
    """The characters of UTF-8 bytes."""
    return [c.encode() for c in text.decode()]


class Wanted:
    """Texts to search: for each block of eight bytes the texts that reach it, their least and their largest key."""

    def __init__(self, texts: list[bytes], depth: int):
        self.n = len(texts)
        self.blocks = []
        for b in range(-(-depth // 8)):
            use = [i for i, t in enumerate(texts) if len(t) > 8 * b]
            cut = [texts[i][8 * b : 8 * b + 8] for i in use]
            least = [int.from_bytes(c.ljust(8, b"\0"), "big") for c in cut]
            most = [int.from_bytes(c.ljust(8, b"\xff"), "big") for c in cut]
            self.blocks.append((np.array(use, np.int64), np.array(least, np.uint64), np.array(most, np.uint64)))


class SuffixArray:
    """The suffixes of a buffer, sorted by their first ``depth`` bytes, eight bytes to a key."""

    def __init__(self, buffer: np.ndarray, depth: int):
        n = len(buffer)
        padded = np.concatenate([buffer, np.full(8, _GAP, np.uint8)])
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key |= padded[k : n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        blocks = -(-depth // 8)
        far = np.concatenate([key, np.full(8 * blocks, np.iinfo(np.uint64).max, np.uint64)])
        keys = [far[8 * b : 8 * b + n] for b in range(blocks)]
        # Most suffixes differ in their first key; only those that share it are sorted by the others.
        self.order = np.argsort(keys[0])
        first = keys[0][self.order]
        new = np.concatenate([[True], first[1:] != first[:-1]])
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if len(tied) and blocks > 1:
            own = self.order[tied]
            self.order[tied] = own[np.lexsort([*(k[own] for k in keys[:0:-1]), np.cumsum(new)[tied]])]
        self.keys = [k[self.order] for k in keys]

    def ranges(self, wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
        """For each text the range of suffixes that begin with it, by binary search on block after block."""
        low = np.zeros(wanted.n, dtype=np.int64)
        high = np.full(wanted.n, len(self.order), dtype=np.int64)
        for keys, (use, least, most) in zip(self.keys, wanted.blocks):
            a, z = low[use], high[use]
            low[use] = _bisect(keys, a, z, least, False)
            high[use] = _bisect(keys, a, z, most, True)
        return low, high


def _bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, values: np.ndarray, right: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        below = keys[middle] <= values[open_] if right else keys[middle] < values[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


class Codec:
    """Encodes and decodes like the library does with the same model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.unknown = model.unk_id()
        names = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        tokens = [b"" if i in special else names[i].replace(_SPACE_MARK, " ").encode() for i in range(size)]
        self.vocabulary = {t: i for i, t in enumerate(tokens) if t}
        self.texts = list(self.vocabulary)
        self.ids = np.array(list(self.vocabulary.values()), dtype=np.int32)
        self.sizes = np.array(list(map(len, self.texts)), dtype=np.int64)
        self.depth = int(self.sizes.max())
        self.wanted = Wanted(self.texts, self.depth)
        # A better score merges earlier; equal scores go by position, which no two pieces share.
        rank = {t: (-model.get_score(i), i) for t, i in self.vocabulary.items()}
        order = {t: r for r, t in enumerate(sorted(rank, key=rank.get))}
        self.fits = Fits(tokens, symbols, lambda a, b: order.get(a + b), frozenset([self.unknown]))
        self.raw = list(tokens)
        for b in range(256):
            self.raw[self.byte_ids[b]] = bytes([b])
        self.raw_sizes = np.fromiter(map(len, self.raw), np.int64, size)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.raw_bytes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def edges(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of all occurrences of pieces; unknown characters are edges of their own."""
        index = SuffixArray(buffer, self.depth)
        low, high = index.ranges(self.wanted)
        number = high - low
        piece = np.repeat(np.arange(self.wanted.n), number)
        entry = np.arange(len(piece)) - np.repeat(np.cumsum(number) - number, number) + low[piece]
        places, sizes, ids = index.order[entry], self.sizes[piece], self.ids[piece]
        heads = np.flatnonzero(((buffer & 0xC0) != 0x80) & (buffer != _GAP))
        nexts = np.flatnonzero((buffer & 0xC0) != 0x80)
        nexts = np.append(nexts, len(buffer))
        width = nexts[np.searchsorted(nexts, heads, side="right")] - heads
        of_place = np.zeros(len(buffer), dtype=np.int64)
        of_place[heads] = width
        single = np.zeros(len(buffer), dtype=bool)
        single[places[sizes == of_place[places]]] = True
        strange = heads[~single[heads]]
        return (
            np.concatenate([places, strange]),
            np.concatenate([sizes, of_place[strange]]),
            np.concatenate([ids, np.full(len(strange), self.unknown, np.int32)]),
        )

    def _segment(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in order, and how many each has."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        gap = bytes([_GAP])
        buffer = np.frombuffer(gap.join(units) + gap, dtype=np.uint8)
        places, sizes, ids = self.edges(buffer)
        firsts = np.cumsum(lengths + 1) - (lengths + 1)
        unit = np.repeat(np.arange(len(units)), lengths + 1)
        start = places - firsts[unit[places]]
        relaxed = Relaxed(lengths, unit[places], start, start + sizes, ids, self.fits)
        tokens, begins, widths = relaxed.paths()
        totals = relaxed.totals()
        # An unknown character becomes its bytes.
        of_unit = np.repeat(np.arange(len(units)), totals)
        strange = tokens == self.unknown
        number = np.where(strange, widths, 1)
        out = np.repeat(tokens, number)
        step = np.arange(len(out)) - np.repeat(np.cumsum(number) - number, number)
        at = np.repeat(firsts[of_unit] + begins, number) + step
        fallback = np.repeat(strange, number)
        out[fallback] = self.byte_ids[buffer[at[fallback]]]
        return out, np.bincount(of_unit, weights=number, minlength=len(units)).astype(np.int64)

    def _learn(self, units: list[str]) -> None:
        raw = [u.encode() for u in units]
        parts = [self._segment(raw[a:b]) for a, b in pieces(map(len, raw), _UNITS)]
        if parts:
            ids, counts = (np.concatenate(x) for x in zip(*parts))
            self.known.update(zip(units, range(len(self.counts), len(self.counts) + len(units))))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        parts = [self._encode(texts[a:b]) for a, b in pieces(map(len, texts), _CHUNK)]
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        units, sizes = [], []
        for text in texts:
            marked = " " + text.replace(_SPACE_MARK, " ") if text else ""
            if "  " in marked or "\0" in marked or marked[-1:] == " ":
                own = _UNIT.findall(marked)
            else:
                own = marked.replace(" ", "\0 ").split("\0")[1:]
            units += own
            sizes.append(len(own))
        if len(self.known) > _REMEMBERED:
            self._forget()
        self._learn([u for u in set(units) if u not in self.known])
        index = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        counts = self.counts[index]
        ends = np.cumsum(counts)
        out = self.flat[np.repeat(self.starts[index] - ends + counts, counts) + np.arange(int(counts.sum()))]
        running = np.concatenate([[0], ends])
        borders = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        return out, np.diff(running[borders])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; invalid bytes become U+FFFD. Control pieces have no text."""
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.raw_starts[ids] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        joined = self.raw_bytes[at].tobytes()
        running = np.concatenate([[0], ends])
        borders = running[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b in zip(borders[:-1], borders[1:]):
            text = joined[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every document; a null or empty text has no ids."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = codec(path).encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            counts = np.array([len(x) if x else 0 for x in lists], dtype=np.int64)
            ids = np.array([i for x in lists if x for i in x], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codec(path).decode(ids, counts), pa.string())], names=["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def coded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, ids_crc32, decoded_sha256, round_trip.

    The ids are those of the library without begin and end. ``round_trip`` tells whether decoding gives
    the text back; a text with U+2581 comes back with spaces, by the rule of the model. Null and empty
    texts have no ids. Repeated rows give repeated rows, an empty table an empty result.
    """
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            for a, b in pieces(map(len, texts), _CHUNK):
                ids, counts = own.encode(texts[a:b])
                back = own.decode(ids, counts)
                ends = np.cumsum(counts)
                little = ids.astype("<u4")
                rows += [
                    (int(n), zlib.crc32(little[e - n : e].tobytes()), new, new == text)
                    for n, e, new, text in zip(counts, ends, back, texts[a:b])
                ]
            n, crc, back, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "decoded", "round_trip"],
            )

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, decoded string, round_trip boolean"
    ).select(
        "doc_id",
        F.octet_length("decoded").cast("long").alias("n_bytes"),
        "n_tokens",
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )
