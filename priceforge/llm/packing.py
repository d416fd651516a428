"""Packing documents into as few token sequences as possible.

Only how many pieces there are of each length matters for the plan, so it is made from a histogram of
at most ``CAPACITY`` numbers. First the reduction of Martello and Toth: a set of lengths that fills a
sequence at least as well as any other set with its largest member is fixed for good. What is
left is packed best fit, longest first. Both work on whole multiplicities. Spark then numbers
the pieces of each length and looks their numbers up in the plan.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priceforge.llm.bpe import Fits, Merger, Segmenter, byte_alphabet
from priceforge.llm.corpus import id_and_text, numbered
from priceforge.llm.rolling import Prefixes, pieces
from priceforge.session import materialize

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
_CHUNK = 1 << 20
_UNITS = 1 << 18
#: Parts of words of at most so many bytes are merged pair by pair, in rows of these widths.
_WIDTHS = (4, 8, 12, 16, 24, 32)
#: Documents that are taken out of Arrow at a time.
_ROWS = 1024
_SPACES = bytes(32 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
#: Written behind a word; no byte of UTF-8.
_WORD_END = b"\xff"
_SUFFIX = "</w>"
#: Any character that normalisation may change in another way than to lower case. Words with such a one are
#: left to the library.
_STRANGE = regex.compile("[^\n!-~\u00a1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e]")
#: What a word is cut into:
#: 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+
_BREAK, _LETTER, _NUMBER, _OTHER = range(4)


def _symbols(text: bytes) -> list[bytes]:
    out = [text[i : i + 1] for i in range(len(text))]
    return [*out[:-2], out[-2] + out[-1]] if text[-1:] == _WORD_END and len(out) > 1 else out


class Words:
    """Ids of whole texts, white space dropped, each distinct word and each distinct part of one encoded once."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()

        def raw(text: str) -> bytes:
            end = text.endswith(_SUFFIX)
            return bytes(alphabet[c] for c in (text[: -len(_SUFFIX)] if end else text)) + (_WORD_END if end else b"")

        self.special = [t["content"] for t in spec["added_tokens"]]
        names = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        byte_ff = next(c for c, b in alphabet.items() if b == 255)
        vocabulary = {raw(t): i for t, i in names.items() if byte_ff not in t}
        tokens = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for text, i in vocabulary.items():
            tokens[i] = text
        merges = {
            (raw(a), raw(b)): rank
            for rank, (a, b) in enumerate(spec["model"]["merges"])
            if byte_ff not in a and byte_ff not in b
        }
        self.segment = Segmenter(vocabulary, Fits(tokens, _symbols, lambda a, b: merges.get((a, b))))
        # The token of each byte within a part, then of each as its last.
        self.bytes = np.array([[vocabulary.get(bytes([b]) + end, -1) for b in range(256)] for end in (b"", _WORD_END)])
        self.merge = Merger({(vocabulary[a], vocabulary[b]): (r, vocabulary[a + b]) for (a, b), r in merges.items()})

    def _merged(self, buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts of words in order, and how many each has."""
        lengths = last - first
        symbols = self.bytes[0][buffer]
        symbols[last - 1] = self.bytes[1][buffer[last - 1]]
        # Few are longer, and a vocabulary may lack a byte: those are found by paths.
        missing = np.concatenate([[0], np.cumsum(symbols < 0)])
        short = (lengths <= _WIDTHS[-1]) & (missing[last] == missing[first])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for least, most in zip((0, *_WIDTHS), _WIDTHS):
            some = np.flatnonzero(short & (lengths > least) & (lengths <= most))
            columns = np.arange(most)
            inside = columns < lengths[some, None]
            rows = np.full((len(some), most), -1, dtype=np.int32)
            rows[inside] = symbols[(first[some, None] + columns)[inside]]
            rows = self.merge(rows)
            found.append((some, (rows >= 0).sum(axis=1), rows[rows >= 0]))
        others = np.flatnonzero(~short)
        for a, b in pieces(lengths[others].tolist(), _UNITS):
            spans = zip(first[others[a:b]].tolist(), last[others[a:b]].tolist())
            own = self.segment([buffer[x:y].tobytes() + _WORD_END for x, y in spans])
            found.append((others[a:b], own.totals(), own.paths()[0]))
        which, sizes, ids = (np.concatenate(x) for x in zip(*found))
        place = np.empty(len(first), dtype=np.int64)
        place[which] = np.arange(len(first))
        return _gather(ids, (np.cumsum(sizes) - sizes)[place], sizes[place])

    def _simple(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a line break between two, and how many each word has."""
        text = text.lower()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts, edges = _part_starts(codes)
        places = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800))])
        buffer = np.frombuffer(text.encode(), dtype=np.uint8)
        first, last = places[starts], places[edges[np.searchsorted(edges, starts) + 1]]
        at, which = _distinct(buffer, first, last)
        ids, counts = self._merged(buffer, first[at], last[at])
        joined, sizes = _gather(ids, (np.cumsum(counts) - counts)[which], counts[which])
        running = np.concatenate([[0], np.cumsum(sizes)])
        breaks = np.concatenate([np.flatnonzero(codes == 10), [len(codes)]])
        return joined, np.diff(running[np.searchsorted(starts, breaks)], prepend=0)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has."""
        text = b"\n".join(words).decode()
        if not words or not (_STRANGE.search(text) or any(s in text for s in self.special)):
            return self._simple(text) if words else (np.empty(0, np.int32), np.empty(0, np.int64))
        own = [w.decode() for w in words]
        odd = np.array([bool(_STRANGE.search(w)) or any(s in w for s in self.special) for w in own])
        others = self.library.encode_batch([own[i] for i in np.flatnonzero(odd).tolist()], add_special_tokens=False)
        rows = [e.ids for e in others]
        ids, counts = np.array([i for r in rows for i in r], np.int32), np.fromiter(map(len, rows), np.int64, len(rows))
        if not odd.all():
            simple, sizes = self._simple("\n".join(own[i] for i in np.flatnonzero(~odd).tolist()))
            ids, counts = np.concatenate([simple, ids]), np.concatenate([sizes, counts])
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(odd, kind="stable")] = np.arange(len(words))
        return _gather(ids, (np.cumsum(counts) - counts)[place], counts[place])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each has."""
        joined = b" ".join(texts).translate(_SPACES)
        buffer = np.frombuffer(joined, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], buffer != 32, [False]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        at, which = _distinct(buffer, first, last)
        ids, counts = self._ids([joined[a:b] for a, b in zip(first[at].tolist(), last[at].tolist())])
        ids, counts = _gather(ids, (np.cumsum(counts) - counts)[which], counts[which])
        running = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(running[np.searchsorted(first, ends)], prepend=0)


def _part_starts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of words begin, and where anything begins or ends: all characters at once."""
    kind = np.concatenate([[_BREAK], _kinds()[codes], [_BREAK] * 3])
    here, before = kind[1:-3], kind[:-4]
    begins = (here != _BREAK) & ((here != before) | (here == _NUMBER))
    # A short form is taken where its apostrophe begins a part.
    marks = np.flatnonzero((codes == ord("'")) & begins)
    after = np.concatenate([codes, [10, 10, 10]])
    size = np.zeros(len(marks), dtype=np.int64)
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        fits = np.ones(len(marks), dtype=bool)
        for k, c in enumerate(ending, 1):
            fits &= after[marks + k] == ord(c)
        size[fits] = 1 + len(ending)
    marks, size = marks[size > 0], size[size > 0]
    begins[marks + 1] = False
    ends = marks + size
    ends = ends[ends < len(codes)]
    begins[ends] = here[ends] != _BREAK
    return np.flatnonzero(begins), np.concatenate([np.flatnonzero(begins | (here == _BREAK)), [len(codes)]])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Letter, number or other for each character that a word without strange ones may have in lower case."""
    kinds = np.full(0x3000, _OTHER, dtype=np.int8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        kinds[[ord(c) for c in regex.findall(pattern, "".join(map(chr, range(len(kinds)))))]] = kind
    kinds[10] = _BREAK
    return kinds


def _distinct(buffer: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some spans of bytes that are all different, and for each span which of them equals it.

    Spans are told apart by a hash, their length and their first and last eight bytes; longer ones also by the
    bytes between.
    """
    prefixes, length = Prefixes(buffer), last - first
    _, at, which = np.unique(prefixes.of(first, last), return_index=True, return_inverse=True)
    stand, own = first[at][which], prefixes.masked(first, length)
    same = (length == length[at][which]) & (own == prefixes.masked(stand, length))
    tail = np.maximum(length - 8, 0)
    same &= prefixes.masked(first + tail, length) == prefixes.masked(stand + tail, length)
    long = np.flatnonzero(same & (length > 16))
    inner = length[long]
    steps = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner)
    if same.all() and (buffer[steps + np.repeat(first[long], inner)] == buffer[steps + np.repeat(stand[long], inner)]).all():
        return at, which
    spans = [buffer[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())]
    place = {s: i for i, s in reversed(list(enumerate(spans)))}
    at, which = np.unique([place[s] for s in spans], return_inverse=True)
    return at, which


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(int(counts.sum()))], counts


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of documents of (doc_id, text), the end id included."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (own.slice(i, _ROWS) for own in batches for i in range(0, own.num_rows, _ROWS)):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for a, b in pieces(map(len, texts), _CHUNK):
                ids, counts = words(path).encode(texts[a:b])
                little = ids.astype("<u4")
                at = 0
                for name, n in zip(names[a:b], counts.tolist()):
                    own = little[at : at + n].tobytes() + END_ID.to_bytes(4, "little")
                    at += n
                    for piece, start in enumerate(range(0, n + 1, capacity)):
                        part = own[4 * start : 4 * (start + capacity)]
                        rows.append((name, piece, start, len(part) // 4, zlib.crc32(part)))
            for a in range(0, len(rows), 10_000):
                columns = zip(*rows[a : a + 10_000])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length int, ids_crc32 long")


def reduced(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of lengths that some best packing has, with how often, and the lengths that are left.

    A set with member ``a`` dominates if every other feasible set with ``a`` can be turned into it by
    giving up members for others of at least their total length. That holds for a partner that fills the
    sequence exactly, for the largest partner where no two others fit beside ``a``, and where no three fit
    and no two are together longer than that partner; and for ``a`` alone where nothing fits.
    """
    left = dict(sizes)
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(members: tuple[int, ...], times: int) -> None:
        fixed.append((members, times))
        for m in members:
            left[m] -= times
            if not left[m]:
                del left[m]
                lengths.pop(bisect.bisect_left(lengths, m))

    for a in sorted(sizes, reverse=True):
        while a in left:
            room = capacity - a
            alone = left[a] == 1
            smallest = []
            for m in lengths:
                smallest += [m] * min(3, left[m] - (1 if m == a else 0))
                if len(smallest) >= 3:
                    break
            if not smallest or smallest[0] > room:
                # Nothing fits beside it; more copies of itself would have.
                take((a,), left[a])
                continue
            at = bisect.bisect_right(lengths, room) - 1
            if at >= 0 and lengths[at] == a and alone:
                at -= 1
            if at < 0:
                break
            partner = lengths[at]
            exact = partner == room
            two = len(smallest) < 2 or smallest[0] + smallest[1] > room
            three = len(smallest) < 3 or sum(smallest[:3]) > room
            if not (exact or two or (three and _largest_pair(lengths, left, a, room) <= partner)):
                break
            times = left[a] // 2 if partner == a else min(left[a], left[partner])
            if not (exact or two):
                times = 1
            take((a, partner), times)
    return fixed, left


def _largest_pair(lengths: list[int], left: dict[int, int], a: int, room: int) -> int:
    """The largest total, within ``room``, of two lengths beside one ``a``."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or (i == j and left[lengths[i]] - (lengths[i] == a) < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns of (length, number) with how many sequences have them: best fit, longest first."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((pattern, times))

    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, pattern = capacity, ()
                times = -(-left // (capacity // size))
            most = room // size
            full = min(times, left // most)
            put(room - most * size, (*pattern, (size, most)), full)
            left -= full * most
            if full < times:
                rest = left if left < most else 0
                if rest:
                    put(room - rest * size, (*pattern, (size, rest)), 1)
                    left = 0
                put(room, pattern, times - full - (1 if rest else 0))
    return [group for groups in open_.values() for group in groups]


def planned(sizes: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first number, per sequence, first sequence, offset), sorted by length and first number.

    The pieces of a length are numbered from 0. From the first number of a row on, so many in turn go to
    each sequence from the first one on, one behind the other from the offset on.
    """
    fixed, left = reduced(sizes, capacity)
    patterns: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for members, times in fixed:
        if len(set(members)) < len(members):
            patterns.append((((members[0], len(members)),), times))
        else:
            patterns.append((tuple((m, 1) for m in members), times))
    patterns += best_fit(left, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        if not pattern:
            continue
        offset = 0
        for size, number in pattern:
            rows.append((size, used.get(size, 0), number, sequence, offset))
            used[size] = used.get(size, 0) + number * times
            offset += size * number
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def packed(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only documents longer than a sequence are cut. Repeated
    rows are packed as often as they come; equal lengths are ordered by id, piece and checksum. An
    empty table gives an empty result.
    """
    found = materialize(token_pieces(id_and_text(docs, id_col, text_col), vocabulary, capacity))
    # At most ``capacity`` rows, whatever the number of documents.
    sizes = {r.length: r.n for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(planned(sizes, capacity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            row = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            inner = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(length),
                    batch.column(4),
                    pa.array(row[:, 3] + inner // row[:, 2]),
                    pa.array(row[:, 4] + inner % row[:, 2] * length),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = numbered(found, "length", ["doc_id", "piece", "ids_crc32"], "rank", buckets=64)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
