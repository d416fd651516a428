"""License scans: exact base phrases and short notices with a bounded number of edits.

Texts become lower-case words with one space between them. A notice of ``k`` allowed edits is split into
``k + 1`` pieces: whatever is within ``k`` edits of it still has one piece unchanged. One Aho-Corasick
automaton finds all pieces of all notices, and the base phrases, in a single pass. Around each piece
found the regex library matches the whole notice with its bounded error; only whole words count, and what it
accepts is reported with its place and its number of edits.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.rolling import pieces

# Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


class Notice(NamedTuple):
    label: str
    words: str
    edits: int


NOTICES = (
    Notice("agpl", "gnu affero general public license", 3),
    Notice("all-rights-reserved", "all rights reserved", 2),
    Notice("apache", "apache license", 1),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("boost", "boost software license", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-nd", "cc by nd", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("epl", "eclipse public license", 2),
    Notice("gpl", "gnu general public license", 2),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("mit", "mit license", 1),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mit", "released under the mit license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("public-domain", "released into the public domain", 3),
    Notice("unlicense", "this is free and unencumbered software", 3),
)

_CHUNK = 1 << 21
#: Bytes that go on with a character of UTF-8.
_CONTINUED = bytes(range(128, 192))
#: Ends a text; the byte occurs in no UTF-8.
_END = 0xFF
#: Lower-case A-Z; what is neither digit, letter nor beyond ASCII parts words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])
_RESULT = (
    ("n_words", pa.int64()),
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(_SPAN)),
)


class Span(NamedTuple):
    label: str
    first_word: int
    n_words: int
    edits: int
    likeness: float


class Found(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]
    spans: list[Span]


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """Offset and text of the ``edits + 1`` pieces of a notice, as equal in length as they can be."""
    cuts = [len(notice.words) * i // (notice.edits + 1) for i in range(notice.edits + 2)]
    return [(a, notice.words[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Finds base phrases and notices in texts."""

    def __init__(self, notices: Sequence[Notice] = NOTICES, base: Sequence[tuple[str, str]] = BASE):
        if any(len(n.words) <= n.edits for n in notices):
            raise ValueError("a notice must be longer than its number of edits")
        self.notices, self.base = list(notices), list(base)
        self.patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n.words)}){{e<={n.edits}}}(?= )") for n in notices]
        meanings: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in seeds(notice):
                meanings.setdefault(piece, []).append((i, offset))
        for i, (phrase, _) in enumerate(self.base):
            meanings.setdefault(f" {phrase} ", []).append((-1 - i, 0))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in meanings.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def scan(self, texts: Sequence[bytes]) -> Iterator[Found]:
        for a, b in pieces(map(len, texts), _CHUNK):
            yield from self._scan(texts[a:b])

    def _scan(self, texts: Sequence[bytes]) -> Iterator[Found]:
        raw = np.frombuffer((b" " + b"".join(t + b" \xff " for t in texts)).translate(_TABLE), dtype=np.uint8)
        space = raw == 32
        space[1:] &= space[:-1]
        space[0] = False
        buffer = raw[~space]
        words = np.flatnonzero(buffer == 32) + 1
        ends = np.flatnonzero(buffer == _END)
        end_words = np.searchsorted(words, ends)
        first_words = np.concatenate([[0], end_words[:-1] + 1]) if len(ends) else end_words
        text = buffer.tobytes()
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        spans: list[list[Span]] = [[] for _ in texts]
        places: dict[int, dict[int, int]] = {}
        for last, (size, uses) in self.automaton.iter(text.decode("latin-1")):
            at = last - size + 1
            for use, offset in uses:
                if use < 0:
                    doc = int(np.searchsorted(ends, at))
                    word = int(np.searchsorted(words, at + 1)) - int(first_words[doc])
                    base[doc].append((word, self.base[-1 - use][1]))
                else:
                    places.setdefault(use, {})[at - offset] = at
        for use, seeded in places.items():
            for begin, end, edits in self._matches(text, use, seeded):
                doc = int(np.searchsorted(ends, begin))
                first, behind = (int(x) for x in np.searchsorted(words, [begin, end]))
                notice = self.notices[use]
                likeness = 1 - edits / len(notice.words)
                spans[doc].append(Span(notice.label, first - int(first_words[doc]), behind - first, edits, likeness))
        for doc in range(len(texts)):
            yield Found(int(end_words[doc] - first_words[doc]), sorted(base[doc]), sorted(spans[doc], key=_order))

    def _matches(self, text: bytes, use: int, seeded: dict[int, int]) -> list[tuple[int, int, int]]:
        """(begin, end, edits) near places where a notice may begin; of overlapping ones that of the fewest edits.

        ``seeded`` has for each place the position of a piece that was found there.
        """
        notice, pattern = self.notices[use], self.patterns[use]
        # An inserted character has up to four bytes; one more for the space beside the notice.
        reach = 4 * notice.edits + 1
        found = {}
        for begin, seed in seeded.items():
            left = max(0, begin - reach, text.rfind(b"\xff", max(0, begin - reach), seed) + 1)
            right = begin + len(notice.words) + reach
            stop = text.find(b"\xff", seed, right)
            window = text[left : right if stop < 0 else stop]
            cut = len(window) - len(window.lstrip(_CONTINUED))
            decoded = window[cut:].decode("utf-8", "ignore")
            match = pattern.search(decoded)
            if match:
                start = left + cut + len(decoded[: match.start()].encode())
                found[start, start + len(match.group().encode())] = sum(match.fuzzy_counts)
        taken: list[tuple[int, int, int]] = []
        for (start, end), edits in sorted(found.items(), key=lambda x: (x[1], x[0])):
            i = bisect(taken, (start, end, edits))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, edits))
        return taken


def _order(span: Span) -> tuple:
    return span.first_word, span.label, span.n_words, span.edits


def license_scan(
    docs: DataFrame, notices: Sequence[Notice] = NOTICES, base: Sequence[tuple[str, str]] = BASE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One row per row of ``docs``, those with a null id or repeated ones too; a null text is empty. Words count
    from 0. ``base_labels`` and ``labels`` are empty strings where nothing is found. ``score`` is 1 with a base
    phrase, else the likeness of the best notice, 1 - edits / its length, or 0. ``spans`` holds what the
    notices matched: label, first_word, n_words, edits. Matches of one notice do not overlap, matches of
    different notices may. An empty table gives an empty result; other columns are not looked at.
    """

    def run(batches):
        scanner = Scanner(notices, base)
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            out: list[list] = [[] for _ in _RESULT]
            for found in scanner.scan(texts):
                starts = [w for w, _ in found.base]
                own = {label for _, label in found.base}
                likeness = max((s.likeness for s in found.spans), default=0.0)
                row = (
                    found.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                    ",".join(sorted(own | {s.label for s in found.spans})), 1.0 if own else likeness,
                    [{"label": s.label, "first_word": s.first_word, "n_words": s.n_words, "edits": s.edits} for s in found.spans],
                )
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(c, kind) for c, (_, kind) in zip(out, _RESULT)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(n for n, _ in _RESULT)])

    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label string, first_word long, n_words long, edits int>>",
    )
