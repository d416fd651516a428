"""Token counts of whole texts and of all their prefixes, with a byte-level vocabulary.

The pre-tokenizer cuts a text into words. For each distinct word one pass over its prefixes stores
the number of tokens of every prefix. The count of a text is a sum over its words, and a budget is
answered from the stored counts without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.llm.bpe import Fits, Segmenter, byte_alphabet
from priceforge.llm.corpus import id_and_text
from priceforge.llm.rolling import pieces

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
_CHUNK = 1 << 21
_UNITS = 1 << 18
#: Words whose counts a worker remembers between batches.
_REMEMBERED = 500_000
_ODD_SPACE = regex.compile(r"[^\S\n ]|\S ")
_WORDS = regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Exact token counts for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()

        def raw(text: str) -> bytes:
            return bytes(alphabet[c] for c in text)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        vocabulary = {raw(t): i for t, i in names.items()}
        tokens = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for text, i in vocabulary.items():
            tokens[i] = text
        merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(spec["model"]["merges"])}
        fits = Fits(tokens, lambda text: [text[i : i + 1] for i in range(len(text))], lambda a, b: merges.get((a, b)))
        self.segment = Segmenter(vocabulary, fits)
        self._specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return _WORDS.findall(text)

    def _totals(self, words: list[str]) -> dict[str, int]:
        distinct = list(dict.fromkeys(words))
        raw = [w.encode() for w in distinct]
        out: dict[str, int] = {}
        for a, b in pieces(map(len, raw), _UNITS):
            out.update(zip(distinct[a:b], self.segment(raw[a:b]).totals().tolist()))
        return out

    def _parts(self, text: str) -> tuple[list[str], int]:
        """The words of a text, and how many special strings stand between them."""
        if self._specials is None:
            return self.words(text), 0
        between = self._specials.split(text)
        return [w for part in between for w in self.words(part)], len(between) - 1

    def _learn(self, units: list[str]) -> None:
        # Units without white space behind their first character are cut together, a line break between two.
        plain = [u for u in units if "\n" not in u and u != " "]
        text = "\n".join(plain)
        if _ODD_SPACE.search(text):
            plain, text = [], ""
        rest = units if not plain else [u for u in units if "\n" in u or u == " "]
        parts = [self.words(u) for u in rest]
        joined = self.words(text)
        totals = self._totals([w for p in parts for w in p] + joined)
        for unit, part in zip(rest, parts):
            # Two low bits: white at the start (behind the space) and at the end.
            edges = (not unit.strip() or unit[1:2].isspace()) + 2 * unit[-1:].isspace()
            self._known[unit] = 4 * sum(map(totals.__getitem__, part)) + edges
        if plain:
            totals["\n"] = 0
            counts = np.fromiter(map(totals.__getitem__, joined), np.int64, len(joined))
            breaks = np.fromiter(("\n" == w for w in joined), bool, len(joined))
            begins = np.concatenate([[0], np.flatnonzero(breaks) + 1])
            self._known.update(zip(plain, (4 * np.add.reduceat(counts, begins)).tolist()))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text.

        A text is cut before single spaces and the cuts are counted apart, which is exact unless white
        space meets white space at a cut or a special string is near; such texts are counted whole.
        """
        out = np.zeros(len(texts), dtype=np.int64)
        for a, b in pieces(map(len, texts), _CHUNK):
            self._count(texts, a, b, out)
        return out

    def _count(self, texts: list[str], a: int, b: int, out: np.ndarray) -> None:
        plain, units, sizes, whole = [], [], [], []
        for d in range(a, b):
            text = texts[d]
            if "\0" in text or any(s in text for s in self.special):
                whole.append(d)
            elif text:
                own = text.replace(" ", "\0 ").split("\0")
                if not own[0]:
                    del own[0]
                plain.append(d)
                units += own
                sizes.append(len(own))
        if plain:
            distinct = set(units)
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            self._learn([u for u in distinct if u not in self._known])
            values = np.fromiter(map(self._known.__getitem__, units), np.int64, len(units))
            ends = np.cumsum(sizes)
            begins = ends - sizes
            meets = np.zeros(len(values), dtype=np.int64)
            meets[1:] = ((values[:-1] & 2) > 0) & ((values[1:] & 1) > 0)
            meets[begins] = 0
            totals = np.add.reduceat(values >> 2, begins)
            unsafe = np.add.reduceat(meets, begins) > 0
            out[plain] = totals
            whole += [plain[i] for i in np.flatnonzero(unsafe)]
        for d in whole:
            words, specials = self._parts(texts[d])
            totals = self._totals(words)
            out[d] = sum(map(totals.__getitem__, words)) + specials

    def prefix_counts(self, text: str) -> np.ndarray:
        """``counts(text[:i])`` for every i from 0 to the length of the text, from one pass over it."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base, at = 0, 0
        between = self._specials.split(text) if self._specials is not None else [text]
        marks = self._specials.findall(text) if self._specials is not None else []
        for part, mark in zip(between, [*marks, ""]):
            self._prefixes(part, out, at, base)
            at += len(part)
            base = int(out[at])
            if mark:
                # A part of a special string is ordinary text behind the part before it.
                for i in range(1, len(mark)):
                    words = self.words(part + mark[:i])
                    totals = self._totals(words)
                    out[at + i] = out[at - len(part)] + sum(map(totals.__getitem__, words))
                at += len(mark)
                base += 1
                out[at] = base
        return out

    def _prefixes(self, text: str, out: np.ndarray, at: int, base: int) -> None:
        words = self.words(text)
        runs = [m.span() for m in regex.finditer(r"\s+", text)]
        relaxed = self.segment([w.encode() for w in words] + [text[a:b].encode() for a, b in runs])
        i = at
        ends = {0: base}
        for u, word in enumerate(words):
            counts = relaxed.count[relaxed.offsets[u] :]
            width = 0
            for k, char in enumerate(word):
                width += len(char.encode())
                out[i + k + 1] = base + counts[width]
                if word[0] == "'" and 0 < k < len(word) - 1:
                    # Only whole contractions are cut off behind the apostrophe with their letters.
                    out[i + k + 1] = base + sum(self._totals(self.words(word[: k + 1])).values())
            i += len(word)
            base += int(counts[width])
            ends[i - at] = base
        for r, (a, b) in enumerate(runs):
            # White space at the end of a prefix is one word, whatever follows it in the text.
            counts = relaxed.count[relaxed.offsets[len(words) + r] :]
            width = 0
            for k in range(a, b):
                width += len(text[k].encode())
                out[at + k + 1] = ends[a] + counts[width]

    def longest_within(self, text: str, budget: int) -> int:
        """The most characters of ``text`` from its start that have at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Special strings inside a text count as their one token. A null or empty text has no token;
    repeated rows give repeated rows, an empty table an empty result.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counter(path).counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
