import random

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from priceforge.llm import packing
from priceforge.llm.bpe import Fits

PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
CHARACTERS = "abcdelmrstvABCDST'''..-#019éÀȺß½²ªſ…”"


@pytest.fixture(scope="module")
def words():
    return packing.Words(public_tokenizers.path(packing.VOCABULARY))


def made(n: int, longest: int, characters: str = CHARACTERS) -> list[str]:
    draw = random.Random(7)
    return ["".join(draw.choices(characters, k=draw.randint(0, longest))) for _ in range(n)]


def held_against_library(words, texts: list[str]) -> None:
    ids, counts = words.encode([t.encode() for t in texts])
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_short_parts_are_merged_without_asking_pair_by_pair(words, monkeypatch):
    def asked(*_):
        raise AssertionError("a pair of tokens was looked at by itself")

    monkeypatch.setattr(Fits, "_answer", asked)
    held_against_library(words, [" ".join(made(200, 14)), "", "don't we'll they've 'tis rock'n'roll x''s 's's", " \n\t "])


def test_long_parts_and_strange_words_are_mixed_in(words):
    long = made(20, 90, "abcdefgh")
    strange = ["東京", "İstanbul", "éa", "<|endoftext|>", "a b", "😀", "x<|startoftext|>y", " ", "ΑΣ"]
    draw = random.Random(3)
    texts = [" ".join(draw.sample([*long, *strange, *made(30, 9)], 25)) for _ in range(10)]
    held_against_library(words, [*texts, " ".join(strange), "東京", " ".join(long)])


def test_parts_begin_where_the_pattern_has_them():
    text = "\n".join(w for w in made(20_000, 9) if w).lower()
    starts, _ = packing._part_starts(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    assert starts.tolist() == [m.start() for m in PARTS.finditer(text)]


def test_spans_under_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing.Prefixes, "of", lambda self, a, b: np.zeros(len(a), dtype=np.uint64))
    buffer = np.frombuffer(b"aa b aa c", dtype=np.uint8)
    first, last = np.array([0, 3, 5, 8]), np.array([2, 4, 7, 9])
    at, which = packing._distinct(buffer, first, last)
    assert at[which].tolist() == [0, 1, 0, 3]
