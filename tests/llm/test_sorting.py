"""What segmentation sorts: suffixes against Python's order, and places only once."""

import numpy as np
import pytest

from priceforge.llm import bpe
from priceforge.llm.sentencepiece_codec import SuffixArray


@pytest.mark.parametrize("text", [b"banana\xff" * 40, bytes(range(1, 200)), b"abcdefgh" * 30 + b"\xff", b"a"])
@pytest.mark.parametrize("depth", [5, 8, 20])
def test_suffixes_are_in_the_order_of_their_bytes(text, depth):
    order = SuffixArray(np.frombuffer(text, np.uint8), depth).order
    padded = text + b"\xff" * 64
    cut = [padded[i : i + 8 * -(-depth // 8)] for i in order]
    assert sorted(order) == list(range(len(text)))
    assert cut == sorted(cut)


def test_places_are_sorted_once(monkeypatch):
    """The longest fitting token settles a place, and no step sorts the edges that are left again."""
    tokens = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}
    merges = {(b"a", b"b"): 0, (b"ab", b"a"): 1}
    fits = bpe.Fits(list(tokens), lambda t: [t[i : i + 1] for i in range(len(t))], lambda a, b: merges.get((a, b)))
    unique = np.unique

    def asked(values, **settings):
        assert "return_index" not in settings
        return unique(values, **settings)

    monkeypatch.setattr(np, "unique", asked)
    found = bpe.Segmenter(tokens, fits)([b"ab", b"abab", b"bba", b""])
    assert found.totals().tolist() == [1, 2, 3, 0]
    assert found.paths()[0].tolist() == [2, 2, 2, 1, 1, 0]
