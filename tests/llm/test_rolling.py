"""Substring hashes: the same for equal substrings, different for unlike ones, however regular."""

import random

import numpy as np
import pytest

from priceforge.llm import fingerprints, phrase_dedup, suffix_dedup
from priceforge.llm.rolling import Prefixes


def thue_morse(n, a=b"a", b=b"b"):
    return b"".join(b if bin(i).count("1") % 2 else a for i in range(n))


def hashes(buffer, spans):
    at = np.array(spans, dtype=np.int64)
    return Prefixes(buffer).of(at[:, 0], at[:, 1]).tolist()


@pytest.mark.parametrize("words", [False, True])
def test_hash_depends_on_the_content_alone(words):
    rng = np.random.default_rng(1)
    part = rng.integers(0, 3, 400).astype(np.uint8)
    buffer = np.concatenate([part, rng.integers(0, 3, 77).astype(np.uint8), part, part[:5]])
    if words:
        buffer = buffer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spans = [(a, b) for a in range(0, 400, 7) for b in range(a, min(a + 40, 401))]
    spans += [(a, 400) for a in range(0, 400, 13)]
    here = hashes(buffer, spans)
    assert here == hashes(buffer, [(a + 477, b + 477) for a, b in spans])
    by_content = {}
    for (a, b), h in zip(spans, here):
        assert by_content.setdefault(buffer[a:b].tobytes(), h) == h
    assert len(set(by_content.values())) == len(by_content)


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096, 16384])
def test_regular_words_and_their_complements_differ(n):
    for a, b in ((b"a", b"b"), (b"\x00", b"\xff"), (b"ab", b"ba"), (b"abcdefgh", b"hgfedcba"), (b"x" * 16, b"y" * 16)):
        one, other = thue_morse(n, a, b), thue_morse(n, b, a)
        h = [hashes(np.frombuffer(t, np.uint8), [(0, len(t))])[0] for t in (one, other)]
        assert h[0] != h[1]
    ids = np.array([7, 9], dtype=np.uint64)[[bin(i).count("1") % 2 for i in range(n)]]
    assert hashes(ids, [(0, n)]) != hashes(np.uint64(16) - ids, [(0, n)])


def test_short_and_empty_substrings():
    buffer = np.frombuffer(b"\x00\x00\x00a\x00a\x00\x00", np.uint8)
    spans = [(0, 0), (0, 1), (0, 2), (0, 3), (3, 4), (3, 5), (8, 8), (3, 8)]
    h = hashes(buffer, spans)
    assert h[0] == h[6] and len(set(h)) == len(spans) - 1
    assert hashes(np.zeros(0, dtype=np.uint8), [(0, 0)]) == [h[0]]


def regular_texts():
    """Two documents that share no window but for words that a sum over bytes cannot tell apart."""
    rng = random.Random(5)
    filler = [[f"w{rng.randrange(10**9)}" for _ in range(17)] for _ in range(2)]
    words = (thue_morse(2048).decode(), thue_morse(2048, b"b", b"a").decode())
    same = [" ".join([*filler[0], w, *filler[1]]) for w in words]
    return same


def test_operators_tell_regular_texts_apart(spark):
    texts = regular_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in phrase_dedup.removed(docs).collect()] == [0, 0]
    raw = [t.encode() for t in (thue_morse(2048).decode(), thue_morse(2048, b"b", b"a").decode())]
    assert len(set(fingerprints.fingerprints(raw))) == 2
    # Long enough parts of the two words do recur, so bytes go by brute force.
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.removed(docs).collect()}
    starts = {}
    for d, t in enumerate(texts):
        b = t.encode()
        for i in range(len(b) - 199):
            starts.setdefault(b[i : i + 200], []).append((d, i))
    want = {0: set(), 1: set()}
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                want[d].update(range(i, i + 200))
    assert removed == {d: len(s) for d, s in want.items()}
