import random
import tracemalloc

import numpy as np

from priceforge.llm import quality


def test_examples_give_back_what_they_were_made_of():
    rng = np.random.default_rng(5)
    for n, most in ((0, 1), (1, 1 << quality.BITS), (5000, 1 << quality.BITS), (70_000, 2), (3000, 1 << 16)):
        buckets = rng.integers(0, most, n)
        rows, counts = np.unique(buckets, return_counts=True)
        found, weights = quality._Example(buckets).weighted()
        assert found.tolist() == rows.tolist()
        assert weights.dtype == np.float32
        assert weights.tolist() == (counts / max(1, n)).astype(np.float32).tolist()


def test_training_holds_little_on_the_driver(monkeypatch):
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["".join(draw.choices(letters, k=9)) + " " for _ in range(50_000)]
    docs = [" ".join(draw.choices(texts, k=1000)).encode() for _ in range(300)]
    monkeypatch.setattr(quality, "EPOCHS", 1)
    tracemalloc.start()
    try:
        quality.train(docs, [i % 2 for i in range(len(docs))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12 * sum(map(len, docs))
