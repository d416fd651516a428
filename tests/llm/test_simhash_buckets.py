"""Links through crowded buckets at several distances, against all pairs."""

import random

import pytest

from priceforge.llm import simhash


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_large_buckets_at_other_distances(spark, distance):
    rng = random.Random(distance)
    values = {rng.getrandbits(10) for _ in range(600)}
    values |= {v ^ sum(1 << b for b in rng.sample(range(10, 64), distance)) for v in list(values)[:60]}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()}
    apart = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(apart(a, b) <= distance for a, b in links)
    root = {s: s for s in signed}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    assert all(top(a) == top(b) for a in signed for b in signed if apart(a, b) <= distance)
