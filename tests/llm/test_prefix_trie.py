"""Prefix tries against rebuilt lists of turns."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from priceforge.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, depth int, f string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute(rows):
    nodes = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append((c, len(turns) == d))
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        saved[key] = (len(nodes[key]) - 1) * words + sum(saved[k] for k in children[key])
    first = {key: min(c for c, _ in members) for key, members in nodes.items()}
    out = []
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        out.append(
            (first[key], len(key), first[key[:-1]] if key else None, len(members), len(children[key]), leaves[key], saved[key],
             hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in p.prefix_trie(df).collect()), key=str)


def conversations(n, seed, longest=6):
    """Few different texts, so that many prefixes are shared by copies as well as by rebuilding."""
    rng = random.Random(seed)
    texts = ["", "a", "a b", " b  a\t", "c d \x0be", "long " * 9]
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


def test_equals_rebuilt_lists(spark):
    rows = conversations(120, 1)
    assert trie(spark, rows) == brute(rows)


def test_nulls_ties_repeats_negative_ids_and_absent_bases(spark):
    rows = conversations(60, 2)
    rows += [(c, t, None, x) for c in (-5, -20, -21, 1000, 1003) for t, x in ((None, "n"), (0, None), (0, "z"), (0, "b"), (None, None))]
    rows += [(41, 2, "user", "a")] * 4 + [(None, 1, "user", "a")] * 3
    assert trie(spark, rows) == brute(rows)


def test_one_conversation_and_one_prefix_hold_most_rows(spark):
    rows = conversations(30, 3)
    rows += [(20, 10 + t, "user", f"t{t % 50}") for t in range(1500)]
    rows += [(c, t, "user", f"same {t}") for c in range(2000, 2300) for t in range(3)]
    assert trie(spark, rows) == brute(rows)


def test_stretches_of_depth_are_summed_together(spark, monkeypatch):
    monkeypatch.setattr(p, "_STRETCH", 3)
    rows = [(c, t, "user", f"t{t} x y") for c in (0, 1, 2, 40, 41) for t in range(11 - c % 20)]
    assert trie(spark, rows) == brute(rows)


def test_turnless_conversation_and_empty_table(spark):
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(turnless, 0, "user", "a"), (turnless, 1, "user", "b")]
    assert trie(spark, rows) == brute(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert trie(spark, []) == []


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    """With primes that small every attempt finds unlike prefixes under one fingerprint."""
    primes = (5, 7)
    monkeypatch.setattr(p, "PRIMES", primes)
    monkeypatch.setattr(p, "BASES", (2, 3))
    monkeypatch.setattr(p, "INVERSES", tuple(pow(b, -1, q) for b, q in zip((2, 3), primes)))
    monkeypatch.setattr(p, "ATTEMPTS", 2)
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 2000, 20) for t in range(2)]
    with pytest.raises(RuntimeError, match="shared a fingerprint"):
        trie(spark, rows)


def test_a_fingerprint_composes_from_its_parts():
    import pandas as pd

    rng = random.Random(9)
    turns = [[rng.randrange(q) for _ in range(20)] for q in p.PRIMES]

    def element(a, b):
        h, w = [], []
        for k, q in enumerate(p.PRIMES):
            value = 0
            for t in turns[k][a:b]:
                value = (value * p.BASES[k] + t) % q
            h.append(value)
            w.append(pow(p.BASES[k], b - a, q))
        return h, w

    runs = []
    for part, (a, b) in enumerate([(0, 1), (1, 8), (8, 20)]):
        (h1, h2), (w1, w2) = element(a, b)
        runs.append({"conv_id": 3, "part": part, "n": b - a, "h1": h1, "h2": h2, "w1": w1, "w2": w2})
    last = p._composed(pd.DataFrame(runs)).iloc[-1]
    (h1, h2), (w1, w2) = element(0, 8)
    assert [last["n0"], last["g1"], last["g2"], last["b1"], last["b2"]] == [8, h1, h2, w1, w2]
    assert [int(x) for x in p.powers(p.BASES[0], p.PRIMES[0], 7)] == [pow(p.BASES[0], i, p.PRIMES[0]) for i in range(7)]
