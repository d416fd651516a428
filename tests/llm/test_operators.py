"""The corpus operators against brute force, the tokenizer libraries and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from priceforge.llm import (
    exact_dedup,
    fingerprints,
    packing,
    quality,
    sentencepiece_codec,
    sharding,
    simhash,
    token_counts,
)
from priceforge.llm.corpus import documents

SMALL = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, fp long, salt int, task int, text_sha256 string, shard string, length int"


def awkward(seed=7):
    rng = random.Random(seed)
    words = ["the", "House", "prices", "straße", "日本語", "naïve", "it's", "we'll", "42", "3.14", "don't", "▁x", "a-b", "😀", "Ω"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    texts = [
        None, "", " ", "\n", "\t \x0b\x0c\r\n", "a", "A", " a", "a ", "a  b", "a b", "a\n\nb", "a b", "  leading", "trailing  ",
        " ", "é", "é", "<|endoftext|>", "x<|endoftext|>y", "<s>", "</s>", "<|startoftext|>Hi", "▁", "▁▁ a",
        "\x00", "a\x00b", "\x1c\x1d", "\x85", "﻿bom", "'S 'LL 'tis", "a" * 5000, "ab " * 3000, "\n" * 700, " " * 900, "1234567890" * 300,
        "日本語" * 900, "😀" * 500, "日本 語\n  x\t\ty   z", "HELLO World",
    ]
    texts += [line(rng.randint(1, 60)) for _ in range(60)] + [line(9000)]
    base = line(400).split(" ")
    for _ in range(12):
        changed = list(base)
        changed[rng.randrange(len(base))] = "#"
        texts.append(" ".join(changed))
    texts += [" ".join(base), "\n".join(base), " ".join(base)] + ["same text"] * 30
    return texts


TEXTS = awkward()


def frame(spark, texts=TEXTS, first=0):
    """With columns whose names the operators use inside, null in half the rows."""
    rows = [(first + i, t, None if i % 2 else i, i, None, "x", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, FIELDS).repartition(4)


def by_id(df):
    rows = df.collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


OPERATORS = {
    "exact": exact_dedup.exact_duplicates,
    "sentencepiece": sentencepiece_codec.coded,
    "tokens": token_counts.token_counts,
    "simhash": simhash.near_duplicates,
    "fingerprints": fingerprints.edited_fingerprints,
    "packing": packing.packed,
    "sharding": sharding.differenced_shards,
    "quality": lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_single_and_repeated_rows(spark, name):
    run = OPERATORS[name]
    assert run(frame(spark, [])).collect() == []
    assert [r.doc_id for r in run(frame(spark, [None], 5)).collect()] == [5]
    twice = frame(spark, ["x y z", "x y z", None])
    rows = run(twice.unionByName(twice)).collect()
    assert Counter(r.doc_id for r in rows) == {0: 2, 1: 2, 2: 2}
    nameless = twice.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted(r.doc_id for r in run(nameless).collect()) == [1, 2]


def test_exact_duplicates(spark):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    found = by_id(exact_dedup.exact_duplicates(frame(spark)))
    for i, t in enumerate(norm):
        own = groups[t]
        assert tuple(found[i]) == (i, own[0], len(own), i == own[0], hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.without_exact_duplicates(frame(spark).unionByName(frame(spark)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in groups.values())


def test_each_text_of_an_id_is_judged_by_itself(spark):
    rows = [(5, "A", "x"), (3, "C", "y"), (5, "C", "z"), (7, "B  b", "u"), (7, "B b", "v"), (None, "A", "w"), (9, None, ""), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sha0 string")
    kept = exact_dedup.without_exact_duplicates(docs).collect()
    got = sorted(((r.doc_id or 0, " ".join((r.text or "").split())) for r in kept))
    assert got == [(0, "A"), (3, "C"), (4, ""), (5, "A"), (7, "B b")]
    assert {r._sha0 for r in kept} - {"u", "v"} == {"w", "y", "", "x"} and kept[0].__fields__ == docs.columns


def test_sentencepiece_equals_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [model.encode(t or "") for t in TEXTS]
    found = by_id(sentencepiece_codec.coded(frame(spark)))
    for i, own in enumerate(ids):
        assert found[i].n_tokens == len(own), TEXTS[i]
        assert found[i].ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        assert found[i].decoded_sha256 == hashlib.sha256(model.decode(own).encode()).hexdigest()
        assert found[i].round_trip == (model.decode(own) == (TEXTS[i] or ""))


def test_token_counts_equal_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(token_counts.token_counts(frame(spark)))
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(found[i])[:4] == (i, len((t or "").encode()), n, n > 1024), t


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, distance=2):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(values))]


def test_simhash_components(spark):
    values = [brute_simhash(t) for t in TEXTS]
    roots = components(values)
    found = by_id(simhash.near_duplicates(frame(spark)))
    for i, v in enumerate(values):
        assert tuple(found[i])[:3] == (i, f"{v:016x}", roots[i]), TEXTS[i]
    kept = simhash.without_near_duplicates(frame(spark))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))


@pytest.mark.parametrize("free", [12, 40, 64])
def test_links_reach_what_all_pairs_reach(spark, free):
    """Few free bits crowd the buckets, so the way for large ones is taken too."""
    rng = random.Random(free)
    values = list({rng.getrandbits(free) for _ in range(500)})
    for v in values[:100]:
        values.append(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert all((values[at[r.a]] ^ values[at[r.b]]).bit_count() <= 2 for r in links)
    reach = {i: {i} for i in range(len(values))}
    for r in links:
        a, b = reach[at[r.a]], reach[at[r.b]]
        if a is not b:
            a |= b
            for x in b:
                reach[x] = a
    assert [min(reach[i]) for i in range(len(values))] == components(values)


def test_thresholds_obey_the_pigeonhole():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500.0)
    for distance in (1, 2, 3):
        chosen = simhash.plan(1000, together, distance)
        assert sorted(b for bits, _ in chosen for b in bits) == list(range(64))
        assert sum(t for _, t in chosen) == distance - len(chosen) + 1


def test_edited_fingerprints(spark):
    found = by_id(fingerprints.edited_fingerprints(frame(spark)))
    prints = defaultdict(set)
    for i, t in enumerate(TEXTS):
        own, following = t or "", TEXTS[i - 1] or ""  # falling ids; after 0 comes the last
        n = len(own) // 3
        edited = own[: len(own) - n] + following[:n]
        row = found[i]
        assert row.n_chars == len(own)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        prints[own].add(row.fingerprint)
        prints[edited].add(row.edited_fingerprint)
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if own == edited:
            assert row.near_edited == 1
        if own == following:
            assert row.near_next == 1
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_differing_branches_are_located():
    paragraphs = [f"Paragraph {i} says {i * i}." for i in range(40)]
    changed = list(paragraphs)
    changed[17] = "Something else."
    a, b = fingerprints.fingerprints(["\n\n".join(p).encode() for p in (paragraphs, changed)])
    assert a != b and fingerprints.differing(a, a) == []
    assert len(fingerprints.differing(a, b)) >= 1
    assert 0.5 < fingerprints.likeness(a, b) < 1


def sequences_are_sound(rows, capacity=2048):
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for members in placed.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def first_fit(lengths, capacity=2048):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= n), None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


def test_packing(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.packed(frame(spark)).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    expected = 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], dtype="<u4")
            row = pieces[i, piece]
            assert (row.start, row.length, row.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes())), t
            expected += 1
    assert expected == len(rows)
    lengths = [r.length for r in rows]
    used = sequences_are_sound(rows)
    assert -(-sum(lengths) // 2048) <= used <= first_fit(lengths)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_no_worse_than_first_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 100, 2048])
    sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400)))
    table = packing.planned(dict(sizes), capacity)
    assert {int(n) for n in table[:, 0]} == set(sizes)
    lengths = list(sizes.elements())
    assert int(table[:, 3].max()) + 1 <= len(lengths)
    fill = Counter()
    for at, row in enumerate(table):
        size, first, per, sequence, _ = map(int, row)
        last = int(table[at + 1][1]) if at + 1 < len(table) and table[at + 1][0] == size else sizes[size]
        for k in range(last - first):
            fill[sequence + k // per] += size
    assert sum(fill.values()) == sum(lengths) and max(fill.values()) <= capacity
    assert len(fill) <= first_fit(lengths, capacity)


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(documents(spark, sf), labels).join(labels.select("doc_id", "quality"), "doc_id")
    rows = scored.where("quality is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    ones = np.array([r.score for r in held if r.quality == 1])
    zeros = np.array([r.score for r in held if r.quality == 0])
    above = (ones[:, None] > zeros[None, :]).mean() + (ones[:, None] == zeros[None, :]).mean() / 2
    print("held out", len(held), "AUC", above, "accuracy", np.mean([r.predicted == r.quality for r in held]))
    assert above > 0.8


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = documents(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = (quality.fit_quality(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_shards(spark):
    rows = sharding.differenced_shards(frame(spark)).collect()
    shard_of, sums, slots = {}, Counter(), defaultdict(list)
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < 16
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(TEXTS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weights = Counter()
    for t in TEXTS:
        weights[(t or "").encode()] += len((t or "").encode()) + 1
    # Longest first onto the lightest shard.
    greedy = [0] * 16
    for w in sorted(weights.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += w
    assert max(sums.values()) <= max(greedy)


def test_differencing_over_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 8)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdef ", k=rng.randint(1, 300))) for _ in range(900)]
    sums = Counter()
    for r in sharding.differenced_shards(frame(spark, texts)).collect():
        sums[r.shard] += r.size
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 300
