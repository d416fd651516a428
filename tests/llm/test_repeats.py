"""Recurring strings and phrases against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from priceforge.llm import phrase_dedup, suffix_dedup

SMALL = Path("/root/testdata/sf0.001")


def brute(units, threshold):
    seen = Counter(tuple(u[i : i + threshold]) if not isinstance(u, bytes) else u[i : i + threshold]
                   for u in units for i in range(len(u) - threshold + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - threshold + 1):
            w = u[i : i + threshold]
            if seen[w if isinstance(w, bytes) else tuple(w)] > 1:
                gone[i : i + threshold] = [True] * threshold
        out.append(gone)
    return out


def brute_bytes(texts, threshold):
    units = [(t or "").encode() for t in texts]
    for u, gone in zip(units, brute(units, threshold), strict=True):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        yield len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def awkward(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = [line(60) for _ in range(5)]
    texts = [None, "", " ", "a", "ab" * 400, "a" * 900, "x " * 300, "a" * 199, line(3000)]
    for _ in range(40):
        parts = [line(rng.randint(0, 80)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        texts.append("\n\t".join(parts))
    cut = shared[0]
    texts += [cut[20:], cut[:-30], cut[5:260], line(40) + cut[10:215] + line(30), texts[-1], texts[-1]]
    edited = list(texts[20])
    edited[len(edited) // 2] = "#"
    return [*texts, "".join(edited)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("threshold", [200, 30])
def test_bytes_match_brute_force(spark, threshold):
    texts = awkward()
    found = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.removed(frame(spark, texts), threshold).collect()}
    assert [found[i] for i in range(len(texts))] == list(brute_bytes(texts, threshold))


def test_bytes_of_the_small_table(spark):
    from priceforge.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in QUERIES["op2_suffix_array_dedup"](spark, str(SMALL)).collect()}
    for row, (n, gone, runs, digest) in zip(rows, brute_bytes([r.text for r in rows], 200), strict=True):
        r = found[row.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, runs, digest)


def test_slices_of_a_long_text_change_nothing(spark, monkeypatch):
    from priceforge.llm import repeats

    texts = awkward(8)
    units = [(t or "").encode() for t in texts]
    monkeypatch.setattr(repeats, "_SLICE", 97)
    values, sizes = repeats.byte_units(units)
    covered = 0
    for _, _, n, _, _, _ in repeats.runs_of(values, sizes, 50):
        covered += int(n.sum())
    assert covered == sum(max(0, len(u) - 49) for u in units)


def test_repeated_rows_empty_table_and_other_columns(spark):
    text = " ".join(map(str, range(300)))
    docs = spark.createDataFrame(
        [(1, text, "a", 5), (1, text, "a", 5), (2, None, "b", 0), (None, text, "c", 1)],
        "doc_id long, text string, sig string, lo int",
    )
    rows = suffix_dedup.removed(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes - r.n_removed) for r in rows] == [(1, 0), (1, 0), (2, 0)]
    assert suffix_dedup.removed(docs.limit(0)).collect() == []


def test_pipeline_form_replaces_texts(spark):
    passage = " ".join(f"p{i}" for i in range(100))
    docs = spark.createDataFrame(
        [(1, "ü " + passage + " one", "en", 9), (2, passage, "de", 9), (3, None, None, None), (4, "alone", "en", 5)],
        "doc_id long, text string, lang string, n_chars long",
    )
    kept = suffix_dedup.without_repeated_strings(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[1].text == "ü  one" and rows[1].n_chars == 6
    assert rows[2].text == "" and rows[2].n_chars == 0 and rows[2].lang == "de"
    assert rows[3].text is None and rows[4].text == "alone" and re.fullmatch("alone", rows[4].text)


def brute_words(texts, window):
    units = [(t or "").encode().split() for t in texts]
    for u, gone in zip(units, brute(units, window), strict=True):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        yield len(u), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("window", "ids"), [(35, 1 << 21), (7, 1 << 21), (20, 50)])
def test_words_match_brute_force(spark, monkeypatch, window, ids):
    monkeypatch.setattr(phrase_dedup, "AUTOMATON_IDS", ids)
    monkeypatch.setattr(phrase_dedup, "SHARD_STRETCHES", 2)
    texts = awkward()
    found = {r.doc_id: tuple(r)[1:4] for r in phrase_dedup.removed(frame(spark, texts), window).collect()}
    assert [found[i] for i in range(len(texts))] == list(brute_words(texts, window))


def test_words_of_the_small_table(spark):
    from priceforge.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in QUERIES["op8_substring_dedup"](spark, str(SMALL)).collect()}
    for row, expected in zip(rows, brute_words([r.text for r in rows], 35), strict=True):
        r = found[row.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == expected
    assert any(r.n_removed for r in found.values())


def test_words_of_repeated_rows_and_an_empty_table(spark):
    text = " ".join(map(str, range(50)))
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "  ")], "doc_id long, text string")
    rows = phrase_dedup.removed(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in rows] == [(1, 50, 50), (1, 50, 50), (2, 0, 0), (3, 0, 0)]
    assert phrase_dedup.removed(docs.limit(0)).collect() == []
