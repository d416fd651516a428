"""License scans against a word-by-word search and edit distances over all runs of words."""

import random
import re

import pytest

from priceforge.llm.license_scan import BASE, NOTICES, Notice, Scanner, license_scan, seeds

SCHEMA = "doc_id long, text string, labels string, words int"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base_places(text):
    words = words_of(text)
    return sorted(
        (i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def labels_by_distance(text, notices):
    """Labels of notices that some run of whole words is near enough to."""
    words, out = words_of(text), set()
    for notice in notices:
        size = len(notice.words)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if len(run) > size + notice.edits:
                    break
                if len(run) >= size - notice.edits and distance(run, notice.words) <= notice.edits:
                    out.add(notice.label)
    return out


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("aexyzé語 ")
        elif kind == 1:
            chars.insert(at, rng.choice("aexyzé語 "))
        else:
            del chars[at]
    return "".join(chars)


def noisy_texts(n, seed):
    rng = random.Random(seed)
    filler = ["the", "License", "public", "a", "Größe", "日本", "under", "by", "CC", "gnu", "MIT", "general", "x9", "--", "\n"]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 6))]
            notice = rng.choice(NOTICES)
            parts.append(edited(rng, notice.words, rng.randint(0, notice.edits + 2)))
            parts += [rng.choice(filler) for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice([" ", "\t", ", "]).join(parts))
    return texts


def test_notices_equal_edit_distances():
    texts = noisy_texts(150, 1)
    found = list(Scanner().scan([t.encode() for t in texts]))
    hits = 0
    for text, f in zip(texts, found):
        want = labels_by_distance(text, NOTICES)
        assert {s.label for s in f.spans} == want, text
        hits += len(want)
        words = words_of(text)
        for s in f.spans:
            run = " ".join(words[s.first_word : s.first_word + s.n_words])
            near = [n for n in NOTICES if n.label == s.label and distance(run, n.words) == s.edits <= n.edits]
            assert near, (text, s)
    assert hits > 100


def test_base_phrases_equal_a_word_by_word_search():
    texts = noisy_texts(300, 2) + ["", "cc by", "CC-BY cc/by cc by", "mit license mit License", "gnu general public licenses", "apache\x7flicense", "xcc by", "ccby"]
    for text, f in zip(texts, Scanner().scan([t.encode() for t in texts])):
        assert (f.n_words, f.base) == (len(words_of(text)), base_places(text))


def test_seeds_are_the_notice_and_one_more_than_its_edits():
    for notice in NOTICES:
        own = seeds(notice)
        assert len(own) == notice.edits + 1
        assert "".join(p for _, p in own) == notice.words
        assert all(notice.words[o : o + len(p)] == p for o, p in own)


def test_matches_do_not_cross_texts_nor_stop_inside_words():
    scanner = Scanner([Notice("n", "alpha beta gamma", 2)], [])
    texts = ["alpha beta", "gamma", "xxalpha beta gamma", "alpha beta gammaxx", "alphabeta gamma", "alpha beta gamma alpha beta gama"]
    spans = [[(s.first_word, s.n_words, s.edits) for s in f.spans] for f in scanner.scan([t.encode() for t in texts])]
    assert spans == [[], [], [(0, 3, 2)], [(0, 3, 2)], [(0, 2, 1)], [(0, 3, 0), (3, 3, 1)]]


def test_rows_of_every_kind_come_back(spark):
    long_text = "word " * 400_000 + "MIT License"
    rows = [(1, "Released under the MIT License.", "x", 1), (1, "Released under the MIT License.", "x", 1), (2, None, None, None)]
    rows += [(3, "", "", 0), (None, "CC BY 4.0", "y", 2), (4, long_text, "", 0), (5, "Released undr the MTI License", "", 0)]
    got = sorted(
        (r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3))
        for r in license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    )
    assert got == [
        (0, 4, 1, 0, 0, "cc-by", "cc-by", 1.0),
        (1, 5, 1, 3, 3, "mit", "mit", 1.0),
        (1, 5, 1, 3, 3, "mit", "mit", 1.0),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 0, 0, None, None, "", "", 0.0),
        (4, 400_002, 1, 400_000, 400_000, "mit", "mit", 1.0),
        (5, 5, 0, None, None, "", "mit", 0.9),
    ]
    assert license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_equals_brute_force(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op11_license_scan"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        places = base_places(texts[r.doc_id])
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (len(words_of(texts[r.doc_id])), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_a_notice_needs_more_characters_than_edits():
    with pytest.raises(ValueError):
        Scanner([Notice("n", "ab", 2)])
