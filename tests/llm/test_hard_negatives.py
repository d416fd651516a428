"""Hard negatives against all pairs, the Hilbert curve and the zone maps' bounds."""

import math

import numpy as np
import pandas as pd
import pytest

from priceforge.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, score string, file int, chunk int"


def brute(rows):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        # SQL's remainder has the sign of the dividend.
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        row = (label, [math.floor(256 * x) for x in v])
        usable[i] = min(usable.get(i, row), row)
    out = []
    for a, (label, v) in usable.items():
        if a % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in usable.items() if b != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            found = [x for x in scores if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(found[:3], 1)]
    return sorted(out)


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in h.hard_negatives(df, **settings).collect())


def random_rows(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) * spread
    labels = rng.integers(0, 4, n)
    return [(i, [float(x) for x in centres[c] + rng.normal(size=width)], int(c)) for i, c in enumerate(labels)]


@pytest.mark.parametrize("width,spread", [(6, 0.3), (16, 2.0)])
def test_equals_all_pairs_over_many_files(spark, monkeypatch, width, spread):
    monkeypatch.setattr(h, "FILE_ROWS", 60)
    monkeypatch.setattr(h, "BLOCK_ROWS", 16)
    monkeypatch.setattr(h, "CHUNK_ANCHORS", 7)
    rows = random_rows(500, width, 1, spread)
    assert mined(spark, rows) == brute(rows) != []


def test_ties_nulls_repeats_and_odd_vectors(spark):
    rows = random_rows(150, 4, 2)
    rows += [(1000 + i, rows[100][1], 1) for i in range(40)] + [(1100 + i, rows[100][1], 2) for i in range(40)]
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(100, [9.0] * 4, 3), (51, [0.5, 0.5], 2), (52, [], 1), (-50, [1.0] * 4, -2)]
    rows += [(2000, None, 1), (2001, [1.0, None, 1.0, 1.0], 1), (2002, [float("nan")] * 4, 1), (2050, [float("inf")] * 4, 1)]
    rows += [(None, [1.0] * 4, 1), (2100, [1.0] * 4, None)]
    assert mined(spark, rows) == brute(rows) != []


def test_large_components_stay_exact(spark):
    rows = [(i, [x * 4.1e5 for x in v], label) for i, v, label in random_rows(120, 3, 4, 0.1)]
    rows = [r for r in rows if max(map(abs, r[1])) < 2**21]
    assert mined(spark, rows) == brute(rows) != []


def test_empty_table_and_lonely_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1), (1, [1.0], 2)]) == []


def test_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        mined(spark, [(50, [1e9], 1), (1, [1.0], 1)])


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        place = h.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks():
    rng = np.random.default_rng(5)
    width = 5
    frame = pd.DataFrame({"anchor_id": [0, 50], "label": [1, 1], "lows": [[2000], [1 << 40]], "highs": [[9000], [1 << 41]]})
    frame["vector"] = [rng.integers(-50, 50, width, dtype=np.int32).tobytes() for _ in range(2)]
    blocks = [rng.integers(-60, 60, (20, width), dtype=np.int32) + 10 * i for i in range(6)]
    w = h._Windows(frame, width)
    low, high = (np.stack([getattr(b, f)(0) for b in blocks]) for f in ("min", "max"))
    least, most = w.bounds(low, high)
    for j, b in enumerate(blocks):
        scores = w.vectors.astype(np.int64) @ b.T.astype(np.int64)
        assert (scores >= least[:, j, None]).all() and (scores <= most[:, j, None]).all()
    zones = pd.DataFrame({"block": range(6), "label": 2, "low": [x.tobytes() for x in low], "high": [x.tobytes() for x in high]})
    chosen = h._chosen(width, False)((0, 0), zones, frame)
    assert list(chosen["block"]) == [j for j in range(6) if most[0, j] >= 2000 and least[0, j] <= 9000]
    assert h._chosen(width, False)((0, 0), zones, frame.iloc[1:]).empty
