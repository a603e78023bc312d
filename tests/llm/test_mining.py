"""Hard negatives and top-k tiles against brute force, on odd rows too."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import mining, tiles

SCHEMA = "vec_id long, embedding array<double>, label long, uid long, own long, lo long, position long, need long"


def brute(rows, n_positives=5, k=3, anchor=lambda i: i % 5 == 0, least=(50, 100), most=(95, 100), scale=256):
    good = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, lab in {(i, tuple(v), lab) for i, v, lab in good if anchor(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in good if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == lab][:n_positives]:
            near = [(n, t) for t, n, other in scored if other != lab and -s * least[0] <= -t * least[1] and -t * most[1] <= -s * most[0]]
            out += [(i, j, r, n, -s, -t) for r, (n, t) in enumerate(near[:k], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in mining.mine(table, F.col("vec_id") % 5 == 0, F.col("label"), **kw).collect())


def some(seed, n, d=6, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(d)
    return [(int(i), (centre + spread * rng.standard_normal(d)).round(2).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_brute(spark, spread):
    rows = some(1, 80, spread=spread)
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_more_digits_and_small_tiles(spark, monkeypatch):
    """Windows of many digits, several groups and blocks, runs of a few scores."""
    for name, value in (("BLOCK_BYTES", 400), ("GROUP_BYTES", 300), ("SCORES", 40), ("FAN_IN", 2)):
        monkeypatch.setattr(tiles, name, value)
    rows = some(2, 60)
    assert mined(spark, rows, scale=2.0**14) == brute(rows, scale=2**14)
    monkeypatch.setattr(mining, "DIGIT", 2)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    """Nulls, empty and huge vectors, other dimensions, ties, repeated rows of an anchor and of others, windows with too few rows."""
    v = [1.0, 0.5, 0.25]
    rows = [(0, v, 1), (0, v, 1), (5, [2.0, 1.0, 0.0], 1), (10, [0.0, 0.0, 0.0], 1), (15, [-1.0, 0.0, 0.1], 2)]
    rows += [(i, [0.9, 0.5, 0.2], 2) for i in range(21, 35)] + [(i, v, 1) for i in (36, 37, 37, 38)] + [(41, [0.6, 0.3, 0.1], 3)] * 4
    rows += [(51, None, 1), (52, [], 1), (53, [1.0, None, 1.0], 2), (54, [1.0, float("nan"), 1.0], 2), (55, [1.0, float("inf"), 1.0], 2), (None, v, 1), (57, v, None), (60, [1.0, 2.0], 1), (61, [1.0, 1.9], 1), (62, [1.0, 1.4], 2)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert {r[0] for r in got} >= {0, 60}
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []
    huge = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [7e29, 0.0], 2), (3, [1.0, 1.0], 2)]
    assert mined(spark, huge) == []  # both scores are held to the range of long, and none is 95 hundredths of itself


def test_best_with_ties_and_large_scores():
    rng = np.random.default_rng(3)
    for scores in (rng.integers(-3, 4, (7, 50)), rng.integers(-(2**61), 2**61, (7, 50))):
        barred = rng.random(scores.shape) < 0.3
        for k in (1, 5, 60):
            row, at = tiles.best(scores, barred, np.arange(50), k)
            for i in range(7):
                want = sorted((-scores[i, j], j) for j in range(50) if not barred[i, j])[:k]
                assert sorted((-scores[i, j], j) for j in at[row == i]) == want
