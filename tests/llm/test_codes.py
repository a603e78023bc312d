"""Vector codes against a plain Lloyd over whole vectors in Python's integers."""

import hashlib

import numpy as np
import pytest

from timberline.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, uid long, dim long, entry long, weight long, key long, code long"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows of one dimension."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], lab) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    first: dict = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = v
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held: dict = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else e for j, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), min(sum(d for d, _ in found), codes.MOST), lab))
    total: dict = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, min(total[lab], codes.MOST), digest) for i, c, e, lab in out), key=repr)


def compressed(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r)[:5] for r in codes.compress(table, **kw).collect()), key=repr)


def some(seed, n, d=16):
    rng = np.random.default_rng(seed)
    return [(int(i), (rng.integers(-3, 4, d) / 8 + (rng.standard_normal(d) / 50 if i % 3 else 0)).tolist(), int(rng.integers(3)) if i % 5 else None) for i in rng.permutation(n)]


def test_brute_with_repeats(spark):
    rows = some(1, 70)
    rows += [(100 + i, rows[3][1], 1) for i in range(60)]  # most rows share their parts
    assert compressed(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = some(2, 20, 8)
    rows += [(90, None, 1), (91, [], 1), (92, [0.1] * 7 + [None], 1), (93, [0.1] * 7 + [float("nan")], 1), (94, [0.1] * 7 + [float("-inf")], 1), (95, [0.5] * 9, 1), (None, [0.25] * 8, 2), rows[0], rows[0]]
    assert compressed(spark, rows) == brute(rows)
    few = rows[:3]
    assert compressed(spark, few) == brute(few)
    assert compressed(spark, []) == []
    assert compressed(spark, [(None, [0.5] * 8, 1)]) == []


def test_several_dimensions(spark):
    a, b = some(3, 20, 8), [(i + 100, v, lab) for i, v, lab in some(4, 20, 16)]
    got = compressed(spark, a + b)
    drop = lambda rows: sorted((r[:3] + r[4:] for r in rows), key=repr)
    assert drop(got) == drop(brute(a) + brute(b))


def test_large_components(spark):
    rng = np.random.default_rng(5)
    for size in (1e4, 1e9, 1e15, 1e35):
        rows = [(i, (size * rng.standard_normal(8)).tolist(), i % 2) for i in range(25)]
        assert compressed(spark, rows) == brute(rows), size


def test_labels_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(codes, "SHARE", 4)
    rows = some(6, 40)
    assert compressed(spark, rows) == brute(rows)


@pytest.mark.parametrize("top", [3, 2**20, 2**30, 2**40])
def test_nearest(top):
    rng = np.random.default_rng(7)
    values, book = rng.integers(-top, top, (50, 3)), rng.integers(-top, top, (5, 3)).tolist()
    at, off = codes.nearest(values, book)
    for v, a, o in zip(values.tolist(), at, off):
        want = min((sum((x - y) ** 2 for x, y in zip(v, e)), j) for j, e in enumerate(book))
        assert (min(want[0], codes.MOST), want[1]) == (o, a)
