"""Vector codes against a full search, on hand-made and random tables."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from procflow.llm.vector_codes import approximated, assign, compress_vectors, moved

SCHEMA = "vec_id long, embedding array<float>, label int, code string, `row` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", "r") for i, v, x in rows], SCHEMA).repartition(3)


def plain(rows, parts=8, entries=16, rounds=6):
    """(rows with code, error and label error; digest) by full search over Python integers."""
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(4096 * float(np.float32(x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    size = len(kept[0][1]) // parts if kept else 0

    def cut(v, p):
        return v[p * size : (p + 1) * size]

    books = [[list(cut(v, p)) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for e, xs in held.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, tuple(e for _, e in best), sum(d for d, _ in best), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return [(i, code, error, sums[label]) for i, code, error, label in out], hashlib.sha256(text.encode()).hexdigest()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def found(spark, rows, **more):
    codes = compress_vectors(frame(spark, rows), **more)
    out = codes.label_errors().select("id", "code", "error", "label_error").collect()
    return order([(r[0], tuple(r[1]), r[2], r[3]) for r in out]), codes.digest()


def vectors(n, size=16, seed=1, spread=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.choice([-0.3, 0.3]), spread) for _ in range(size)], i % 5) for i in range(n)]


def check(spark, rows, **more):
    rows_wanted, digest = plain(rows, **more)
    assert found(spark, rows, **more) == (order(rows_wanted), digest)


def test_matches_full_search(spark):
    check(spark, vectors(300))


def test_odd_rows(spark):
    base = vectors(60)
    nan, inf = float("nan"), float("inf")
    odd = [(100, None, 1), (101, [nan] + [0.1] * 15, 1), (102, [inf] + [0.1] * 15, 2), (103, [None] + [0.1] * 15, 2), (104, [-inf] * 16, 0)]
    odd += [(3, base[3][1], 0), (3, base[3][1], None), (None, base[5][1], None), (None, [0.0] * 16, 7), (200, [-0.0] * 16, None), (-5, [1000.0] * 16, 1)]
    check(spark, base + odd)
    shorter = [*base, (300, [0.5] * 8, 1), (301, [], 1)]
    assert found(spark, shorter) == found(spark, base)


def test_ties_repeats_and_unused_entries(spark):
    same = [(i, [0.25] * 8, 1) for i in range(40)]
    check(spark, same)
    check(spark, same + [(50 + i, [i / 8] * 8, None) for i in range(3)])


@pytest.mark.parametrize("n", [1, 5, 16, 17])
def test_few_rows(spark, n):
    check(spark, vectors(n))


def test_no_rows(spark):
    assert found(spark, [])[0] == [] and found(spark, [(1, None, 1)])[0] == []


def test_other_shapes(spark):
    check(spark, vectors(80, 12), parts=3, entries=5, rounds=9)
    with pytest.raises(ValueError, match="equal parts"):
        compress_vectors(frame(spark, vectors(5, 12)))
    with pytest.raises(ValueError, match="too large"):
        compress_vectors(frame(spark, [(1, [1e30] * 16, 1)]))


def test_bounds_hold_and_save_distances():
    """Net displacement is never more than the drifts added up, bounds stay below the distances, few are measured."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 500, (400, 4)).astype(np.int64) + rng.integers(0, 3, (400, 1)) * 4000
    book = x[:12].copy()
    history = book[None, None]
    code, bound, stamp = np.zeros(400, np.int64), np.zeros((400, 12)), np.zeros((400, 12), np.int64)
    measured = []
    for _ in range(8):
        best, n = assign(x, code, bound, stamp, history, 0)
        measured.append(n)
        exact = ((x[:, None].astype(float) - history[-1, 0][None]) ** 2).sum(axis=2)
        assert (best == exact.min(axis=1)).all() and (code == exact.argmin(axis=1)).all()
        net = moved(history, 0)
        low = bound - net[stamp, np.arange(12)]
        assert (low <= np.sqrt(exact) + 1e-6).all()
        steps = np.ceil(np.sqrt((np.diff(history[:, 0], axis=0).astype(float) ** 2).sum(axis=2)))
        drift = np.concatenate([steps[::-1].cumsum(axis=0)[::-1], np.zeros((1, 12))])
        assert (net <= drift + 1).all()
        new = history[-1].copy()
        for e in range(12):
            if (code == e).any():
                new[0, e] = x[code == e].sum(axis=0) // (code == e).sum()
        history = np.concatenate([history, new[None]])
    assert measured[0] > measured[-1] and measured[-1] < 400 * 12 / 2


def test_codes_approximate_the_vectors(spark):
    rows = vectors(200, 16, spread=0.02)
    near = {r["id"]: r["vector"] for r in approximated(compress_vectors(frame(spark, rows))).collect()}
    assert np.mean([(np.array(near[i]) - np.array(v)) ** 2 for i, v, _ in rows]) < 0.02
