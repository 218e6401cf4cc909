import hashlib
import math
import random

import numpy as np
import pytest

from auditweave.llm import centroids as ce

ROWS = "vec_id long, embedding array<double>, x string, norms string, cluster string, distance string"


def brute(rows, k, rounds, width, scale=256, salt="2"):
    """rows (vec_id, vector): (vec_id, cluster, distance, cluster_inertia, inertia, centroid hash), in plain integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v):
            z = [int(c) * scale if abs(c) > 1e200 else math.floor(scale * c) for c in v]
            if all(-(1 << 63) <= c < 1 << 63 for c in z):
                kept.append((i, z))
    seeds = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), z) for i, z in kept if i is not None)[:k]
    cents = [z for _, z in seeds] or [[0] * width]

    def assign():
        out = []
        for _, z in kept:
            d = [sum((a - b) ** 2 for a, b in zip(z, c)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        who = assign()
        for c in range(len(cents)):
            own = [z for (_, z), (w, _) in zip(kept, who) if w == c]
            if own:
                cents[c] = [sum(col) // len(own) for col in zip(*own)]
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    who = assign()
    whole = [fits(d) for _, d in who]
    out = []
    for (i, _), (w, d) in zip(kept, who):
        own = [fits(x) for v, x in who if v == w]
        out.append((i, w, fits(d), fits(None if None in own else sum(own)), fits(None if None in whole else sum(whole)), hashlib.sha256(",".join(map(str, cents[w])).encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "c", "d") for i, v in rows], ROWS)


def vectors(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (9, width))
    return [(i, (middles[rng.integers(9)] + rng.normal(0, spread / 4, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("width,k,spread", [(64, 40, 0.2), (6, 11, 30.0)])
def test_equals_plain_integers(spark, width, k, spread):
    rows = vectors(width, 400, width, spread) + [(1_000 + i, [0.0] * width) for i in range(30)]
    assert told(ce.cluster(frame(spark, rows).repartition(5), k=k, width=width)) == brute(rows, k, 5, width)


def test_odd_rows(spark):
    rng = random.Random(2)
    good = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    rows = [*enumerate(good), (3, good[3]), (3, good[4]), (None, good[5]), (None, None), (50, None), (51, []), (52, [1.0]), (53, [1.0, None, 1.0, 1.0]), (54, [1.0, float("nan"), 1.0, 1.0]), (55, [float("inf")] * 4), (56, [0.0] * 4), (57, [-0.0] * 4), (58, [0.001] * 4)]
    assert told(ce.cluster(frame(spark, rows), k=6, rounds=4, width=4)) == brute(rows, 6, 4, 4)
    assert ce.cluster(frame(spark, rows).limit(0), width=4).collect() == []
    assert told(ce.cluster(frame(spark, rows[:3]), k=40, width=4)) == brute(rows[:3], 40, 5, 4)
    alone = [(None, good[0]), (None, good[1])]
    assert told(ce.cluster(frame(spark, alone), width=4)) == brute(alone, 40, 5, 4)


def test_components_beyond_64_bit_squares(spark):
    rows = [(i, [1e7 * (i % 5), -3e6, 0.5]) for i in range(20)] + [(30, [1e15, 0.0, 0.0]), (31, [-1e15, 5.0, 0.0]), (32, [1e16, 0.0, 0.0]), (33, [1e300, 0.0, 0.0])]
    got = told(ce.cluster(frame(spark, rows), k=3, rounds=3, width=3))
    assert got == brute(rows, 3, 3, 3) and len(got) == 23


@pytest.mark.parametrize("width,size", [(64, 40), (64, 40_000), (6, 3), (5, 20_000_000)])
def test_screening_leaves_most_centroids_without_exact_distances(width, size):
    """Bounds are lower bounds, ties stay in, and even among vectors without structure most centroids get no exact distance."""
    rng = np.random.default_rng(size)
    x = rng.normal(0, size, (2_000, width)).astype(np.int64)
    x[::7] = x[0]
    cents = x[1:21].tolist() + [x[1].tolist()] * 3
    screen = ce.Screen(cents)
    form = ce.compressed(x)
    assert (np.abs(form[0]) <= 1 << (ce.BITS - 1)).all()
    full = np.array([[sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents] for v in x[:50].tolist()], object)
    low = screen.bounds(*form, (x * x).sum(1))
    assert (low[:50].astype(object) <= full).all()
    who, best = screen.nearest(x, *form, (x * x).sum(1))
    assert (who[:50] == full.argmin(1)).all() and (best[:50] == full.min(1)).all() and screen.exact < (0.35 if width > 6 else 0.6) * low.size


def test_roots_are_rounded_up():
    squares = np.array([0, 1, 2, 3, 4, 5, 24, 25, 26, (1 << 31) ** 2 - 1, (1 << 31) ** 2 - (1 << 32) + 1, 10**18, 10**18 + 1])
    roots = ce.ceil_root(squares)
    assert all(r * r >= s and (r == 0 or (r - 1) ** 2 < s) for r, s in zip(roots.tolist(), squares.tolist()))
