"""Hard negatives by the tree against scoring every row."""

import math

import numpy as np
from pyspark.sql import functions as F

from vacloom.llm import negatives


def brute(rows, every, positives=5, count=10):
    held = [(i, n, [math.floor(256 * x) for x in v], c) for i, (n, v, c) in enumerate(rows)
            if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v, c in held:
        if n is None or n % every:
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), m is not None, m or 0, m, d) for j, m, w, d in held if j != i]
        scored.sort(key=lambda s: s[:3])
        for p, _, _, m, _ in [s for s in scored if s[4] == c][:positives]:
            fits = [s for s in scored if s[4] != c and 30 * -p <= 100 * -s[0] <= 90 * -p][:count]
            out += [(n, m, r + 1, s[3], -p, -s[0]) for r, s in enumerate(fits)]
    return sorted(out, key=str)


def found(spark, rows, every=7, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {"leaf": F.lit("clash"), "row_id": F.lit("clash")}).repartition(5)
    got = negatives.hard_negatives(table, F.col("vec_id") % every == 0, **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def clusters(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    return [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(4))) for i in range(n)]


def test_against_brute_force(spark):
    rows = clusters(3, 400)
    rows += [(400 + i, rows[5][1], i % 3) for i in range(200)]  # one vector that a third of the rows hold
    assert found(spark, rows, leaf_rows=30, block_rows=20, group=16) == brute(rows, 7)


def test_odd_rows(spark):
    rows = [
        (0, None, 1), (7, [], 1), (14, [1.0, None], 1), (21, [float("nan")], 2), (28, [float("inf")], 2), (35, [0.5], None), (42, [0.5, 2.0, 3.0], 1),
        (42, [0.5, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (49, [1.0, 1.0], 2), (50, [1e17, 3.0], 1), (51, [3e16, 1.0], 2), (56, [0.2, 0.0], 2), (57, [0.3], 1),
    ]
    assert found(spark, rows) == brute(rows, 7)
    assert found(spark, rows[:6]) == brute(rows[:6], 7) == []
    assert found(spark, rows[:1]) == []


def test_ranges_hold_every_row_and_leave_leaves_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6)) * 4
    v = np.floor(256 * (centres[rng.integers(8, size=3000)] + 0.2 * rng.normal(size=(3000, 6))))
    tree = negatives.fitted(v[:800], 40)
    table = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    ranges = negatives.ranges_of(table, tree, 6)
    leaf, seen = tree.place(v)
    for node, rows, child, far in seen:
        low, high = ranges[node]
        assert (far >= low[:-1].T[child] - 1e-6).all() and (far <= high[:-1].T[child] + 1e-6).all()
    anchors = v[:60]
    scores = anchors @ v.T
    high = 0.9 * np.sort(scores, 1)[:, -2]
    low = np.sort(np.where(scores <= high[:, None], scores, -np.inf), 1)[:, -10]
    meets = negatives.reached(tree, ranges, anchors, low, high)
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    for i in range(60):
        assert meets[i, leaf[inside[i]]].all()
    assert meets.mean() < 0.7
