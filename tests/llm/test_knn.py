"""The Voronoi join against scoring every row."""

import math

import numpy as np
from pyspark.sql import functions as F

from vacloom.llm import knn


def clipped(score):
    return max(-(2**63), min(2**63 - 1, score))


def brute(rows, k, is_query):
    held = [(i, n, [math.floor(256 * x) for x in v]) for i, (n, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in held:
        if n is not None and is_query(n):
            scored = sorted(((-clipped(sum(a * b for a, b in zip(v, w))), m is not None, m or 0, m) for j, m, w in held if j != i), key=lambda t: t[:3])
            out += [(n, r + 1, m, -s) for r, (s, _, _, m) in enumerate(scored[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=5, every=7, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = knn.top_k(table, F.col("vec_id") % every == 0, k, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, lambda n: n % every == 0)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(200)]  # one vector that a third of the rows hold
    check(spark, rows, pivots=20, blocks=3)


def test_odd_rows(spark):
    rows = [
        (0, None), (7, []), (14, [1.0, None]), (21, [float("nan")]), (28, [float("inf")]), (35, [0.5]), (42, [-0.5, 2.0, 3.0]),
        (42, [-0.5, 2.0, 3.0]), (None, [1.0, 1.0]), (49, [1.0, 1.0]), (50, [1e17, 3.0]), (51, [3e16, -1.0]), (56, [-0.001, 0.0]),
    ]
    check(spark, rows, k=4)
    check(spark, rows[:6], k=3)
    check(spark, rows[:1])
