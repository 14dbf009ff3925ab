"""Search by sketches against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df, out = Counter(t for _, c, _ in counted for t in c), []
    for item, text in items:
        scored = []
        for doc, c, n in counted:
            m, score = 10 + (90 * n * n_docs) // n_terms, 0
            for t in set(terms(text)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=4, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit("clash"))
    return sorted((tuple(r) for r in lexical.ranked(table, bench, k, **options).collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Été", "ß", "x-1", "日本", "The", "of"]) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.5)) % 900}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [("a", text(20)), ("b", "the THE of"), ("b", "the THE of"), (None, text(5)), ("c", None), ("d", "?!"), ("e", "nowhere"), ("f", text(200))]
    docs = [(0, None), (1, ""), (2, "?"), (None, "of the of"), (3, "same text of words"), (3, "same text of words"), (4, "of " * 70_000), (5, text(3000))]
    docs += [(6 + i, text(rng.randint(1, 60))) for i in range(n)]
    docs += [(1000 + i, items[0][1]) for i in range(n // 2)]  # copies of one text
    return docs, items


@pytest.mark.parametrize("seed, k", [(1, 10), (2, 1)])
def test_against_brute_force(spark, seed, k):
    docs, items = corpus(seed)
    assert found(spark, docs, items, k) == brute(docs, items, k)


def test_queries_in_parts_find_the_same(spark):
    docs, items = corpus(3, 40)
    assert found(spark, docs, items, part_bytes=300) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = corpus(4, 5)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, docs[:3], items) == []


def test_bounds_hold_and_leave_documents_out(spark):
    docs, items = corpus(5, 2000)
    docs = [d for d in docs if (d[0] or 0) < 1000 or d[0] > 2000]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = lexical.indexed(table)
    counted = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    queries = lexical.prepared(index, [i for i, _ in items], [t for _, t in items], counted["docs"])
    rows = lexical.searched(index, queries, counted["docs"], counted["terms"], 4, np.zeros(len(items), np.int64), False)
    assert rows.agg(F.sum("rescored")).first()[0] < 0.5 * len(items) * counted["docs"]


def test_a_sketch_keeps_the_largest_frequency():
    terms = np.arange(0, 6400, 64, dtype=np.uint64)  # many share a coordinate
    tf = np.random.default_rng(1).integers(1, 400, 100)
    width, coordinates, values = lexical.sketch_of(terms, tf)
    sketch = lexical.unfolded(width, [lexical.folded(coordinates, values), lexical.folded(coordinates.astype(np.uint32), values)])
    assert (sketch[0] == sketch[1]).all()
    for t, f in zip(terms, tf):
        assert sketch[0, int(t) % width] >= min(f, lexical.TOP)
    assert sketch.max() == min(tf.max(), lexical.TOP)
