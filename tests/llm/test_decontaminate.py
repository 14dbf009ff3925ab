"""Benchmark windows in documents against looking at every position."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vacloom.llm import decontaminate

WORD = re.compile(decontaminate.WORD)
LOWER = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        places = list(WORD.finditer((text or "").translate(LOWER)))
        w, hit, named = [m.group() for m in places], set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (owners := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    named |= {str(o) for o in owners if o is not None}
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [next(j for j in range(i, len(w) + 1) if j not in hit) for i in starts]
        spans = tuple((places[a].start(), places[b - 1].end()) for a, b in zip(starts, ends))
        out.append((doc, len(w), len(hit), tuple(sorted(named)), spans))
    return sorted(out, key=str)


def found(spark, docs, items, width, **options):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    rows = decontaminate.contaminated(table, bench, width, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "Ab", "été", "x1", "日本", "don", "t", " ", "Z"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "-", "'", " \x00 "]) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (10, text(30)), (3, None), (4, "?!"), (None, text(12)), (2, "b b b b"), (7, "same one"), (8, "SAME, one")]
    docs = [(0, None), (1, ""), (2, "same"), (3, "one same one"), (3, "one same one"), (None, "--same--one"), (4, items[0][1] * 3), (5, "b " * 50_000)]
    for i in range(80):
        body = [text(rng.randint(0, 40)) for _ in range(3)]
        if i % 2:
            body.insert(rng.randrange(3), rng.choice([t for _, t in items if t]))
        docs.append((6 + i, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("width", [1, 4, 10])
def test_hits_equal_brute_force(spark, width):
    docs, items = corpus(width)
    assert found(spark, docs, items, width) == brute(docs, items, width)


def test_a_benchmark_in_parts_finds_the_same(spark):
    docs, items = corpus(5)
    assert found(spark, docs, items, 4, pattern_bytes=150) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = corpus(6)
    assert found(spark, [], items, 10) == []
    assert found(spark, docs, [], 10) == brute(docs, [], 10)
    assert found(spark, docs, [(3, None)], 10) == brute(docs, [], 10)
