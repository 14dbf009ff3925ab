"""Repeated passages against counting every window."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacloom.llm import suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        span = None
        for i in range(len(w) - least + 1):
            if counts[tuple(w[i : i + least])] > 1:
                if span and i <= span[1]:
                    span = (span[0], i + least)
                else:
                    out += [(doc, len(w), *span)] if span else []
                    span = (i, i + least)
        out += [(doc, len(w), *span)] if span else []
    return sorted(out, key=str)


def corpus(seed, least):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Ö"]) * rng.randint(1, 3) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(n)] for n in (least - 1, least, least + 1, least + 9, 3 * least)]
    texts = [None, "", "one two", " ".join(passages[0]), "x " * (4 * least), "x " * (4 * least + 1)]
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(passages)
        texts.append((" " if i % 2 else "\n").join(body))
    texts += [texts[20]] * 15
    rng.shuffle(texts)
    return [(None if i % 31 == 0 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least, k", [(50, 8), (12, 3), (9, 9)])
def test_spans_equal_brute_force(spark, least, k):
    rows = corpus(least, least)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(5)
    got = suffixes.repeated_passages(table, least, k)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "start", "end").collect()), key=str) == brute(rows, least)
    assert suffixes.repeated_passages(table.limit(0), least, k).count() == 0


def test_first_places_cover_each_window_once(spark):
    rows = corpus(77, 50)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    firsts = suffixes.repeated_passages(table).agg(F.sum("n_first").alias("n")).first()["n"]
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    assert firsts >= sum(1 for n in counts.values() if n > 1)


def test_minima_and_sequences():
    values = np.array([5, 3, 3, 9, 1, 7, 1, 1, 8], np.uint64)
    for width in range(1, 11):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert suffixes.window_minima(values, width).tolist() == want
    words = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1], np.uint64)
    for length in range(1, 9):
        runs = suffixes.long_sequences(words, length).tolist()
        assert len(runs) == 11 - length and (len(runs) < 4 or runs[0] == runs[3]) and len(set(runs)) == min(3, len(runs))
