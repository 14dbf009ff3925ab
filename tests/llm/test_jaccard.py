"""The Jaccard join against comparing all pairs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacloom.llm import jaccard, shingles
from vacloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, how):
    sets = [shingle(t, how.k) for _, t in rows]
    label, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and how.den * len(a & b) >= how.num * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
                links[i], links[j] = links[i] + 1, links[j] + 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)), links[i]) for i, (doc, _) in enumerate(rows)), key=str)


def corpus(seed, k):
    rng = random.Random(seed)
    vocabulary = [f"Wörd{i}" for i in range(400)] + ["the", "of", "and"] * 60
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t", "One", "one", "one two", "ONE\x0btwo", "one two three", "x " * 50, "y " * 3000]
    for n in [4, 9, 11, 14, 20, 26, 35, 50, 80, 130, 300]:
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // (12 * k)))):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
                texts.append((" " if rng.random() < 0.5 else "\n").join(copy))
            texts.append(" ".join(base + passage))
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(400 if seed == 3 else 70):  # near copies of one text
        copy = list(hot)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[30]] * 60
    rng.shuffle(texts)
    return [(None if i % 53 == 0 else i // 2 if i % 41 == 0 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("how", [jaccard.Similarity(3, 90, 100), jaccard.Similarity(5, 80, 100)])
def test_components_equal_brute_force(spark, how):
    rows = corpus(how.k, how.k)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(7)
    got = jaccard.classes(table, how).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, how)
    assert len({r.component_id for r in got}) < 0.6 * len(rows)


def test_one_document_of_each_group_stays(spark):
    how = jaccard.Similarity()
    rows = [(i, t) for i, (_, t) in enumerate(corpus(2, 5)) if t]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("kept"))
    kept = jaccard.one_of_each(table, how)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c if c is not None else d for d, _, c, _ in brute(rows, how)})
    assert jaccard.one_of_each(table.limit(0)).count() == 0


def test_one_of_repeated_rows_and_nameless_copies_stays(spark):
    text, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("onthe", "ofan"))
    near = text.replace("onthe59", "reat59")
    rows = [(7, text, "b")] * 3 + [(7, text, "a"), (8, near, "c"), (9, text, "d")] + [(None, other, "e")] * 4 + [(1, "", "f")] * 2 + [(None, None, "g")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = jaccard.one_of_each(table)
    assert kept.schema == table.schema
    want = [(7, text, "a"), (None, other, "e")] + [(1, "", "f")] * 2 + [(None, None, "g")] * 2
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_no_link_is_lost_wherever_the_boundary_lies(spark):
    how = jaccard.Similarity(3, 90, 100)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(8, 3))]
    sets = {i: shingle(t, 3) for i, t in rows if 2 <= len(shingle(t, 3)) < 90}
    table = spark.createDataFrame([r for r in rows if r[0] in sets], "doc_id long, text string")
    described = jaccard.described(table, how, "doc_id", "text").filter("first is not null")
    doc = {r.row_id: r.doc_id for r in described.collect()}
    want = {(i, j) for i in doc.values() for j in doc.values() if i < j and sets[i] != sets[j]
            and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    linked = {i for pair in want for i in pair}
    nodes = described.selectExpr("row_id node", "n", "first")
    for small in (1, 30, 10**6):
        kept = {doc[r.node] for r in jaccard.survivors(nodes, how, small).collect()}
        assert want and linked <= kept
    wanted = described.selectExpr("row_id node", "n", "doc_id", "text_hash")
    lists = jaccard.scanned_lists(jaccard.whole_sets(table, wanted, how, "doc_id", "text"), how)
    pairs = lists.alias("x").join(lists.alias("y"), "key").selectExpr("x.node a", "y.node b").distinct().collect()
    assert want <= {(doc[r.a], doc[r.b]) for r in pairs}


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("id * 7 % 301 a", "(id + 1) * 7 % 301 b")
    assert {r.label for r in components(links).collect()} == {0}


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in ("", "x", "é", "the") for b in range(3000)]
    column = pa.array([" ".join(words), None, "", "THE the The", "a" * (3 << 20) + " b"])
    first, none, empty, the, long = shingles.words_of(column)
    assert len(set(first.tolist())) == len(set(words)) and len(none) == len(empty) == 0
    assert len(set(the.tolist())) == 1 and len(long) == 2
