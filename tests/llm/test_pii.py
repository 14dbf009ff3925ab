"""Base spans against plain patterns; the field against enumeration; held-out accuracy of what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from vacloom.llm import pii


def plain(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["a", "@", ".", "b-c", "@x.yz", " ", "1", "12", "255", "256", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 555 123 4567", "+", "(", ")", "-", "é", "\n", "007"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("a" * 50000, "1" * 50000, "1." * 30000, "+1" * 20000 + "(" * 20000, "a@" * 20000, "@" * 20000, "1 " * 30000, "a" * 50000 + "@b"):
        pii.base_spans(text)


def test_messages_are_exact_on_a_tree_and_close_on_a_loop():
    rng = np.random.default_rng(2)
    for edges, tolerance in (([(0, 1), (1, 2), (1, 3)], 1e-3), ([(0, 1), (1, 2), (0, 2)], 0.1)):
        unary, potentials = rng.normal(size=(4, 5)), 0.5 * rng.normal(size=(len(edges), 5, 5))
        want = np.zeros((4, 5))
        for labels in itertools.product(range(5), repeat=4):
            score = np.exp(sum(unary[i, v] for i, v in enumerate(labels)) + sum(potentials[e][labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
            for i, v in enumerate(labels):
                want[i, v] += score
        want /= want.sum(1, keepdims=True)
        got = pii.beliefs(pii.empty_field(), unary, np.array(edges), potentials, rounds=60)
        assert np.abs(got - want).max() < tolerance


def document(rng):
    """A text, and the spans that only the field can find: repeats written otherwise."""
    words = lambda: " ".join(rng.choice(["onthe", "ofan", "reat", "ingly"]) for _ in range(rng.randint(3, 30)))
    area, rest = rng.randint(200, 999), f"{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    user, host = f"user{rng.randint(1, 99)}", rng.choice(["mail.org", "example.com"])
    pieces = [(words(), None), (f" call +1 {area}-{rest} ", None), (words() + " ", None), (f"({area}) {rest}", "phone"), (" " + words(), None),
              (f" write {user}@{host} ", None), (words() + " ", None), (f"{user} (at) {host.replace('.', ' (dot) ')}", "email"), (" " + words() + " ", None),
              (str(rng.randint(10**7, 10**8)), None), (" " + words(), None)]
    text, spans = "", []
    for piece, kind in pieces:
        if kind:
            spans.append(f"{kind}:{len(text)}:{len(text) + len(piece)}")
        text += piece
    return text, spans


def test_repeats_written_otherwise_are_found(spark):
    rng = random.Random(11)
    made = [document(rng) for _ in range(300)]
    rows = [(i, t) for i, (t, _) in enumerate(made)] + [(1000 + i, t) for i, t in enumerate([None, "", "clean text only", f"order {10**9 + 7} of 2024"])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    field = pii.fit(table.filter("doc_id < 150"))
    got = {r.doc_id: r for r in pii.scan(table, field).collect()}
    hits = misses = wrong = 0
    for i, (text, spans) in enumerate(made):
        told = pii.told(plain(text))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(got[i].spans.split(","))
        if i >= 150:
            more = set(got[i].spans.split(",")) - set(told.split(","))
            hits, misses, wrong = hits + len(more & set(spans)), misses + len(set(spans) - more), wrong + len(more - set(spans))
    assert hits / (hits + misses) > 0.9 and wrong <= 0.02 * hits, (hits, misses, wrong)
    assert all(got[1000 + i].spans == "" for i in range(4))
    assert pii.scan(table.limit(0)).count() == 0


def test_repeats_are_found_however_many():
    rng = random.Random(11)
    sample = [[(m, pii.features(t, m)) for m in pii.mentions(t)] for t, _ in (document(rng) for _ in range(150))]
    level = pii.Field(np.zeros((pii.N_FEATURES, len(pii.LABELS))), np.zeros((len(pii.LABELS), len(pii.LABELS))), 6.0, 6.0)
    for field, base in ((level, "+1 555 123 4567"), (level, "1 555 123-4567 or +1 (555) 123-4567"), (pii.fitted(sample), "call +1 555 123 4567")):
        for n in (1, 50, 500):
            text = base + " onthe ofan (555) 123-4567" * n
            got = pii.all_spans(field, text)[1]
            want = {m.start() for m in re.finditer(r"(?<=ofan )\(555\) 123-4567", text)}
            assert want <= {s for s, k, _ in got if k == 3}, (n, len(got))


def test_labels_pass_along_neighbours_as_far_as_they_carry():
    n = 40
    unary = np.zeros((n, 5))
    unary[0] = [-1e4, -1e4, -1e4, -1e4, 0]
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    got = pii.beliefs(pii.empty_field(), unary, edges, np.array([8.0 * np.eye(5)] * (n - 1)))
    step = (np.exp(8) - 1) / (np.exp(8) + 4)
    assert np.abs(got[:, 4] - (0.2 + 0.8 * step ** np.arange(n))).max() < 1e-2


def test_masking_keeps_the_rest(spark):
    rows = [(1, "mail a.b@c.de or +1 555 123 4567!", 7), (2, None, 0), (3, "nothing", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("kept"))
    got = {r.doc_id: r for r in pii.redacted(table).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]!" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "nothing" and got[3].spans == "kept"
    assert pii.masked("abcdef", [(1, 0, 3), (2, 1, 4)]) == "a[EMAIL]ef"
