"""Each stage of the pipeline on the rows that the one before kept."""

import random
from collections import Counter

import numpy as np
import pytest
from test_jaccard import brute
from test_native_operators import WORD, measured, water_filling

import corpus_pipeline
from vacloom.llm import jaccard, pii
from vacloom.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def stages(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("on", "re", "at", "ing", "the") for b in ("der", "tion", "ly", "es", "an", "ou")]
    rows = [(0, None, "en", "a", 0), (1, "", "en", "b", 0), (2, "too short", "en", None, 9), (3, "### $$$ *** %%% " * 30, "en", "a", 480)]
    for i in range(4, 160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(25, 300))]
        if i % 5 == 0 and len(rows[-1][1]) > 100:
            words = rows[-1][1].split()
            words[i % len(words)] = "changed"
        if i % 7 == 0:
            words[3:3] = ["mail", f"user{i}@example.com", "or", "+1", "555", "123", str(1000 + i)]
        text = " ".join(words)
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], "").cache())
    return docs.columns, [[tuple(r) for r in df.collect()] for df in found], [df.columns for df in found]


def test_stage_columns(stages):
    columns, _, given = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "personal_data", "source_mix", "packed_windows"]
    assert all(c == columns for c in given[:-1])


def test_quality_stage(stages):
    _, rows, _ = stages
    want = {r[0] for r in rows[0] if (m := measured(r[1]))[0] >= 20 and 100 * m[4] <= 30 * m[0] and r[0] != 3}
    assert {r[0] for r in rows[1]} == want and set(rows[1]) <= set(rows[0])


def test_near_duplicate_stage(stages):
    _, rows, _ = stages
    groups = {c for _, _, c, _ in brute([(r[0], r[1]) for r in rows[1]], jaccard.Similarity())}
    assert sorted(r[0] for r in rows[2]) == sorted(groups) and len(rows[2]) < len(rows[1])


def test_personal_data_stage(stages):
    _, rows, _ = stages
    before, after = {r[0]: r for r in rows[2]}, {r[0]: r for r in rows[3]}
    assert before.keys() == after.keys() and any(before[k] != after[k] for k in before)
    for k, r in after.items():
        assert not pii.base_spans(r[1]) and r[4] == len(r[1])
        assert (r == before[k]) == (not pii.base_spans(before[k][1]))


def test_mixing_stage(stages):
    _, rows, _ = stages
    given, copies, sizes, taken = {r[0]: r for r in rows[3]}, Counter(r[0] for r in rows[4]), Counter(), Counter()
    for r in rows[3]:
        sizes[r[3]] += len(WORD.findall(r[1]))
    for r in rows[4]:
        assert r == given[r[0]]
        taken[r[3]] += len(WORD.findall(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_filling(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    assert max(copies.values()) <= 3
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes)


def test_packing_stage(stages):
    _, rows, _ = stages
    own = Encoder(default_path())
    want = Counter()
    for r in rows[4]:
        want.update(np.frombuffer(own.encode([r[1]])[0], own.dtype).tolist() + [1])
    got = Counter()
    for piece in rows[5]:
        got.update(np.frombuffer(piece[3], "<u4").tolist())
    assert got == want


def test_every_query_is_registered():
    import __spark_entry__ as entry_module

    found, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in found if name[:2] == "op" and name[2:3].isdigit()}
    assert found["pipeline"] is corpus_pipeline.run and all(isinstance(sql, str) for sql in oracle.values())
