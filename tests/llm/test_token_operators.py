"""Packing and token files: exact round trips against direct encoding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacloom.llm import binary, packing
from vacloom.llm.tokens import Encoder, default_path

ODD = [
    None, "", " \n\t ", "Plain words, with (punctuation)... and don't it's 's 'S we'll", "é É ǅ İstanbul ΣΑΣ ς ß ﬁ Ⅷ ½ 日本語テキスト \U0001f600\U0001f600",
    "a\x0bb\x0cc\x1cd\x1ee\x85f\xa0g h　i", "<|endoftext|> x<|startoftext|>y <|endoftext|>,", "́leading a\ńb under_score 1a2b3c",
    "x" * 3000, "naïve-word e.g. U.S.A. #tag @name http://a.b/c?d=e", "".join(chr(c) for c in range(33, 700)), "﻿bom ​zero‍ width \x00 nul",
]


def test_parts_encode_like_whole_texts():
    own = Encoder(default_path(), kept=20)
    for _ in range(2):
        for text, ids in zip(ODD, own.encode(ODD)):
            assert np.frombuffer(ids, own.dtype).tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def texts():
    return ODD + [" ".join(f"w{(i * j) % 89}" for j in range((i * 131) % 1700)) for i in range(300)] + ["same short text"] * 150


def table(spark):
    rows = [(i if i % 40 else None, t, i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(6)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_covers_every_id_once(spark):
    tokenizer = Encoder(default_path()).tokenizer
    want = {}
    for i, t in enumerate(texts()):
        want.setdefault(i if i % 40 else None, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    pieces = packing.packed(table(spark)).collect()
    by_doc, windows = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, p.doc_tokens, ids))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for doc, lists in want.items():
        if len(lists) == 1:
            joined = [x for _, _, ids in sorted(by_doc[doc]) for x in ids]
            assert joined == lists[0] and all(n == len(joined) for _, n, _ in by_doc[doc])
        else:
            assert sorted(x for _, _, ids in by_doc[doc] for x in ids) == sorted(x for own in lists for x in own)
    full = 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        full += at
    assert set(windows) == set(range(len(windows)))
    assert full / (2048 * len(windows)) > 0.95
    assert packing.packed(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_least_squares_uses_only_what_there_is(seed):
    counts = np.random.default_rng(seed).integers(0, 500, 128) * np.random.default_rng(seed + 9).integers(0, 2, 128)
    places, windows = packing.solved(counts)
    used = np.zeros(128, int)
    for p in places:
        assert p.first == used[p.bin - 1] and p.window + p.count <= windows
        used[p.bin - 1] += p.count
    assert (used <= counts).all() and used.sum() > 0.5 * counts.sum()


def test_least_squares_is_optimal():
    a = packing.combinations(12, 3).T
    b = np.arange(12.0)[::-1] ** 2
    x = packing.nonnegative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max() < 1e-6


def test_token_files_round_trip(spark):
    manifest = binary.write_shards(table(spark))
    got = sorted(binary.read_shards(manifest).collect(), key=lambda r: r.start)
    tokenizer, at = Encoder(default_path()).tokenizer, 0
    want = {}
    for i, t in enumerate(texts()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i if i % 40 else None, []).append(crc(ids))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert zlib.crc32(r.ids) in want[r.doc_id]
        want[r.doc_id].remove(zlib.crc32(r.ids))
    assert not any(want.values())
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None
    assert binary.read_shards(binary.write_shards(table(spark).filter(F.lit(False)))).count() == 0
