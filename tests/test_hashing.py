"""Folds over batches of texts: equal to a fold by hand, nulls and odd characters included, and one pass over the texts."""

from pyspark.sql import functions as F

from vacloom.functions import hashing
from vacloom.plans.skew import plan_text

TEXTS = ["", "a", "ashby:17:4", "é\u0000\n漢", "x\U0001F600y\U0001D11E", "long " * 300]


def fold(units, offset, prime):
    for unit in units:
        offset = ((offset ^ unit) * prime) & hashing.MASK32
    return offset


def units(text, every):
    words = [text.encode("utf-16-le")[i : i + 2] for i in range(0, len(text.encode("utf-16-le")), 2)]
    numbers = [int.from_bytes(w, "little") for w in words]
    return numbers if every else [n for n in numbers if not 0xDC00 <= n < 0xE000]


def hashed(rows):
    value = F.col("text")
    return rows.select("text", hashing.fnv32(value).alias("f"), hashing.fnv32_units(value).alias("u"), hashing.identity_hash(value).alias("i"))


def test_folds_by_hand(spark):
    rows = hashed(spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").coalesce(1)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r["text"] is None:
            assert (r["f"], r["u"], r["i"]) == (None, None, "811c9dc59e3779b9")
            continue
        data = r["text"].encode()
        assert r["f"] == fold(units(r["text"], False), hashing.FNV_OFFSET, hashing.FNV_PRIME)
        assert r["u"] == fold(units(r["text"], True), hashing.FNV_OFFSET, hashing.FNV_PRIME)
        both = [fold(data, hashing.FNV_OFFSET, hashing.FNV_PRIME), fold(data, hashing.SECOND_OFFSET, hashing.SECOND_PRIME)]
        assert r["i"] == "".join(f"{n:08x}" for n in both)


def test_texts_are_not_taken_apart_by_arrays(spark):
    plan = plan_text(hashed(spark.range(1).select(F.col("id").cast("string").alias("text"))))
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
