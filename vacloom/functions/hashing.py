"""Stable identifiers: 32-bit FNV-1a folds, taken over a batch of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a offset and prime, and the second mixing pair of the identity hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SECOND_OFFSET = 0x9E3779B9
SECOND_PRIME = 0x85EBCA6B
MASK32 = 0xFFFFFFFF


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column and the bounds of its texts in them; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def _units_of(texts: pa.Array, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of a column, of each code point every one or the first, and the bounds of its texts in them."""
    data, bounds = _bytes_of(texts)
    if not (data[bounds[0] : bounds[-1]] & 0x80).any():
        return data, bounds
    parts = [(text or "").encode("utf-16-le") for text in texts.to_pylist()]
    units = np.frombuffer(b"".join(parts), "<u2")
    bounds = np.concatenate([[0], np.cumsum([len(part) // 2 for part in parts])])
    if every:
        return units, bounds
    first = (units & 0xFC00) != 0xDC00
    return units[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def _folded(units: np.ndarray, bounds: np.ndarray, offset: int, prime: int) -> np.ndarray:
    """The fold of each text, one place of all texts at a time; texts that have ended drop out."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, state = bounds[:-1][order], np.full(len(sizes), offset, np.uint32)
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)))
    for place, n in enumerate(live):
        state[:n] ^= units[starts[:n] + place]
        state[:n] *= np.uint32(prime)
    out = np.empty(len(sizes), np.int64)
    out[order] = state
    return out


def _numbers(texts: pa.Array, every: bool) -> pa.Array:
    folded = _folded(*_units_of(texts, every), FNV_OFFSET, FNV_PRIME)
    return pa.array(folded, pa.int64(), mask=np.asarray(texts.is_null()))


def fnv32(value: Column) -> Column:
    """FNV-1a/32 over the first UTF-16 unit of each code point, as a number."""

    def fold(texts: pa.Array) -> pa.Array:
        return _numbers(texts, False)

    return F.arrow_udf(fold, "long")(value.cast("string"))


def fnv32_units(value: Column) -> Column:
    """FNV-1a/32 over every UTF-16 unit, as a number."""

    def fold(texts: pa.Array) -> pa.Array:
        return _numbers(texts, True)

    return F.arrow_udf(fold, "long")(value.cast("string"))


def hex8(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def identity_hash(value: Column) -> Column:
    """Two folds over the UTF-8 bytes, sixteen hex digits; null counts as empty."""

    def fold(texts: pa.Array) -> pa.Array:
        data = _bytes_of(texts)
        first, second = _folded(*data, FNV_OFFSET, FNV_PRIME), _folded(*data, SECOND_OFFSET, SECOND_PRIME)
        return pa.array([f"{a:08x}{b:08x}" for a, b in zip(first.tolist(), second.tolist())], pa.string())

    return F.arrow_udf(fold, "string")(value.cast("string"))


def prefixed_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), base36(fnv32(value)))


def change_id(kind: str, entity: Column, revision: Column) -> Column:
    return F.concat(F.lit(f"change_{kind}_"), entity, F.lit("_"), identity_hash(revision))


def entity_id(prefix: str, width: int, provider: Column, scope: Column, external: Column) -> Column:
    safe = F.substring(
        F.regexp_replace(F.concat_ws("_", provider, scope, external), "[^A-Za-z0-9_-]+", "_"),
        1, width,
    )
    identity = F.concat(provider, F.lit("\u0000"), scope, F.lit("\u0000"), external)
    return F.concat(F.lit(f"{prefix}_"), safe, F.lit("_"), identity_hash(identity))


def job_id(provider: Column, board: Column, external: Column) -> Column:
    return entity_id("job", 140, provider, board, external)


def observation_id(provider: Column, source: Column, external: Column) -> Column:
    return entity_id("observation", 130, provider, source, external)


def funding_id(company: Column, url: Column) -> Column:
    return F.concat(
        F.lit("funding_"), F.regexp_replace(company, "^company_", ""), F.lit("_"),
        base36(fnv32_units(F.concat(company, F.lit(":"), url))),
    )


def identity_key(provider: Column, source: Column, external: Column) -> Column:
    return F.concat_ws(":", provider, source, external)
