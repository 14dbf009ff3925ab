"""Hashes of words and word sequences, computed for whole batches of texts at once.

A word's hash is a polynomial over its bytes in 64-bit arithmetic, taken from running sums over the batch.
A sequence of words is hashed from the hashes of its words. Equal words have equal hashes; among different
ones a collision has a chance of about two to the power of -60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RATIO = np.uint64(0x9E3779B97F4A7C13)  # odd, 3 modulo 8
STEP = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(RATIO), -1, 1 << 64))
        for i, base in enumerate((RATIO, inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words of texts ``data[bounds[i]:bounds[i+1]]``, and for each text where its words begin."""
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[: len(data)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, np.searchsorted(starts, bounds)


def sequences(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * STEP + words[i : i + n]
    return mix(total)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct runs of k words; fewer words are one run; none without words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return mix(sequences(words, len(words)) + np.uint64(len(words)))
    return np.unique(sequences(words, k))


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of a text column as (first row, bytes, bounds); null is empty. A long text is a chunk by itself."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(column: pa.Array, lower: bool = True) -> Iterator[np.ndarray]:
    """Word hashes of each text of a column."""
    for _, data, bounds in texts_of(column):
        hashes, _, at = word_hashes(data, bounds, lower)
        for i in range(len(bounds) - 1):
            yield hashes[at[i] : at[i + 1]]
