"""Repeated passages by sparse suffix arrays.

A passage repeats if the same run of at least ``least`` words stands at two places of the corpus. Suffixes
are kept only at minimiser positions: of each window of ``least`` words, the one whose first ``k`` words have
the smallest hash. The choice depends on nothing but the words of the window, so equal windows keep suffixes
at equal places. The kept suffixes are sorted by their first words and compared with their neighbours; one
that shares them with no neighbour is dropped. Around the others, matches are extended left and right: each
window that chose such a suffix is hashed whole, and it repeats if another place has the same. Repeated
windows that touch form one span.

Documents with the same words are one node that is searched once; all of them repeat from end to end.

Defined results: null, empty and short texts have no spans; repeated rows and null ids are documents of their
own; a document whose own passages repeat inside it has spans as well; an empty table gives no rows. Only id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm import shingles
from vacloom.llm.common import durable, written

LEAST = 50
FIRST = 8


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each run of ``width`` values."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    low, at, span = values, np.arange(len(values)), 1

    def merged(shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[shift:] < low[:-shift]
        return np.where(right, low[shift:], low[:-shift]), np.where(right, at[shift:], at[:-shift])

    while span * 2 <= width:
        low, at = merged(span)
        span *= 2
    return merged(width - span)[1] if span < width else at


def long_sequences(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, doubled up from shorter runs."""
    parts, have, covered = [], 1, 0
    runs = words
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            parts.append((runs, covered))
            covered += have
        if length >> (bit + 1):
            runs = shingles.mix(runs[:-have] * shingles.STEP + runs[have:])
            have *= 2
    n = len(words) - length + 1
    return shingles.mix(reduce(lambda acc, p: acc * shingles.STEP + p[0][p[1] : p[1] + n], parts, np.zeros(n, np.uint64)))


def kept_suffixes(words: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first words at each minimiser, and its place."""
    first = shingles.sequences(words, k)
    at = np.unique(window_minima(first, least - k + 1))
    return first[at], at


def described(docs: DataFrame, least: int, k: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: row_id, id, text hash, words, hash of all words, packed suffix hashes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            n, whole, kept = [], [], []
            for words in shingles.words_of(batch.column(1), lower=False):
                n.append(len(words))
                whole.append(int(long_sequences(words, len(words))[0].view(np.int64)) if len(words) else 0)
                new = len(words) >= least and whole[-1] not in seen
                kept.append(kept_suffixes(words, least, k)[0].tobytes() if new else None)
                if new and len(seen) < 1_000_000:  # only spares repeating the suffixes of copies within a task
                    seen.add(whole[-1])
            yield pa.record_batch([
                pa.array(range(row, row + len(n)), pa.int64()), batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                pa.array(whole, pa.int64()), pa.array(kept, pa.binary())], ["row_id", "doc_id", "text_hash", "n", "whole", "kept"])
            row += len(n)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return written(rows.mapInArrow(describe, f"row_id long, doc_id {kind}, text_hash long, n long, whole long, kept binary"), "suffixes")


def _suffix_rows(nodes: DataFrame) -> DataFrame:
    """(key, node, i): the i-th kept suffix of a node."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                times = [len(x) for x in keys]
                yield pa.record_batch([
                    pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(), times)),
                    pa.array(np.concatenate([np.arange(t, dtype=np.int32) for t in times]))], ["key", "node", "i"])

    return nodes.select("node", "kept").mapInArrow(unpack, "key long, node long, i int")


def _window_rows(texts: DataFrame, least: int, k: int) -> DataFrame:
    """(window, node, at) for windows whose minimiser is one of the node's shared suffixes."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                node, out = part.column(0).to_numpy(), []
                for own, shared, words in zip(node, part.column(2).to_pylist(), shingles.words_of(part.column(1), lower=False)):
                    chosen = window_minima(shingles.sequences(words, k), least - k + 1)
                    places = np.unique(chosen)[np.array(shared, np.int64)]
                    starts = np.flatnonzero(np.isin(chosen, places))
                    out.append((long_sequences(words, least)[starts].view(np.int64), np.full(len(starts), own), starts.astype(np.int32)))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], ["window", "node", "at"])

    return texts.mapInArrow(extend, "window long, node long, at int")


def repeated_passages(docs: DataFrame, least: int = LEAST, k: int = FIRST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of words that stand elsewhere too: row_id, doc_id, n_words, start, end, n_first.

    ``n_first`` counts the windows of the span that no earlier place (in the order of nodes) holds: a
    de-duplication that keeps first occurrences drops what is left.
    """
    rows = described(docs, least, k, doc_id, text)
    long = rows.filter(F.col("n") >= least)
    groups = durable(long.groupBy("whole", "n").agg(
        F.min_by(F.struct("row_id", "doc_id", "text_hash"), "row_id").alias("r"), F.count(F.lit(1)).alias("copies")
    ).select("whole", "n", "copies", F.col("r.row_id").alias("node"), "r.doc_id", "r.text_hash"))
    own = long.select(F.col("row_id").alias("node"), "kept").filter("kept is not null").join(groups.select("node"), "node", "left_semi")

    order = Window.partitionBy("key").orderBy("node", "i")
    suffixes = _suffix_rows(own).withColumns({"before": F.lag("node").over(order), "after": F.lead("node").over(order)})
    shared = suffixes.filter("before is not null or after is not null").groupBy("node").agg(F.sort_array(F.collect_list("i")).alias("shared"))
    wanted = groups.join(shared, "node").select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "shared")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64("text") == F.col("w_hash"))).select("node", "text", "shared")
    # A repeated row of a node would bring the same windows again: its places are counted once.
    windows = written(_window_rows(texts, least, k).dropDuplicates(["node", "at"]), "windows")
    counts = windows.groupBy("window").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("node", "at")).alias("first"))
    found = windows.join(counts.filter("places > 1"), "window").select(
        "node", "at", ((F.col("first.node") == F.col("node")) & (F.col("first.at") == F.col("at"))).alias("first"))
    lists = found.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("w"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for node, places in zip(batch["node"], batch["w"]):
                at = np.array([p["at"] for p in places], np.int64)
                first = np.array([p["first"] for p in places], np.int64)
                cuts = np.flatnonzero(np.diff(at) > least) + 1
                out += [(node, a[0], a[-1] + least, f.sum()) for a, f in zip(np.split(at, cuts), np.split(first, cuts))]
            yield pd.DataFrame(out, columns=["node", "start", "end", "n_first"])

    spans = lists.mapInPandas(merge, "node long, start long, end long, n_first long")
    named = groups.select("node", "whole", "n", "copies")
    copied = named.filter("copies > 1").select("node", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), (F.col("n") - least + 1).alias("n_first"))
    single = spans.join(named.filter("copies = 1").select("node"), "node", "left_semi")
    spans = single.unionByName(copied).join(named.select("node", "whole", "n"), "node")
    members = long.select("row_id", "doc_id", "whole", "n")
    out = members.join(spans, ["whole", "n"])
    is_node = F.col("row_id") == F.col("node")
    return out.select("row_id", "doc_id", F.col("n").alias("n_words"), "start", "end", F.when(is_node, F.col("n_first")).otherwise(0).alias("n_first"))
