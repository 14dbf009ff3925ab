"""Ranked lexical search by hashed max-sketches, exact.

The index holds, for each document, its distinct terms with their frequencies and a sketch: terms are hashed
to the coordinates of a short vector, and each coordinate keeps the largest frequency folded into it. The
impact of a term in a document grows with its frequency, so a coordinate gives the largest impact of all
terms behind it. A sketch has four coordinates or more for each distinct term of its document.

A batch of queries looks its terms up in a block of sketches at once; weights times impacts, summed, bound
the scores from above. Within a block each query rescores documents exactly from their terms, highest bound
first, and stops at the first bound below its threshold: the k-th best score known. A first pass over all
sketches rescores only the k highest bounds of each block; the k-th best of what all tasks find is where the
thresholds of the second pass start, so that pass leaves few rows to merge.

Queries are bounded by the bytes of their texts (``PART_BYTES``); more are searched part by part over the
same index. Corpus statistics come from the index and cover every document.

Defined results: a null text has no terms, and a document without terms is not counted; rows with one item id
are items of their own; a null document id sorts before all ids; equal ids and scores are ranked by place in
the index; an empty table gives no rows. Only ids and texts are read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm import shingles
from vacloom.llm.common import written

K = 10
PART_BYTES = 512 << 10  # of query texts searched together
SPARSE = 16  # coordinates of a sketch for each distinct term, at least
NARROW = 64  # coordinates of a sketch, at least
TOP = 255  # the frequency from which a coordinate stands for any
QUERIES = 256  # bounded together
CELLS = 1 << 20  # of a block of sketches looked up at once
SALTS = 32
#: Fixed values of the contract: a term's bytes, others separate; A to Z are lower-cased.
TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def terms_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the terms of each text, in order."""
    for _, data, bounds in shingles.texts_of(column):
        hashes, _, at = shingles.word_hashes(TERM_BYTES[data], bounds, lower=False)
        for i in range(len(bounds) - 1):
            yield hashes[at[i] : at[i + 1]]


def narrow(values: np.ndarray, *kinds) -> np.ndarray:
    """Values in the first of the kinds that holds them all."""
    most = int(values.max(initial=0))
    return values.astype(next(k for k in kinds if most <= np.iinfo(k).max))


def sketch_of(terms: np.ndarray, tf: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Coordinatewise maxima of the frequencies, at most ``TOP``: width, and the coordinates that are not zero with their values."""
    width = max(NARROW, 1 << (SPARSE * len(terms) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    order = np.argsort(tf, kind="stable")  # of equal coordinates the last value stays
    out[(terms[order] & np.uint64(width - 1)).astype(np.int64)] = np.minimum(tf[order], TOP)
    filled = np.flatnonzero(out)
    return width, narrow(filled, np.uint16, np.uint32), out[filled]


def unfolded(width: int, sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, stored as coordinates and values, as rows of coordinates."""
    out = np.zeros((len(sketches), width), np.uint8)
    for row, data in zip(out, sketches):
        size = data[0]
        n = (len(data) - 1) // size
        row[np.frombuffer(data, np.uint16 if size == 3 else np.uint32, n, 1)] = np.frombuffer(data, np.uint8, n, 1 + n * (size - 1))
    return out


def folded(coordinates: np.ndarray, values: np.ndarray) -> bytes:
    """A first byte tells the bytes of an entry."""
    return bytes([coordinates.itemsize + 1]) + coordinates.tobytes() + values.tobytes()


def frequencies(data: bytes, terms: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == terms else np.uint32)


def indexed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written: row_id, doc_id, n (terms with repeats), terms, tf, width and sketch of documents that have terms."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, keep, out = batch.slice(at, 1024), [], []
                for i, words in enumerate(terms_of(part.column(1))):
                    if len(words):
                        terms, tf = np.unique(words, return_counts=True)
                        width, coordinates, values = sketch_of(terms, tf)
                        keep.append(i)
                        out.append((row + i, len(words), terms.tobytes(), narrow(tf, np.uint8, np.uint32).tobytes(), width, folded(coordinates, values)))
                row += part.num_rows
                if out:
                    rows, n, terms, tf, widths, sketch = zip(*out)
                    yield pa.record_batch([
                        pa.array(rows, pa.int64()), part.column(0).take(pa.array(keep)), pa.array(n, pa.int64()), pa.array(terms, pa.binary()),
                        pa.array(tf, pa.binary()), pa.array(widths, pa.int64()), pa.array(sketch, pa.binary())],
                        ["row_id", "doc_id", "n", "terms", "tf", "width", "sketch"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(index, f"row_id long, doc_id {kind}, n long, terms binary, tf binary, width long, sketch binary"), "lexical")


def document_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many documents hold each term of a sorted vocabulary."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held = np.frombuffer(b"".join(batch.column(0).slice(at, 1024).to_pylist()), np.uint64)
                place = np.searchsorted(vocabulary, held).clip(max=len(vocabulary) - 1)
                total += np.bincount(place[vocabulary[place] == held], minlength=len(vocabulary))
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        rows = index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        out[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


@dataclass
class Queries:
    """The queries of one part, over a sorted vocabulary of term hashes."""

    ids: list
    vocabulary: np.ndarray
    terms: list  # of each query: places in the vocabulary
    weights: np.ndarray  # of the vocabulary

    def blocks(self) -> list[tuple]:
        """At most ``QUERIES`` queries each: (queries, their vocabulary places, and for each place where its rows begin;
        rows of place by place: query of the block, weight)."""
        out = []
        for at in range(0, len(self.ids), QUERIES):
            own = np.arange(at, min(at + QUERIES, len(self.ids)))
            place = np.concatenate([self.terms[q] for q in own])
            query = np.repeat(np.arange(len(own)), [len(self.terms[q]) for q in own])
            order = np.argsort(place, kind="stable")
            places, begin = np.unique(place[order], return_index=True)
            out.append((own, places, np.append(begin, len(place)), query[order], self.weights[place[order]].astype(np.float64)))
        return out


def bounded(held: np.ndarray, n: np.ndarray, m: np.ndarray, block: tuple) -> np.ndarray:
    """Upper bounds of the scores of documents (rows) for the queries of a block, from what their sketches hold at its places."""
    own, _, begin, query, weight = block
    doc, place = np.nonzero(held)
    f = held[doc, place].astype(np.float64)
    f = np.where(f == TOP, n[doc], f)
    impact = 1e9 * f / (1000 * f + 8.0 * m[doc])
    times = np.diff(begin)[place]
    at = np.repeat(begin[place] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    sums = np.bincount(np.repeat(doc, times) * len(own) + query[at], np.repeat(impact, times) * weight[at], len(held) * len(own))
    return sums.reshape(len(held), len(own)) * (1 + 1e-12 * (len(weight) + 1))  # floats round; the bound has to hold


def prepared(index: DataFrame, ids: list, texts: list, n_docs: int) -> Queries:
    hashes = [np.unique(words) for words in terms_of(pa.array(texts, pa.string()))]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    df = document_frequencies(index, vocabulary)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    return Queries(ids, vocabulary, [np.searchsorted(vocabulary, h) for h in hashes], weights)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, in whole numbers of any size."""
    return np.array([10 + (90 * int(x) * n_docs) // n_terms for x in n], np.int64)


def exact_score(terms: np.ndarray, tf: np.ndarray, m: int, wanted: np.ndarray, weights: np.ndarray) -> int:
    place = np.searchsorted(terms, wanted).clip(max=len(terms) - 1)
    held = terms[place] == wanted
    f = tf[place[held]].astype(np.int64)
    return int((weights[held] * ((1_000_000_000 * f) // (1000 * f + 8 * m))).sum())


def searched(index: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int, floor: np.ndarray, few: bool) -> DataFrame:
    """Each task's best k documents for each query: item, score, doc_id, row_id, and how many rescored.

    ``floor`` is a score below which no document counts; ``few`` stops after the k highest bounds of a block.
    """
    kind = index.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries.ids]
        threshold, rescored, blocks, names_type = floor.astype(np.float64), 0, queries.blocks(), None
        hashes = [queries.vocabulary[t] for t in queries.terms]
        weights = [queries.weights[t] for t in queries.terms]
        for batch in batches:
            row, doc, n, names_type = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(), batch.column(1).type
            terms, tf, width, sketch = batch.column(3), batch.column(4), batch.column(5).to_numpy(), batch.column(6)
            m = lengths(n, n_docs, n_terms)
            for block in blocks:
                own, places = block[:2]
                for w in np.unique(width):
                    rows = np.flatnonzero(width == w)
                    step = max(1, CELLS // max(int(w), len(places)))
                    columns = (queries.vocabulary[places] & np.uint64(w - 1)).astype(np.int64)
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        held = unfolded(int(w), [sketch[int(i)].as_py() for i in part])[:, columns]
                        bounds = bounded(held, n[part], m[part], block)
                        for j, q in enumerate(own):
                            near = np.flatnonzero(bounds[:, j] >= max(1, threshold[q]))
                            near = near[np.argsort(-bounds[near, j], kind="stable")]
                            for p in near[:k] if few else near:
                                if bounds[p, j] < threshold[q]:
                                    break
                                i, rescored = int(part[p]), rescored + 1
                                held_terms = np.frombuffer(terms[i].as_buffer(), np.uint64)
                                score = exact_score(held_terms, frequencies(tf[i].as_py(), len(held_terms)), int(m[i]), hashes[q], weights[q])
                                if score < max(1, threshold[q]):
                                    continue
                                name = doc[i].as_py()
                                bisect.insort(best[q], (-score, name is not None, name if name is not None else 0, int(row[i]), name))
                                del best[q][k:]
                                if len(best[q]) == k:
                                    threshold[q] = max(threshold[q], -best[q][-1][0])
        if names_type is None:
            return
        out = [(q, -found[0], found[4], found[3]) for q, all_found in enumerate(best) for found in all_found]
        item, score, names, place = zip(*out) if out else ((), (), (), ())
        yield pa.record_batch([
            pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(names, names_type), pa.array(place, pa.int64()),
            pa.array([rescored] + [0] * (len(out) - 1) if out else [], pa.int64())], ["item", "score", "doc_id", "row_id", "rescored"])

    return index.select("row_id", "doc_id", "n", "terms", "tf", "width", "sketch").mapInArrow(
        search, f"item long, score long, doc_id {kind}, row_id long, rescored long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, parts of an item first, so that no item's rows meet all in one task."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).drop("_salt")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark, kind = docs.sparkSession, items.schema[item_id].dataType.simpleString()
    index = indexed(docs, doc_id, text)
    counted = index.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64).alias("n")).first()["n"] or 0
    parts, out = max(1, -(-size // part_bytes)), []
    if parts > 1:
        asked = written(asked.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    for p in range(parts):
        own = (asked.filter(F.col("_part") == p) if parts > 1 else asked).select("item_id", "text").collect()  # some part_bytes
        if not own or not counted["docs"]:
            continue
        queries = prepared(index, [r["item_id"] for r in own], [r["text"] for r in own], counted["docs"])
        floor = np.zeros(len(own), np.int64)
        seed = _first(searched(index, queries, counted["docs"], counted["terms"], k, floor, True), k)
        for r in seed.filter(F.col("rank") == k).select("item", "score").collect():  # a row an item
            floor[r["item"]] = r["score"]
        found = _first(searched(index, queries, counted["docs"], counted["terms"], k, floor, False), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item long, item_id {kind}")
        found = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out.append(written(found, "ranked") if parts > 1 else found)
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long")
