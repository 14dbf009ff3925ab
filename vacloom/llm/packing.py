"""Packing documents into training windows by non-negative least squares.

Texts are encoded once and the ids written. Whole windows are cut from long documents; what remains of each
document has a length below the window. Lengths are binned in steps of 16 and counted. Shallow combinations
of at most three bins that fill a window exactly are the columns of a non-negative least squares problem
whose right side is the histogram; rounded down, its solution says how often each combination is used.
Documents of a bin take the places of its combinations in the order of their number. Whatever found no
place is packed greedily, end to end, cut where a window is full.

The histogram and the combinations have a fixed size, so only they pass through the driver.

Defined results: a null or empty text is the end id alone; repeated rows are documents of their own; very
long texts become many windows; an empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import numbered, running_sums, written
from vacloom.llm.tokens import default_path, encoder

WINDOW = 2048
STEP = 16
DEPTH = 3
END_ID = 1


def encoded(docs: DataFrame, end_id: int = END_ID, path: str | None = None, name: str = "ids") -> DataFrame:
    """Write row_id, doc_id, n_tokens and packed ids (16 bits each where the vocabulary allows) of every document."""
    path = path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        end = np.array([end_id], own.dtype).tobytes()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [x + end for x in own.encode(part.column("text").to_pylist())]
                yield pa.record_batch([
                    pa.array(range(row, row + len(ids)), pa.int64()), part.column("doc_id"),
                    pa.array([len(x) // own.dtype.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                ], ["row_id", "doc_id", "n_tokens", "ids"])
                row += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(encode, f"row_id long, doc_id {kind}, n_tokens long, ids binary"), name)


def combinations(units: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` bins that fill ``units``, one row each, as counts per bin."""
    found = [[units]]
    if depth >= 2:
        found += [[a, units - a] for a in range(1, units // 2 + 1)]
    if depth >= 3:
        found += [[a, b, units - a - b] for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((len(found), units + 1))
    for row, bins in zip(out, found):
        np.add.at(row, bins, 1)
    return out[:, 1:]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Active set method: x >= 0 with the least ``|a x - b|``."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active[best] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 1e-12)
            if not low.any():
                x = z
                break
            ratio = np.full_like(x, np.inf)
            ratio[low] = x[low] / np.maximum(x[low] - z[low], 1e-300)
            x = x + min(1.0, float(ratio.min())) * (z - x)
            active &= ~(low & (x <= 1e-9))
            x[~active] = 0
    return x


@dataclass(frozen=True)
class Place:
    """Documents ranked first..first+count-1 of a bin go to as many windows, in a slot of a combination."""

    bin: int
    first: int
    count: int
    window: int
    slot: int


def solved(histogram: np.ndarray, depth: int = DEPTH) -> tuple[list[Place], int]:
    """Places for the documents counted in ``histogram`` (index 0: bin 1), and the windows they use."""
    shapes = combinations(len(histogram), depth)
    left, times = histogram.astype(np.int64), np.zeros(len(shapes), np.int64)
    solution = nonnegative_least_squares(shapes.T, histogram.astype(float)) if left.any() else times
    needs = shapes.astype(np.int64)
    for k in np.argsort(-solution, kind="stable"):  # rounded down, and again where the solution asks for more than there is
        if solution[k] >= 1:
            used = needs[k] > 0
            times[k] = min(int(solution[k] + 1e-6), int((left[used] // needs[k][used]).min()))
            left -= times[k] * needs[k]
    taken, window, places = np.zeros(len(histogram), np.int64), 0, []
    for k in np.flatnonzero(times):
        slot = 0
        for b in np.flatnonzero(needs[k]):
            for _ in range(needs[k][b]):
                places.append(Place(int(b) + 1, int(taken[b]), int(times[k]), window, slot))
                taken[b] += times[k]
                slot += 1
        window += int(times[k])
    return places, window


def planned(lengths: DataFrame, window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> DataFrame:
    """Pieces of every row: row_id, start, length, sequence_id, offset. ``lengths``: row_id, n_tokens."""
    spark = lengths.sparkSession
    rest = F.col("n_tokens") % window
    rows = lengths.select(
        "row_id", "n_tokens", F.floor(F.col("n_tokens") / window).alias("n_full"), rest.alias("rest"),
        F.ceil(rest / step).cast("int").alias("bin"),
    )
    counts = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most window / step + 1 rows
    places, used = solved(np.array([counts.get(b, 0) for b in range(1, window // step + 1)]), depth)
    # At most depth places for each of the solution's combinations, of which there are no more than bins.
    slots = spark.createDataFrame(
        [(p.bin, p.first, p.first + p.count, p.window, p.slot) for p in places],
        "s_bin int, s_first long, s_end long, s_window long, s_slot int",
    )
    ranked = numbered(rows.filter("rest > 0"), ["bin"], ["row_id"], "rank")
    joined = written(ranked.join(
        F.broadcast(slots), (F.col("bin") == F.col("s_bin")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_end")), "left"
    ), "places")
    start = (F.col("n_full") * window).alias("start")

    placed = joined.filter("s_bin is not null").select(
        "row_id", start, F.col("rest").alias("length"), (F.col("s_window") + F.col("rank") - F.col("s_first")).alias("sequence_id"), "s_slot")
    earlier = Window.partitionBy("sequence_id").orderBy("s_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("s_slot")

    loose = running_sums(joined.filter("s_bin is null"), ["rest"], ["row_id"])
    first, end = F.floor(F.col("rest_before") / window), F.col("rest_before") + F.col("rest")
    cut = F.explode(F.sequence(first, F.floor((end - 1) / window))).alias("w")
    loose = loose.select("row_id", "n_full", "rest_before", end.alias("end"), cut)
    low, high = F.greatest("rest_before", F.col("w") * window), F.least("end", (F.col("w") + 1) * window)
    loose = loose.select(
        "row_id", (F.col("n_full") * window + low - F.col("rest_before")).alias("start"), (high - low).alias("length"),
        (F.col("w") + used).alias("sequence_id"), (low - F.col("w") * window).alias("offset"))

    # Windows of long documents come after those of the packed ones; the loose ones number at most their tokens.
    n_loose = joined.filter("s_bin is null").agg(F.coalesce(F.sum("rest"), F.lit(0)).alias("n")).first()["n"]
    full = running_sums(rows.filter("n_full > 0"), ["n_full"], ["row_id"])
    full = full.select("row_id", "n_full_before", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)).alias("i"))
    full = full.select(
        "row_id", (F.col("i") * window).alias("start"), F.lit(window).alias("length"),
        (F.col("n_full_before") + F.col("i") + used + -(-n_loose // window)).alias("sequence_id"), F.lit(0).alias("offset"))
    kinds = [F.col(c).cast("long").alias(c) for c in ("row_id", "start", "length", "sequence_id", "offset")]
    return placed.select(*kinds).unionAll(loose.select(*kinds)).unionAll(full.select(*kinds))


def packed(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces with their ids (packed 32-bit): doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = encoded(docs, END_ID, path)
    pieces = planned(tokens.select("row_id", "n_tokens"), window)
    lists = pieces.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = tokens.join(lists, "row_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, count = part.column("doc_id"), part.column("n_tokens").to_pylist()
                cols: list[list] = [[] for _ in names]
                for i, (ids, own) in enumerate(zip(part.column("ids"), part.column("pieces").to_pylist())):
                    raw = ids.as_buffer()
                    values = np.frombuffer(raw, f"<u{raw.size // count[i]}").astype("<u4")
                    for p in own:
                        piece = values[p["start"] : p["start"] + p["length"]].tobytes()
                        for col, v in zip(cols, (i, p["start"], p["length"], piece, count[i], p["sequence_id"], p["offset"])):
                            col.append(v)
                yield pa.record_batch(
                    [doc.take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names[1:], cols[1:])]], names)

    return joined.select("doc_id", "n_tokens", "ids", "pieces").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
