"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Vectors become integers, ``floor(256 * x)`` for each component. A fixed number of pivots is chosen by hash
order; every row goes to its nearest pivot's cell. A cell is cut into blocks by a hash, so that a cell with
most rows never meets in one task, and summarised by its size and radius. For a query ``q`` and a cell with
pivot ``p`` and radius ``r``, all products lie in ``q.p +- |q| r``; the cells with the best lower bounds
that hold k other rows give a threshold, and a query is sent only to cells whose upper bound reaches it. The
blocks solve locally and the best k of the blocks' answers are the answer.

Only pivots and summaries are broadcast; their number is the parameter. Products are computed in 64-bit
floats where all partial sums are whole numbers below 2**53, and in Python integers otherwise.

Defined results: null vectors and vectors with null or non-finite components take no part; a shorter vector
counts as padded with zeros; a row with a null id is a candidate and sorts before all ids; repeated rows are
rows of their own, and a query leaves out only its own row; scores outside 64 bits are clipped to them; an
empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import durable

SCALE = 256
PIVOTS = 128
BLOCKS = 16
FEW = 512  # queries solved against a block at once
EXACT = 2.0**53
SLACK = 1e-9  # relative error that the bounds allow their float arithmetic


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """row_id, vec_id and the integer vector (as doubles) of every row that takes part."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.filter(F.col(vector).isNotNull()).filter(finite)
    # floor() of a double is a 64-bit integer in SQL; beyond that a double is whole already.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return durable(rows.select(F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, v in zip(out, column):
        row[: min(len(v), width)] = v[:width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, clipped to 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    wide = np.vectorize(int, otypes=[object])
    scores = wide(a) @ wide(b).T if a.size and b.size else np.zeros((len(a), len(b)), object)
    return np.clip(scores, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of one query; ties go to the smaller id, null first."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= kth)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], ~nulls[places], ~scores[places]))][:k]


def pivots_of(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """The vectors first in hash order, distinct: at most ``count`` reach the driver."""
    distinct = rows.select("v", F.xxhash64("v").alias("h")).groupBy("h").agg(F.first("v").alias("v"))
    found = distinct.orderBy("h").limit(count).select("v").toPandas()["v"]
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    return matrix(found, width) if len(found) else np.zeros((1, width))


def celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot's number, the distance to it and the vector's length."""
    half = 0.5 * (pivots**2).sum(1)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096].copy()
                v = matrix(part["v"], pivots.shape[1])
                part["cell"] = np.argmax(v @ pivots.T - half, 1)
                part["reach"] = np.sqrt(((v - pivots[part["cell"]]) ** 2).sum(1))
                yield part

    return rows.mapInPandas(nearest, "row_id long, vec_id long, v array<double>, cell int, reach double")


def routed(queries: DataFrame, pivots: np.ndarray, summaries: pd.DataFrame, k: int) -> DataFrame:
    """Each query with every cell that can hold one of its k best."""
    cells, sizes, radius = (summaries[c].to_numpy() for c in ("cell", "n", "radius"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                v = matrix(part["v"], pivots.shape[1])
                middle, spread = v @ pivots[cells].T, np.sqrt((v**2).sum(1))[:, None] * radius
                slack = SLACK * (np.abs(middle) + spread + 1)
                low, high = middle - spread - slack, middle + spread + slack
                order = np.argsort(-low, 1)
                enough = np.cumsum(sizes[order], 1) >= k + 1  # one more: the query's own row may be among them
                kth = np.where(enough.any(1), np.take_along_axis(low, order, 1)[np.arange(len(v)), enough.argmax(1)], -np.inf)
                q, c = np.nonzero(high >= kth[:, None])
                yield pd.DataFrame({
                    "row_id": part["row_id"].to_numpy()[q], "vec_id": part["vec_id"].to_numpy()[q],
                    "v": part["v"].to_numpy()[q], "cell": cells[c].astype(np.int32)})

    return queries.select("row_id", "vec_id", "v").mapInPandas(route, "row_id long, vec_id long, v array<double>, cell int")


def top_k(table: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding",
          pivots: int = PIVOTS, blocks: int = BLOCKS) -> DataFrame:
    """The k best other rows of each row that ``is_query`` selects: query_id, rank, vec_id, score."""
    rows = whole_vectors(table, vec_id, vector)
    centres = pivots_of(rows, pivots)
    data = durable(celled(rows, centres))
    summaries = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).toPandas()  # a row per pivot
    if summaries.empty:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = routed(data.filter(is_query), centres, summaries, k).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = data.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
    width = centres.shape[1]

    def solve(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(held):
            own, ids = held["row_id"].to_numpy(), held["vec_id"]
            nulls, ids, b = ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64), matrix(held["v"], width)
            for at in range(0, len(asked), FEW):
                part = asked.iloc[at : at + FEW]
                scores = products(matrix(part["v"], width), b)
                for i, (row, query) in enumerate(zip(part["row_id"], part["vec_id"])):
                    other = np.flatnonzero(own != row)
                    for p in other[best(scores[i, other], ids[other], nulls[other], k)]:
                        found.append((row, query, None if nulls[p] else ids[p], scores[i, p]))
        out = pd.DataFrame(found, columns=["row_id", "query_id", "vec_id", "score"])
        return out.astype({"row_id": "int64", "query_id": "Int64", "vec_id": "Int64", "score": "int64"})

    found = asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block")).applyInPandas(
        solve, "row_id long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
