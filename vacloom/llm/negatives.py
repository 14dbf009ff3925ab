"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

A node of the tree has up to ``ARITY`` split points; a row goes to the nearest, so the hyperplanes between
them cut the space. The points come from a bounded sample, the rows are all placed. Every split point keeps,
for each sibling subtree, the range of its distances to the rows in it, and every subtree the range of its
rows' lengths, taken over all rows.

A query asks for the best rows by inner product within a window of scores. With a subtree's lengths a window
of scores is an annulus around the anchor, ``d^2 = |a|^2 + |x|^2 - 2 s``; a subtree whose range around any
split point the annulus cannot meet is left out. Leaves are solved exactly, in blocks of rows against groups
of anchors that lie near each other.

Each search runs twice: first in each anchor's own leaf, whose k-th best score then narrows the windows, then
in the other leaves that are left. Positives are the best rows of the anchor's label in an unbounded window,
negatives the best rows of other labels in a window that each positive's score spans.

Rows of a block and anchors of a group are bounded in number whatever the table's size; a leaf with most rows
has more blocks. Only the tree and its ranges reach the driver; its size is bounded by ``LEAVES``.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; a
shorter vector counts as padded with zeros; a row with a null id is a candidate, sorts before all ids and
is no anchor; repeated rows are rows of their own, and an anchor leaves out only its own row; scores outside
64 bits are clipped to them; an empty table gives no rows. Only id, vector and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import durable, written
from vacloom.llm.knn import EXACT, SCALE, SLACK, best, matrix, products

ARITY = 8
SAMPLE = 8192  # rows that the split points are chosen from
LEAVES = 1024  # of the tree, at most
LEAF_ROWS = 1024  # aimed at
BLOCK_ROWS = 2048  # of a leaf, solved together
GROUP = 256  # anchors solved together
FIRST, LAST = -(2**63), 2**63 - 1  # ends of an unbounded window


@dataclass
class Tree:
    points: list[np.ndarray]  # of each node
    children: list[list[int]]  # of each node: a node's number, or ~leaf
    leaves: int

    def place(self, v: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Leaf of each row, and for each node (node, rows, child of each, distances to the split points)."""
        leaf, seen, todo = np.zeros(len(v), np.int32), [], [(0, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            far = distances(v[rows], self.points[node])
            child = np.argmin(far, 1)
            seen.append((node, rows, child, far))
            for c, to in enumerate(self.children[node]):
                own = rows[child == c]
                if to < 0:
                    leaf[own] = ~to
                else:
                    todo.append((to, own))
        return leaf, seen


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T), 0))


def fitted(sample: np.ndarray, leaves: int, arity: int = ARITY) -> Tree:
    """Split points chosen far apart, one after the other, until there are ``leaves`` leaves or nothing to part."""
    tree = Tree([], [], 0)
    level, total = [(sample, None)], 1
    while level:
        following = []
        for rows, parent in level:
            node, points = len(tree.points), [0]
            near = distances(rows, rows[:1])[:, 0]
            while len(points) < arity and near.max(initial=0) > 0:
                points.append(int(np.argmax(near)))
                near = np.minimum(near, distances(rows, rows[points[-1:]])[:, 0])
            tree.points.append(rows[points])
            tree.children.append([])
            if parent is not None:
                tree.children[parent[0]][parent[1]] = node
            child = np.argmin(distances(rows, rows[points]), 1)
            total += len(points) - 1
            for c in range(len(points)):
                own = rows[child == c]
                tree.children[node].append(None)
                if total < leaves and len(own) > 2 * arity and len(points) > 1:
                    following.append((own, (node, c)))
                else:
                    tree.children[node][c] = ~tree.leaves
                    tree.leaves += 1
        level = following
    return tree


def whole_rows(table: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """row_id, vec_id, label and the integer vector (as doubles) of every row that takes part."""
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a 64-bit integer in SQL; beyond that a double is whole already.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    name = F.col(label).cast("long") if table.schema[label].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(F.col(label))
    rows = table.filter(F.col(vector).isNotNull() & F.col(label).isNotNull()).filter(finite)
    return durable(rows.select(F.monotonically_increasing_id().alias("row_id"), F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), whole.alias("v")))


def placed(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096].copy()
                part["leaf"] = tree.place(matrix(part["v"], width))[0]
                yield part

    return durable(rows.mapInPandas(place, "row_id long, vec_id long, label long, v array<double>, leaf int"))


def ranges_of(rows: DataFrame, tree: Tree, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each node: least and largest distance of point i to subtree j, and least and largest length there."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                v = matrix(batch["v"].iloc[at : at + 4096], width)
                length = np.sqrt((v**2).sum(1))
                for node, own, child, far in tree.place(v)[1]:
                    table = np.column_stack([far, length[own]])
                    for c in np.unique(child):
                        low, high = table[child == c].min(0), table[child == c].max(0)
                        for i in range(table.shape[1]):
                            a, b = held.get((node, int(c), i), (np.inf, -np.inf))
                            held[node, int(c), i] = min(a, low[i]), max(b, high[i])
        yield pd.DataFrame([(*k, *r) for k, r in held.items()], columns=["node", "child", "point", "low", "high"])

    found = rows.select("v").mapInPandas(measure, "node int, child int, point int, low double, high double")
    merged = found.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # bounded by the tree
    out = []
    for points in tree.points:
        n = len(points)
        out.append((np.full((n + 1, n), np.inf), np.full((n + 1, n), -np.inf)))
    for node, child, point, low, high in merged.itertuples(index=False):
        out[node][0][point, child], out[node][1][point, child] = low, high
    return out


def reached(tree: Tree, ranges: list, v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which leaves the window ``low`` to ``high`` of each query may meet: queries by leaves."""
    out, length = np.zeros((len(v), tree.leaves), bool), (v**2).sum(1)
    low, high = np.where(low == FIRST, -np.inf, low), np.where(high == LAST, np.inf, high)
    todo = [(0, np.flatnonzero(low <= high))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        near, far = (r[:-1] for r in ranges[node])
        short, long = (r[-1] for r in ranges[node])
        filled = short <= long
        a = length[rows][:, None]
        with np.errstate(invalid="ignore"):
            slack = SLACK * (a + long**2 + np.abs(np.where(np.isfinite(low[rows]), low[rows], 0))[:, None] + 1)
            outer = np.sqrt(np.maximum(a + long**2 - 2 * low[rows][:, None] + slack, 0))
            inner = np.sqrt(np.maximum(a + short**2 - 2 * high[rows][:, None] - slack, 0))
        d = distances(v[rows], tree.points[node])
        slack = SLACK * (d.max(1, initial=0)[:, None] + np.sqrt(a) + 1) + 1e-6
        keep = np.broadcast_to(filled, outer.shape).copy()
        keep &= a + long**2 - 2 * low[rows][:, None] >= -1e-6 * (a + long**2 + 1)
        for i in range(len(d[0])):
            at = d[:, i : i + 1]
            keep &= (near[i] <= at + outer + slack) & (far[i] >= at - outer - slack) & (far[i] >= inner - at - slack)
        for c, to in enumerate(tree.children[node]):
            own = rows[keep[:, c]]
            if to < 0:
                out[own, ~to] = True
            else:
                todo.append((to, own))
    return out


def _bytes(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _vectors(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest floats that hold them."""
    return _bytes(v, np.float32 if np.abs(v).max(initial=0) < 1 << 24 else np.float64)


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * rows * width else np.float64
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def blocks_of(data: DataFrame, leaves: DataFrame, width: int) -> DataFrame:
    """(leaf, block) with the packed rows of each block."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(
            rows["leaf"].iloc[0], rows["block"].iloc[0], _bytes(rows["row_id"], np.int64), _bytes(rows["vec_id"].isna(), bool),
            _bytes(rows["vec_id"].fillna(0), np.int64), _bytes(rows["label"], np.int64), _vectors(matrix(rows["v"], width)))],
            columns=["leaf", "block", "rows", "nulls", "ids", "labels", "vectors"])

    dealt = data.join(F.broadcast(leaves.select("leaf", "blocks")), "leaf").withColumn("block", F.expr("cast(pmod(xxhash64(row_id), blocks) as int)"))
    return written(dealt.groupBy("leaf", "block").applyInPandas(
        pack, "leaf int, block int, rows binary, nulls binary, ids binary, labels binary, vectors binary"), "blocks")


def grouped(anchors: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """A row for each group of anchors, packed with their windows (row_id, w, low, high)."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(
            rows["group"].iloc[0], *[_bytes(rows[c], np.int64) for c in ("row_id", "label", "leaf", "w", "low", "high")], _vectors(matrix(rows["v"], width)))],
            columns=["group", "q_rows", "q_labels", "q_leaf", "w", "low", "high", "q_vectors"])

    return anchors.join(windows, "row_id").groupBy("group").applyInPandas(
        pack, "group int, q_rows binary, q_labels binary, q_leaf binary, w binary, low binary, high binary, q_vectors binary")


def routed(groups: DataFrame, tree: Tree, ranges: list, counts: np.ndarray, width: int, own: bool) -> DataFrame:
    """Each group with every block of a leaf that one of its windows may meet, and which of them."""
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                leaf, low, high = (np.frombuffer(b, np.int64) for b in (row.q_leaf, row.low, row.high))
                mine = leaf[:, None] == np.arange(tree.leaves)
                if own:
                    meets = mine & (low <= high)[:, None]
                else:
                    v = _unpacked(row.q_vectors, len(leaf), width)
                    meets = reached(tree, ranges, v, low.astype(np.float64), high.astype(np.float64)) & ~mine
                at = np.flatnonzero(meets.any(0))
                to = np.repeat(at, counts[at])
                yield pd.DataFrame({
                    "group": row.group, "leaf": to, "block": np.concatenate([np.arange(counts[x]) for x in at]) if len(at) else [],
                    "asked": [_bytes(meets[:, x], bool) for x in to]}).astype({"leaf": "int32", "block": "int32"})

    return groups.mapInPandas(route, "group int, leaf int, block int, asked binary")


def solved(routes: DataFrame, groups: DataFrame, blocks: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """Each task's best k rows of every window that it meets: row_id, w, found row, vec_id, score."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def told() -> pa.RecordBatch:
            rows = [(*key, *one) for key, kept in held.items() for one in kept]
            held.clear()
            q, w, score, _, _, row, vec = zip(*rows) if rows else ((),) * 7
            columns = (q, w, row, vec, [-s for s in score])
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["row_id", "w", "found", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                asked = np.flatnonzero(np.frombuffer(r["asked"], bool))
                q_rows, q_labels, ws, lows, highs = (np.frombuffer(r[c], np.int64) for c in ("q_rows", "q_labels", "w", "low", "high"))
                row, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
                nulls = np.frombuffer(r["nulls"], bool)
                single, place = np.unique(q_rows[asked], return_index=True)
                v = _unpacked(r["q_vectors"], len(q_rows), width)[asked[place]]
                scores = products(v, _unpacked(r["vectors"], len(row), width))
                for i in asked:
                    key, own = (int(q_rows[i]), int(ws[i])), scores[np.searchsorted(single, q_rows[i])]
                    kept = held.setdefault(key, [])
                    low = max(int(lows[i]), -kept[-1][0]) if len(kept) == k else int(lows[i])
                    fits = (own >= low) & (own <= highs[i]) & ((labels == q_labels[i]) == same) & (row != q_rows[i])
                    at = np.flatnonzero(fits)
                    if len(at):
                        at = at[best(own[at], ids[at], nulls[at], k)]
                        new = [(-int(own[p]), not nulls[p], int(ids[p]), int(row[p]), None if nulls[p] else int(ids[p])) for p in at]
                        held[key] = sorted(kept + new, key=lambda one: one[:4])[:k]
                if len(held) > 200_000:  # bounds what a task keeps; the same windows may be told again
                    yield told()
        yield told()

    joined = routes.join(groups, "group").join(blocks, ["leaf", "block"])
    return joined.select("asked", "q_rows", "q_labels", "w", "low", "high", "q_vectors", "rows", "nulls", "ids", "labels", "vectors").mapInArrow(
        solve, "row_id long, w long, found long, vec_id long, score long")


@dataclass
class Index:
    tree: Tree
    ranges: list
    blocks: DataFrame
    anchors: DataFrame
    counts: np.ndarray  # blocks of each leaf
    width: int

    def search(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each window (row_id, w, low, high): row_id, w, rank, found, vec_id, score."""
        order = [F.desc("score"), F.asc_nulls_first("vec_id"), F.asc("found")]
        by = Window.partitionBy("row_id", "w").orderBy(*order)

        def ranked(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

        def run(asked: DataFrame, own: bool) -> DataFrame:
            groups = written(grouped(self.anchors, asked, self.width), "groups")
            routes = routed(groups, self.tree, self.ranges, self.counts, self.width, own)
            return written(ranked(solved(routes, groups, self.blocks, self.width, k, same)), "best")

        near = run(windows, True)
        floor = near.filter(F.col("rank") == k).select("row_id", "w", F.col("score").alias("floor"))
        narrowed = windows.join(floor, ["row_id", "w"], "left").select(
            "row_id", "w", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")
        far = run(narrowed, False)
        return ranked(near.unionAll(far).drop("rank"))


def built(table: DataFrame, is_anchor: Column, vec_id: str, vector: str, label: str, leaf_rows: int, block_rows: int, group: int) -> Index | None:
    spark, rows = table.sparkSession, whole_rows(table, vec_id, vector, label)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not total["n"]:
        return None
    sample = rows.select("v").orderBy(F.xxhash64("v"), "row_id").limit(SAMPLE).toPandas()["v"]
    tree = fitted(matrix(sample, total["width"]), min(LEAVES, -(-total["n"] // leaf_rows)))
    data = placed(rows, tree, total["width"])
    sizes = data.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors")).toPandas()  # a row a leaf
    counts = np.zeros(tree.leaves, np.int64)
    counts[sizes["leaf"].to_numpy()] = -(-sizes["n"].to_numpy() // block_rows)
    dealt, at, filled = [], 0, 0
    for leaf, n in sorted(zip(sizes["leaf"].tolist(), sizes["anchors"].tolist())):
        if filled and filled + n > group:
            at, filled = at + 1, 0
        parts = max(1, -(-n // group))
        dealt.append((leaf, int(counts[leaf]), at, parts))
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)
    leaves = spark.createDataFrame(dealt, "leaf int, blocks int, first_group int, parts int")
    anchors = data.filter(is_anchor).join(F.broadcast(leaves), "leaf").withColumn(
        "group", F.expr("cast(first_group + pmod(xxhash64(row_id), parts) as int)"))
    anchors = durable(anchors.select("group", "leaf", "row_id", "vec_id", "label", "v"))
    return Index(tree, ranges_of(data, tree, total["width"]), blocks_of(data, leaves, total["width"]), anchors, counts, total["width"])


def hard_negatives(table: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS, group: int = GROUP) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score is
    ``low`` to ``high`` percent of that row's: anchor_id, positive_id, rank, negative_id and both scores.

    ``is_anchor`` is a condition on the column ``vec_id``.
    """
    index = built(table, is_anchor, vec_id, vector, label, leaf_rows, block_rows, group)
    if index is None:
        return table.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    open_window = index.anchors.select("row_id", F.lit(0).cast("long").alias("w"), F.lit(FIRST).alias("low"), F.lit(LAST).alias("high"))
    best_rows = durable(index.search(open_window, positives, True).select(
        "row_id", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # score = 100 a + b with 0 <= b < 100, so that no product leaves 64 bits
    b = F.pmod("positive_score", F.lit(100).cast("long"))
    a = F.expr("positive_score div 100") - F.when((F.col("positive_score") < 0) & (b > 0), 1).otherwise(0)
    windows = best_rows.select(
        "row_id", "w", (a * low + F.ceil(b * low / 100)).cast("long").alias("low"), (a * high + F.floor(b * high / 100)).cast("long").alias("high"))
    found = index.search(windows, negatives, False)
    named = index.anchors.select("row_id", F.col("vec_id").alias("anchor_id"))
    return found.join(best_rows, ["row_id", "w"]).join(named, "row_id").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
