"""N-gram Jaccard join: size-aware, heavy and light.

Documents with equal shingle sets are one node. Let a set of size n need ``c(n) = ceil(t * n)`` common
shingles with any partner, and order shingles by hash; then two linked sets share k shingles within the
first ``n - c(n) + k`` of each.

Small sets list all pairs (subsets of fixed size two) of their first ``n - c(n) + 2`` shingles; linked small
sets share such a pair. Large sets, and small ones near enough to the boundary to link with one, post a pool
of their first shingles to inverted lists; a set whose pool has too few shared shingles has no partner. The
boundary between small and large is the size at which the cost, counted over the histogram of all sizes, is
least. The whole sets of those that are left are read, and of their inverted lists only the rarest are
scanned, as many as the overlap with a partner allows to leave out.

Sets that a list brings together are verified exactly, block against block: intersections are counted by
matrix products in memory of a fixed size, and of the links only a spanning forest and each node's count leave a task. So a group
of thousands of near copies makes no rows for its pairs, and no link between parts is lost.

Defined results: a null, empty or blank text has an empty set and no links; a text shorter than k words is
one shingle; repeated rows and null ids are documents of their own (a component is named by its smallest
non-null id); an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm import shingles
from vacloom.llm.common import discard, durable, numbered, written_at
from vacloom.llm.components import components

FILTER_BITS = 1 << 26  # of the filter that finds the documents whose sets are read; 8 MB
SLICES = 64  # of the rows that repeat a document that stays
BLOCK = 256  # nodes that are verified together
SCAN_COST = 3.0  # what a posting in an inverted list costs, in rows of enumerated subsets


@dataclass(frozen=True)
class Similarity:
    """Linked where ``den * intersection >= num * union`` over sets of k-word shingles."""

    k: int = 5
    num: int = 80
    den: int = 100

    def common(self, n):
        """Least intersection of a set of size n with any partner; also the least size of one."""
        return -(-self.num * n // self.den)

    def spare(self, n):
        return n - self.common(n) + 1

    def margin(self, n):
        """How many shared shingles a pool is made to hold."""
        return np.minimum(self.spare(n), self.common(n))

    def pool(self, n):
        return n - self.common(n) + self.margin(n)


def boundary(sizes: np.ndarray, counts: np.ndarray, how: Similarity) -> int:
    """The largest size of a small set for which enumerating and scanning together cost least."""
    if not len(sizes):
        return 1
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(float)
    prefix = np.minimum(how.spare(sizes) + 1, sizes)
    enumerate_cost = np.concatenate([[0], np.cumsum(counts * prefix * (prefix - 1) / 2)])
    scan_cost = np.concatenate([[0], np.cumsum(SCAN_COST * counts * how.pool(sizes))])
    choices = np.concatenate([[1], sizes])
    near = np.searchsorted(sizes, how.common(choices + 1))
    return int(choices[np.argmin(enumerate_cost[np.searchsorted(sizes, choices, "right")] + scan_cost[-1] - scan_cost[near])])


def described(docs: DataFrame, how: Similarity, doc_id: str, text: str) -> DataFrame:
    """One row per document: row_id, id, hash of the text, set size, two hashes of the set and its first shingles."""
    return described_at(docs, how, doc_id, text)[0]


def described_at(docs: DataFrame, how: Similarity, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """As ``described``, with the table's folder."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            n, h1, h2, first = [], [], [], []
            for words in shingles.words_of(batch.column(1)):
                own = shingles.shingle_set(words, how.k)
                n.append(len(own))
                h1.append(int(shingles.mix(own + shingles.STEP).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(shingles.mix(own ^ shingles.RATIO)).view(np.int64)) if len(own) else 0)
                key = (h1[-1], h2[-1])
                few = max(int(how.pool(len(own))), int(how.spare(len(own))) + 1)
                first.append(None if key in seen or len(own) < 2 else own[:few].tobytes())
                if len(seen) < 1_000_000:  # only spares repeating the shingles of copies within a task
                    seen.add(key)
            yield pa.record_batch([
                pa.array(range(row, row + len(n)), pa.int64()), batch.column(0), batch.column(2), pa.array(n, pa.int64()),
                pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(first, pa.binary())],
                ["row_id", "doc_id", "text_hash", "n", "h1", "h2", "first"])
            row += len(n)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return written_at(rows.mapInArrow(describe, f"row_id long, doc_id {kind}, text_hash long, n long, h1 long, h2 long, first binary"), "shingles")


def _unpacked(nodes: DataFrame, packed: str, keys_of) -> DataFrame:
    """(key, node, n) for every key that ``keys_of(shingles, n)`` gives a node."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                node, n = (part.column(i).to_numpy() for i in (0, 1))
                keys = [keys_of(np.frombuffer(x.as_buffer(), np.uint64), int(m)) for x, m in zip(part.column(2), n)]
                times = [len(x) for x in keys]
                if sum(times):
                    yield pa.record_batch([
                        pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(node, times)), pa.array(np.repeat(n, times))],
                        ["key", "node", "n"])

    return nodes.select("node", "n", packed).mapInArrow(unpack, "key long, node long, n long")


def survivors(nodes: DataFrame, how: Similarity, small: int) -> DataFrame:
    """Nodes that share a pair of shingles (small), or enough of their pool (large), with others."""
    def subsets(first: np.ndarray, n: int) -> np.ndarray:
        prefix = first[: min(n, int(how.spare(n)) + 1)]
        i, j = np.triu_indices(len(prefix), 1)
        return shingles.mix(prefix[i] * shingles.STEP + prefix[j])

    def pool(first: np.ndarray, n: int) -> np.ndarray:
        return first[: int(how.pool(n))]

    light = _shared(_unpacked(nodes.filter(F.col("n") <= small), "first", subsets)).select("node").distinct()
    heavy = _shared(_unpacked(nodes.filter(F.col("n") >= int(how.common(small + 1))), "first", pool))
    partner = _common_sql("n", how)
    margin = f"least({partner} - {_common_sql(partner, how)} + 1, {_common_sql(partner, how)})"
    heavy = heavy.groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= F.expr(margin)).select("node")
    return light.unionAll(heavy).distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """Keys held by more than one node, with the number of their members."""
    return rows.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("members > 1")


def scanned_lists(sets: DataFrame, how: Similarity) -> DataFrame:
    """(key, node): for each node its rarest inverted lists, so many that no partner is in none of them.

    Of n shingles all but ``c(n) - 1`` would have to be scanned, rarest first; those that nobody else holds
    come first and need no scan. A node with more of them than may differ has no partner.
    """
    rows = _shared(_unpacked(sets.select("node", "n", "set"), "set", lambda own, n: own))
    lists = rows.groupBy("node", "n").agg(F.collect_list(F.struct("members", "key")).alias("own"))
    lists = lists.withColumn("scan", (F.size("own") - F.expr(_common_sql("n", how)) + 1).cast("int")).filter("scan > 0")
    return lists.select("node", F.explode(F.slice(F.array_sort("own"), F.lit(1), F.col("scan"))).alias("e")).select(F.col("e.key").alias("key"), "node")


def _common_sql(n: str, how: Similarity) -> str:
    return f"((({n}) * {how.num} + {how.den - 1}) div {how.den})"


def blocks_of(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block), and the pairs of blocks (low, high) whose members share a list.

    Nodes that lists connect form clusters. Small clusters are put together to blocks by a hash; a large one
    is cut into blocks by rank, and two of its blocks meet only if a list has members in both.
    """
    hub = Window.partitionBy("key")
    pairs = lists.withColumn("b", F.min("node").over(hub)).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    clusters = components(pairs).withColumnRenamed("label", "cluster")
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    small = sized.filter(F.col("size") < BLOCK // 4)
    parts = max(1, -(-small.count() // (BLOCK // 2)))
    small = small.select("node", F.xxhash64(F.lit(0), F.pmod(F.xxhash64("cluster"), F.lit(parts))).alias("block"))
    large = numbered(sized.filter(F.col("size") >= BLOCK // 4), ["cluster"], ["node"], "rank")
    large = large.select("node", F.xxhash64(F.lit(1), "cluster", F.floor(F.col("rank") / BLOCK)).alias("block"))
    placed = durable(small.unionAll(large))
    here = lists.join(placed, "node").select("key", "block").distinct()
    meet = here.select("key", F.col("block").alias("low")).join(here.select("key", F.col("block").alias("high")), "key").filter("low <= high")
    return placed, meet.select("low", "high").distinct()


def _linked_pairs(sizes: np.ndarray, tokens: np.ndarray, owners: np.ndarray, how: Similarity) -> np.ndarray:
    """Which of the sets are linked, from intersections counted a few thousand shingles at a time."""
    m = len(sizes)
    _, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
    held = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[held]]
    order = np.argsort(column, kind="stable")
    column, owner, common = column[order], owners[held][order], np.zeros((m, m), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [low, low + 2048])
        present = np.zeros((m, 2048), np.float32)
        present[owner[i:j], column[i:j] - low] = 1
        common += present @ present.T
    common = common.astype(np.int64)
    return how.den * common >= how.num * (sizes[:, None] + sizes[None, :] - common)


def verified_links(placed: DataFrame, meet: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """(a, b, links): for each node of two blocks that meet, a linked node it hangs on (or itself) and its links across them.

    The links from a to b connect all linked sets. A linked pair shares a list, so its blocks meet exactly
    once, and the sums of ``links`` count each node's links, a link to each copy of a set counted.
    """
    sides = meet.select("low", "high", F.col("low").alias("block")).unionAll(
        meet.filter("low < high").select("low", "high", F.col("high").alias("block")))
    rows = sides.join(placed, "block").join(sets.select("node", "set"), "node").select("low", "high", "block", "node", "copies", "set")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in rows["set"]]
        sizes, node = np.array([len(x) for x in own], np.int64), rows["node"].to_numpy()
        links = _linked_pairs(sizes, np.concatenate(own), np.repeat(np.arange(len(own)), sizes), how)
        label = np.arange(len(own))
        while True:
            near = np.where(links, label[None, :], len(own)).min(1)
            near = np.minimum(near, label)
            near = near[near]
            if (near == label).all():
                break
            label = near
        block, copies = rows["block"].to_numpy(), rows["copies"].to_numpy(np.int64)
        np.fill_diagonal(links, False)
        if rows["low"].iloc[0] != rows["high"].iloc[0]:
            links &= block[:, None] != block[None, :]  # those within a block are counted where it meets itself
        found = np.where(links, copies[None, :], 0).sum(1)
        told = (found > 0) | (label != np.arange(len(own)))
        return pd.DataFrame({"a": node[told], "b": node[label[told]], "links": found[told]})

    return durable(rows.groupBy("low", "high").applyInPandas(verify, "a long, b long, links long"))


def _document_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.xxhash64(F.col(text)))


def _filter_words(keys: DataFrame) -> DataFrame:
    """(word, bits): a bit for each possible remainder of a key; at most ``FILTER_BITS`` / 64 rows, whatever the number of keys."""
    place = F.pmod("key", F.lit(FILTER_BITS))
    return keys.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {FILTER_BITS}) % 64 as int))")).alias("bits"))


def _key_filter(keys: DataFrame) -> np.ndarray:
    found, out = _filter_words(keys).toPandas(), np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def whole_sets(docs: DataFrame, nodes: DataFrame, how: Similarity, doc_id: str, text: str) -> DataFrame:
    return whole_sets_at(docs, nodes, how, doc_id, text)[0]


def whole_sets_at(docs: DataFrame, nodes: DataFrame, how: Similarity, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """(node, n, set) of the nodes given, read from the text of the document that stands for each; and the table's folder.

    Texts stay where they are: a bit filter passes over most documents that are not asked for, and only sets
    are shuffled. What the filter lets through wrongly goes in the join.
    """
    wanted = durable(nodes.select("node", F.xxhash64("doc_id", "text_hash").alias("key")))
    bits = _key_filter(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(0).to_numpy() % FILTER_BITS
            asked = pa.array((bits[place // 8] >> (place % 8)) & 1 == 1)
            batch = batch.filter(asked)
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [shingles.shingle_set(words, how.k) for words in shingles.words_of(part.column(1))]
                yield pa.record_batch(
                    [part.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["key", "n", "set"])

    found = docs.select(_document_key(doc_id, text).alias("key"), F.col(text)).mapInArrow(read, "key long, n long, set binary")
    # A repeated row brings the same set again.
    return written_at(found.repartition("key").groupBy("key", "n").agg(F.max("set").alias("set")).join(wanted, "key").select("node", "n", "set"), "sets")


def linked(docs: DataFrame, how: Similarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: row_id, doc_id, n_shingles, node (documents with equal sets share one), component and number of links."""
    rows, rows_path = described_at(docs, how, doc_id, text)
    filled = rows.filter("n > 0")
    groups = filled.groupBy("h1", "h2", "n").agg(F.min_by(F.struct("row_id", "doc_id", "text_hash"), "row_id").alias("r"), F.count(F.lit(1)).alias("copies"))
    groups = durable(groups.select("h1", "h2", "n", "copies", F.col("r.row_id").alias("node"), "r.doc_id", "r.text_hash"))
    histogram = groups.groupBy("n").agg(F.count(F.lit(1)).alias("sets")).toPandas()  # a row for each set size
    small = boundary(histogram["n"].to_numpy(), histogram["sets"].to_numpy(), how)
    firsts = rows.select(F.col("row_id").alias("node"), "n", "first").filter("first is not null").join(groups.select("node"), "node", "left_semi")
    wanted = durable(groups.join(survivors(firsts, how, small), "node", "left_semi"))
    rows = durable(rows.drop("first"))
    discard(docs.sparkSession, rows_path)  # most of it are first shingles, which nothing reads from here on
    sets, sets_path = whole_sets_at(docs, wanted, how, doc_id, text)
    lists = durable(scanned_lists(sets, how))
    placed, meet = blocks_of(lists)
    links = verified_links(placed.join(groups.select("node", "copies"), "node"), meet, sets, how)
    discard(docs.sparkSession, sets_path)
    labels = components(links.filter("a <> b").select("a", "b"))
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    named = groups.join(labels, "node", "left").join(counted, "node", "left").select(
        "h1", "h2", "n", "node", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("row_id", "doc_id", "text_hash", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left").select(
        "row_id", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("node", "row_id").alias("node"),
        F.coalesce("label", "row_id").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, how: Similarity, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id of its component), n_links, node and row_id."""
    found = durable(linked(docs, how, doc_id, text))
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "component").select("row_id", "doc_id", "n_shingles", "component_id", "n_links", "node", "text_hash", "component")


def one_of_each(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Documents without all but the first (smallest id, then text) of each component; columns as they came.

    Where rows with one id and one text are first, the one with the smallest other columns stays. Texts without
    shingles have no copies, so all of them stay.
    """
    found = linked(docs, how)
    key = ["component", "doc_id", "text_hash"]
    counted = durable(found.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("n")))
    first = counted.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("f"))
    chosen = counted.join(first, "component").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("text_hash") == F.col("f.text_hash")))
    # Keys that some row has to go from; the rows of all other keys stay where they are, and no text moves for them.
    contested = durable(chosen.filter(~F.col("stays") | ((F.col("rows") > 1) & (F.col("n") > 0))).groupBy(
        F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.max("stays").alias("stays")))
    words = _filter_words(contested.select(F.xxhash64("k_id", "k_hash").alias("key")))
    place = F.pmod(_document_key("doc_id", "text"), F.lit(FILTER_BITS))
    marked = docs.withColumn("_place", place).join(F.broadcast(words), F.floor(F.col("_place") / 64).cast("int") == F.col("word"), "left").withColumn(
        "_hit", F.coalesce(F.getbit("bits", (F.col("_place") % 64).cast("int")) == 1, F.lit(False)))
    matches = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    clear = marked.filter(~F.col("_hit")).select(docs.columns)
    doubtful = marked.filter("_hit").select(docs.columns).withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(SLICES)).cast("int"))
    wrongly = doubtful.join(contested, matches, "left_anti").select(docs.columns)
    # The rows of a key are joined in slices and brought down to one within each task, however many there are.
    asked = contested.filter("stays").withColumn("_k_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    rows = doubtful.join(asked, matches & (F.col("_slice") == F.col("_k_slice"))).groupBy("k_id", "k_hash").agg(F.min(F.struct(*docs.columns)).alias("r"))
    return clear.unionByName(wrongly).unionByName(rows.select("r.*"))
