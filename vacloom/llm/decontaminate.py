"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark texts.

A text is normalised to its words, A to Z lower-cased, with one space around each. A window is ``width``
consecutive words of an item; an item with fewer words is one window. Every normalised text runs through
the automaton once; a match is a run of whole words, and its words are mapped back to code points of the
text as it came.

The automaton goes to every worker, so its patterns are bounded (``PATTERN_BYTES``). A benchmark with more
is cut into parts by a hash of the window, each with its own automaton and scan; what the parts find in a
document is then put together.

Defined results: a null text has no words and no windows; an item without id has windows but is not named
among ``items``; rows with one item id are one item; repeated documents are rows of their own; empty tables
give no rows or no hits. Only ids and texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacloom.llm.common import written

WIDTH = 10
PATTERN_BYTES = 4 << 20  # of the windows in one automaton, which takes some 30 times as much memory
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value of the contract: what makes up a word once A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a text to bytes of its normal form, at the same places: a letter of a word, or a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = re.compile(rb"[^ ]+")


def windows_of(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): each distinct window with the sorted ids of the items that hold it."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.col(item_id).cast("string").alias("item"), words.alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(width - 1), F.lit(1))
    at = rows.select("item", "words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    windows = at.select("item", F.array_join(F.slice("words", F.col("at"), F.lit(width)), " ").alias("window")).distinct()
    return windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def automaton_of(windows: list[str]) -> ahocorasick.Automaton:
    """Bytes stand as code points below 256, which keeps states narrow; the value of a match is its window's number."""
    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, window in enumerate(windows):
        built.add_word(f" {window} ".encode().decode("latin-1"), number)
    if windows:
        built.make_automaton()
    return built


def hits_in(normal: bytes, words: list[bytes], automaton: ahocorasick.Automaton, windows: list[str]) -> tuple[list, set]:
    """Spans of hit words as (first word, end word, code point, end code point), merged, and the windows found."""
    joined = b" " + b" ".join(words) + b" "
    matches = list(automaton.iter(joined.decode("latin-1")))
    if not matches:
        return [], set()
    found = {number for _, number in matches}
    size = {number: len(windows[number].encode()) + 1 for number in found}
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.array([end for end, _ in matches])
    starts = ends - np.array([size[number] for _, number in matches])
    first, last = np.searchsorted(spaces, starts), np.searchsorted(spaces, ends)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, last, -1)
    inside = np.concatenate([[0], np.cumsum(covered[:-1]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return edges.tolist(), found


def in_original(data: bytes, normal: bytes, edges: list) -> list[dict]:
    """The spans of words as code points of the text as it came, end exclusive."""
    places = [m.span() for m in RUN.finditer(normal)]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"first": a, "words": b - a, "start": int(points[places[a][0]]), "end": int(points[places[b - 1][1]])} for a, b in edges]


SPAN = "array<struct<first:int,words:int,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "words", "start", "end")]))


def scanned(docs: DataFrame, windows: list[tuple[str, list[str]]], doc_id: str, text: str) -> DataFrame:
    """Each row's doc_id, text_hash, n_words, spans and items, from one automaton over ``windows``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names, owners = [w for w, _ in windows], [i for _, i in windows]
    held: list = []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(automaton_of(names))
        for batch in batches:
            n_words, spans, items = [], [], []
            for value in batch.column(1).cast(pa.large_binary()):
                data = value.as_py() or b""
                normal = data.translate(PLAIN)
                words = normal.split()
                edges, found = hits_in(normal, words, held[0], names) if words and names else ([], ())
                n_words.append(len(words))
                spans.append(in_original(data, normal, edges) if edges else [])
                items.append(sorted({i for number in found for i in owners[number]}))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "text_hash", "n_words", "spans", "items"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    return rows.mapInArrow(scan, f"doc_id {kind}, text_hash long, n_words long, spans {SPAN}, items array<string>")


def _merged(one: Column, other: Column) -> Column:
    """The union of two lists of spans."""
    ordered = F.array_sort(F.concat(one, other))

    def join(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (span["first"] <= last["first"] + last["words"])
        grown = F.struct(
            last["first"].alias("first"),
            (F.greatest(last["first"] + last["words"], span["first"] + span["words"]) - last["first"]).alias("words"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    return F.reduce(ordered, F.array().cast(SPAN), join)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids as strings) and spans.

    A span is a run of hit words: its first word and number of words, and its code points in the text.
    """
    windows = written(windows_of(items, width, item_id, item_text), "windows")
    weight = F.octet_length("window") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 8), F.lit(0))
    total = windows.agg(F.sum(weight.cast("long")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // pattern_bytes))

    def part(number: int) -> DataFrame:
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == number).collect()  # some pattern_bytes
        return scanned(docs, [(r["window"], r["items"]) for r in own], doc_id, text)

    found = part(0)
    if parts > 1:  # a text's parts meet again by id and hash; repeated rows find the same
        more = [written(part(p).filter(F.size("spans") > 0).drop("n_words"), "hits") for p in range(1, parts)]
        keyed = reduce(DataFrame.unionAll, more).dropDuplicates(["doc_id", "text_hash", "spans", "items"])
        keyed = keyed.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(
            F.flatten(F.collect_list("spans")).alias("k_spans"), F.flatten(F.collect_list("items")).alias("k_items"))
        same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
        found = found.join(keyed, same, "left").select(
            "doc_id", "n_words", _merged(F.col("spans"), F.coalesce("k_spans", F.array().cast(SPAN))).alias("spans"),
            F.array_sort(F.array_distinct(F.concat("items", F.coalesce("k_items", F.array().cast("array<string>"))))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")
