"""Personal data by a skip-chain conditional random field.

Mentions are what the base patterns match and what merely looks like it: runs of digits, and addresses with
a spelled-out at sign. A mention has a label (one of the kinds, or none). Neighbouring mentions share a
transition potential; mentions of a document with equal or similar contents, however far apart, share a skip
potential. Each mention of such a group is linked to the base matches of the group around it and to the group's
first mention without one: evidence is one edge away however long the document, and edges grow with the mentions
and not with their square. Loopy message passing, until the messages settle, gives each mention its label's
probability given all others. Base matches are evidence:
their labels are fixed and their spans always stay. A mention that no base pattern matched becomes a span if
the field is sure of a kind.

The potentials are fitted on the mentions of a bounded sample of documents (``SAMPLE_DOCUMENTS``, first in the
order of a hash of their ids): base matches are examples of their kind, other mentions that repeat none of
them weaker examples of none.
Scanning itself reads every whole text.

Defined results: a null or empty text has no spans; repeated rows are documents of their own; a corpus
without mentions is scanned with potentials of zero; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS = 8000
SURE = 0.95
SETTLED = 1e-4  # largest change of a message, in logarithms, that ends the passing
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

#: Fixed values of the contract, with quantifiers that cannot be tried twice where that changes nothing.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What else is a mention: seven digits and more, and addresses that avoid the sign.
DIGITS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)+")
#: Words before a mention that speak for a kind.
CUES = {
    "email": ("email", "e-mail", "mail"), "ip": ("ip", "host", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Left from each at sign as far as the previous match allows; equal to a leftmost search, without its retries."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, by start and then kind."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 14:
            digits = _only_digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_only_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    label: int  # of the base pattern, 0 for none
    same: str  # equal contents
    similar: str  # contents that differ in a prefix only


def mentions(text: str) -> list[Mention]:
    spans = [(s, e, k + 1) for s, k, e in base_spans(text)]
    loose = [(m.start(), m.end(), 0) for m in DIGITS.finditer(text)]
    if "[" in text or "(" in text:
        loose += [(m.start(), m.end(), 0) for m in SPELLED.finditer(text)]
    if loose and spans:
        starts, ends = np.array([s[0] for s in spans]), np.maximum.accumulate([s[1] for s in spans])
        before = np.searchsorted(starts, [x[1] for x in loose])
        loose = [x for x, b in zip(loose, before) if not (b and ends[b - 1] > x[0])]
    out = []
    for start, end, label in sorted(spans + loose):
        piece = text[start:end]
        if any(c.isalpha() for c in piece):
            plain = re.sub(r"\x20?[\[(](?:at|AT)[\])]\x20?", "@", piece)
            plain = re.sub(r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".", plain).lower()
            out.append(Mention(start, end, label, plain, plain.partition("@")[0]))
        else:
            digits = _only_digits(piece)
            out.append(Mention(start, end, label, digits, digits[-9:]))
    return out


def features(text: str, m: Mention) -> list[float]:
    """What a mention looks like, without the signs that the base patterns decide by."""
    piece = text[m.start : m.end]
    digits = sum("0" <= c <= "9" for c in piece)
    before = re.findall(r"[A-Za-z-]+", text[max(0, m.start - 24) : m.start].lower())[-2:]
    letters = any(c.isalpha() for c in piece)
    shape = [
        1.0, letters, not letters and digits < 10, not letters and 10 <= digits <= 13, not letters and 14 <= digits <= 19,
        not letters and digits > 19, "-" in piece, " " in piece, "(" in piece, piece.count(".") == 3, "." in piece,
    ]
    return [float(x) for x in shape] + [float(any(w in before for w in words)) for words in CUES.values()]


@dataclass(frozen=True)
class Field:
    """Potentials, in logarithms: features by label, label by next label, and agreement over skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    same: float
    similar: float


N_FEATURES = 11 + len(CUES)


def empty_field() -> Field:
    return Field(np.zeros((N_FEATURES, len(LABELS))), np.zeros((len(LABELS), len(LABELS))), 0.0, 0.0)


def _groups(keys: list[str]) -> list[tuple[int, int]]:
    """Each place with the next one that has the same key."""
    last: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        if key in last:
            out.append((last[key], i))
        last[key] = i
    return out


def _repeats(keys: list[str], labels: list[int]) -> list[tuple[int, int]]:
    """Each place that has no label with its group's labelled ones next to it and with the first that has none."""
    before: dict[str, int] = {}
    first: dict[str, int] = {}
    out = []
    for i, key in enumerate(keys):
        if labels[i]:
            before[key] = i
            continue
        out += [(x[key], i) for x in (before, first) if key in x]
        first.setdefault(key, i)
    after: dict[str, int] = {}
    for i in range(len(keys) - 1, -1, -1):
        if labels[i]:
            after[keys[i]] = i
        elif keys[i] in after:
            out.append((i, after[keys[i]]))
    return out


def fitted(sample: list[list[tuple[Mention, list[float]]]], weak: float = 0.2, steps: int = 400) -> Field:
    """Multinomial regression for the features and smoothed log odds for the edges."""
    flat = []
    for doc in sample:
        # A repeat of a base match is what the field is to decide, so it is no example of either.
        known = {key for m, _ in doc if m.label for key in (("same", m.same), ("similar", m.similar))}
        flat += [(m, x) for m, x in doc if m.label or not known & {("same", m.same), ("similar", m.similar)}]
    if not flat:
        return empty_field()
    x, y = np.array([f for _, f in flat]), np.array([m.label for m, _ in flat])
    weight, target, unary = np.where(y > 0, 1.0, weak), np.eye(len(LABELS))[y], np.zeros((x.shape[1], len(LABELS)))
    for _ in range(steps):
        z = x @ unary
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        unary -= 1.0 * (x.T @ ((p - target) * weight[:, None]) / weight.sum() + 1e-3 * unary)
    pairs = np.ones((len(LABELS), len(LABELS)))
    agree = {"same": [1.0, 1.0], "similar": [1.0, 1.0]}
    for doc in sample:
        for (a, _), (b, _) in zip(doc, doc[1:]):
            pairs[a.label, b.label] += 1
        for kind in agree:
            for i, j in _groups([getattr(m, kind) for m, _ in doc]):
                if doc[i][0].label and doc[j][0].label:
                    agree[kind][int(doc[i][0].label == doc[j][0].label)] += 1
    chain = 0.5 * np.log(pairs * pairs.sum() / np.outer(pairs.sum(1), pairs.sum(0)))
    # Even without a repeat in the sample, equal contents speak for equal labels.
    odds = {k: float(np.log(yes / no)) for k, (no, yes) in agree.items()}
    return Field(unary, chain, max(6.0, odds["same"]), max(4.0, odds["similar"]))


def beliefs(field: Field, unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Label probabilities by damped loopy message passing. ``potentials[e]`` holds edge e from its first to its second end.

    Messages pass until none changes by more than ``SETTLED``; if they never settle, for as many rounds as there
    are edges (and for those that damping takes).
    """
    n, k = unary.shape
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    along = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), k))
    for _ in range((rounds or len(edges) + 60) if len(edges) else 0):
        total = unary.copy()
        np.add.at(total, target, messages)
        cavity = total[source] - messages[back]
        z = cavity[:, :, None] + along
        top = z.max(1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
        step = 0.5 * (new - new.max(1, keepdims=True) - messages)
        messages = messages + step
        if np.abs(step).max() < SETTLED:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def label_probabilities(field: Field, found: list[Mention], x: np.ndarray) -> np.ndarray:
    unary = x @ field.unary
    for i, m in enumerate(found):
        if m.label:
            unary[i] = -1e4
            unary[i, m.label] = 0
    agree = np.eye(len(LABELS))
    edges, potentials = [], []
    for i in range(len(found) - 1):
        edges.append((i, i + 1))
        potentials.append(field.chain)
    labels = [m.label for m in found]
    same, similar = (_repeats([getattr(m, kind) for m in found], labels) for kind in ("same", "similar"))
    # Equal contents are similar too: between two of them only the stronger potential counts.
    similar = [(i, j) for i, j in similar if found[i].same != found[j].same]
    for pairs, strength in ((same, field.same), (similar, field.similar)):
        edges += pairs
        potentials += [agree * strength] * len(pairs)
    shape = (len(edges), len(LABELS), len(LABELS))
    return beliefs(field, unary, np.array(edges, np.int64).reshape(-1, 2), np.array(potentials, float).reshape(shape))


def all_spans(field: Field, text: str, sure: float = SURE) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind, end)."""
    found = mentions(text)
    base = [(m.start, m.label - 1, m.end) for m in found if m.label]
    if len(base) == len(found):
        return base, base
    p = label_probabilities(field, found, np.array([features(text, m) for m in found]))
    more = [(m.start, int(q.argmax()) - 1, m.end) for m, q in zip(found, p) if not m.label and q.argmax() > 0 and q.max() >= sure]
    return sorted(base), sorted(base + more)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the first one's kind."""
    out, at, end = [], 0, 0
    for s, k, e in spans:
        if s >= end:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit on the mentions of at most ``documents`` documents. Only those mentions reach the driver."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text in enumerate(batch["text"]):
                for m in mentions(text or ""):
                    out.append((doc, m.start, m.end, m.label, m.same, m.similar, features(text, m)))
            yield pd.DataFrame(out, columns=["doc", "start", "end", "label", "same", "similar", "x"])

    part = F.spark_partition_id().alias("part")
    found = rows.mapInPandas(extract, "doc long, start long, end long, label long, same string, similar string, x array<double>")
    table = found.select(part, "*").toPandas()
    sample: dict = {}
    for r in table.sort_values(["part", "doc", "start", "end", "label"]).itertuples():
        sample.setdefault((r.part, r.doc), []).append((Mention(r.start, r.end, r.label, r.same, r.similar), list(r.x)))
    return fitted(list(sample.values()))


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document: counts of base kinds, hash of the base spans, all spans and their number."""
    field = field or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(field, text or "")
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(i) for i in range(len(KINDS))], hashlib.sha256(told(base).encode()).hexdigest(), told(spans), len(spans)))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names[1:]]
            types = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    schema = ", ".join([f"doc_id {kind}", *[f"n_{k} long" for k in KINDS], "base_sha256 string", "spans string", "n_spans long"])
    return docs.select("doc_id", "text").mapInArrow(read, schema)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with personal data masked, columns as they came; a column ``n_chars`` follows the text."""
    field = field or fit(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(field, t)[1]) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string())}
            yield pa.record_batch(list(columns.values()), list(columns))

    out = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
