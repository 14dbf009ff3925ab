"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule, so a policy (a version with a set of rules) and its ablations are bit operations on the ledger;
no text is read again.

Defined results: a null, empty or blank text has no words, measures 0 everywhere and fails
``few_words``. Repeated rows are judged one by one. Very long texts stay in one row; the repeat search
sorts the windows of that row, O(n log n). Columns of the input other than the text are carried as they
are; names starting with ``_q_`` are the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacloom.llm.common import word_array

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_chars_total"]


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: Bit positions are places in this list. New rules are appended so that old ledgers keep their meaning.
RULES = [
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
]
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: list[Rule] = RULES) -> int:
        places = {r.name: i for i, r in enumerate(rules)}
        return sum(1 << places[name] for name in self.rules)


BASE_POLICY = Policy("base", BASE)
STRICT_POLICY = Policy("v1", tuple(r.name for r in RULES))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every document to its row."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumns({"_q_words": word_array(F.col(text)), "_q_lines": lines})
    rows = rows.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_letters": F.length(F.regexp_replace(body, r"[^\p{L}\p{M}]+", "")).cast("long"),
        "n_chars_total": F.length(body).cast("long"),
        "_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)),
    }).drop("_q_words", "_q_lines")
    starts = F.sequence(F.lit(1), F.size("_q_hash") - (WINDOW - 1))
    windows = F.when(
        F.size("_q_hash") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_q_hash", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_q_windows", windows).drop("_q_hash")
    repeated = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    rows = rows.withColumn("_q_sorted", F.when(repeated, F.array_sort(
        F.transform("_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    ))).drop("_q_windows")

    def has_twin(window: Column, i: Column) -> Column:
        before = F.get(F.col("_q_sorted"), i - 1)["h"]
        after = F.get(F.col("_q_sorted"), i + 1)["h"]
        return before.eqNullSafe(window["h"]) | after.eqNullSafe(window["h"])

    places = F.sort_array(F.transform(F.filter("_q_sorted", has_twin), lambda w: w["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda acc, at: F.struct((acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words"), at.alias("last")),
        lambda acc: acc["words"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # A generator is a fence: a later filter on a measurement is not rewritten into one on the text,
    # which would measure the text again for each use.
    fenced = F.inline(F.array(F.struct(*[F.col(c).alias(c) for c in MEASURES])))
    return rows.select(*[c for c in docs.columns if c not in MEASURES], fenced)


def ledger(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Measurements and ``fail_bits``: bit i is set where rule i fails."""
    bits = [F.when(F.expr(f"coalesce({r.fails}, true)"), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    return measured(docs, text).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def verdict(policy: Policy, rules: list[Rule] = RULES) -> Column:
    """True where a ledger row passes all rules of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(book: DataFrame, policies: list[Policy], rules: list[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, and those that only this rule rejects.

    Bit patterns are counted first (at most two to the power of the number of rules remain), so the
    corpus is aggregated once for all policies.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(r).alias("rule"), F.lit(p.mask(rules)).alias("mask"),
                 F.lit(Policy("", (r,)).mask(rules)).alias("bit"))
        for p in policies for r in p.rules
    ]
    rows = patterns.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this_rule"),
        F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("n_rejected_by_policy"),
    )


def quality_filter(docs: DataFrame, policy: Policy = STRICT_POLICY) -> DataFrame:
    """Documents that pass the policy, with the columns they came with."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_q_row"), docs["text"].alias("_q_text"))
    kept = ledger(inner, "_q_text").filter(verdict(policy))
    return kept.select("_q_row.*")
