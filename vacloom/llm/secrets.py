"""Secret scans with corpus-wide ownership frequency.

Candidates of every text are found once, with their code point spans. Their values are hashed and the
hashes aggregated by distinct owners and repositories over the whole corpus. A value that many owners hold
is a copied example; one that stays with few owners looks live. Strings without a keyword that look
generated are reported as ``generic`` spans only if they are owner-specific or equal a value that a base
pattern found elsewhere.

Defined results: a null or empty text has no spans; null owners and repositories count as one owner
without a name; repeated rows are documents of their own; an empty table gives no rows. Only the columns
named are read, so other columns cannot clash. Values themselves never leave the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacloom.llm.common import durable

#: Fixed values of the contract: kinds in their order, patterns, the group that holds the value, least length of it.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Runs long enough for a key; letters of both cases and a digit are asked for afterwards.
GENERIC = (r"[A-Za-z0-9+/_-]{20,}", 0, 20)
GENERIC_DISTINCT = 12  # distinct characters that a generated string of this length has
COPIED_OWNERS = 3  # held by so many owners, a value is a copied example


def _looks_generated(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= GENERIC_DISTINCT
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & varied


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches in order: text before each, the match itself and its value. Null where there are none."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    rows = F.zip_with(F.zip_with(gaps, F.transform(whole, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("gap"), m.alias("width"))),
                      values, lambda p, v: F.struct(p["gap"].alias("gap"), p["width"].alias("width"), v.alias("value")))
    return F.when(text.rlike(pattern), rows)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document, with the raw matches of each kind. The only pass over the texts."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = {k: _found(text, p, g).alias(k) for k, (p, g, _) in {**KINDS, "generic": GENERIC}.items()}
    return durable(docs.select(
        F.monotonically_increasing_id().alias("row_id"), docs["doc_id"], owner.alias("owner"), repository.alias("repository"),
        *found.values(),
    ))


def mentions(found: DataFrame) -> DataFrame:
    """One row per match that passes its kind's test: span, hash of the value, kind."""
    parts = None
    for place, kind in enumerate([*KINDS, "generic"]):
        least = (KINDS.get(kind) or GENERIC)[2]
        rows = found.filter(F.col(kind).isNotNull()).select(
            "row_id", "owner", "repository", F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.posexplode(kind).alias("i", "m")
        ).filter("m.width is not null")
        upto = Window.partitionBy("row_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.width")).over(upto)).withColumn("start", F.col("end") - F.col("m.width"))
        test = F.length("m.value") >= least
        if kind == "generic":
            test = test & _looks_generated(F.col("m.value"))
        rows = rows.filter(test).select(
            "row_id", "owner", "repository", "kind", "place", "start", "end", F.sha2("m.value", 256).alias("value_hash")
        )
        parts = rows if parts is None else parts.unionAll(rows)
    return parts


def ownership(rows: DataFrame) -> DataFrame:
    """Per value: distinct owners and repositories and mentions, and whether a base pattern found it.

    The first sum runs before the shuffle by (value, owner, repository), so a value that a third of the
    corpus holds arrives as one row per repository and task.
    """
    own = rows.groupBy("value_hash", "owner", "repository").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("kind") != "generic").cast("int")).alias("base")
    )
    per_owner = own.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"), F.max("base").alias("base"))
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_mentions"),
        (F.max("base") == 1).alias("base_value"),
    )


def secret_scan(docs: DataFrame, owner: Column, repository: Column, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per document: counts of base kinds, all spans, and how many values look live or copied."""
    found = candidates(docs, owner, repository)
    rows = durable(mentions(found))
    known = ownership(rows)
    judged = rows.join(known, "value_hash").withColumn("live", F.col("n_owners") < copied_owners)
    judged = judged.filter((F.col("kind") != "generic") | F.col("live") | F.col("base_value"))
    span = F.struct("start", "place", "kind", "end", "live")
    grouped = judged.groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("s"))
    base = F.filter("s", lambda x: x["kind"] != "generic")
    clear = F.filter("s", lambda x: (x["kind"] != "generic") | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    grouped = grouped.withColumn("base", base).withColumn("all", clear)

    def told(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(column: str, test) -> Column:
        return F.size(F.filter(column, test)).cast("long")

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    done = grouped.select(
        "row_id",
        *[count("base", of_kind(k)).alias(f"n_{k}") for k in KINDS],
        told("base").alias("told"), told("all").alias("spans"),
        count("all", lambda x: x["live"]).alias("n_live"), count("all", lambda x: ~x["live"]).alias("n_copied"),
    )
    every = found.select("row_id", "doc_id").join(done, "row_id", "left")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return every.select(
        "doc_id", *zero, F.sha2(F.coalesce("told", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
