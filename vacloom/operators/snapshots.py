"""Complete snapshots diffed against stored identities behind a mass-deletion guard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FNV_OFFSET, FNV_PRIME, MASK32
from ..functions.text import round_half_up
from ..plans.skew import in_order

# A snapshot is held back when a source of at least this many open identities
# loses at least this many and more than this share of them.
MINIMUM_OPEN, MINIMUM_MISSING, MAXIMUM_RATIO = 20, 10, 0.5


def diff_identities(
    stored: DataFrame, observed: DataFrame, fetched: DataFrame, scope: list[str], identity: str = "external_id"
) -> DataFrame:
    """Stored open identities against the observed ones, as new, retained or missing.

    ``fetched`` lists the sources with a complete snapshot in this run. A source that is not
    in it is left out entirely; a fetched source without observations lost everything.
    """
    keys = [*scope, identity]
    before = stored.select(*keys).distinct().withColumn("_before", F.lit(True))
    now = observed.select(*keys).distinct().withColumn("_now", F.lit(True))
    both = before.join(now, keys, "full")
    state = (
        F.when(F.col("_before").isNull(), F.lit("new")).when(F.col("_now").isNull(), F.lit("missing"))
        .otherwise(F.lit("retained"))
    )
    scoped = both.join(fetched.select(*scope).distinct(), scope, "left_semi")
    return scoped.select(*keys, state.alias("state"))


def guard(existing: Column, missing: Column) -> Column:
    ratio = F.try_divide(missing, existing)
    return (existing >= MINIMUM_OPEN) & (missing >= MINIMUM_MISSING) & (ratio > MAXIMUM_RATIO)


def assess(diff: DataFrame, fetched: DataFrame, scope: list[str]) -> DataFrame:
    """Per-source counts, missing ratio in basis points and the guard's verdict."""
    counts = diff.groupBy(*scope).agg(
        F.count_if(F.col("state") != "new").alias("existing_open"),
        F.count_if(F.col("state") != "missing").alias("observed_open"),
        F.count_if(F.col("state") == "missing").alias("missing"),
    )
    zero = F.lit(0).cast("long")
    full = fetched.select(*scope).distinct().join(counts, scope, "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("existing_open", "observed_open", "missing")}
    )
    ratio = F.coalesce(F.try_divide(F.col("missing"), F.col("existing_open")), F.lit(0.0))
    held = guard(F.col("existing_open"), F.col("missing"))
    return full.withColumns({
        "missing_ratio_bps": round_half_up(ratio * 10000).cast("int"),
        "status": F.when(held, F.lit("quarantined")).otherwise(F.lit("accepted")),
        "reason": F.when(held, F.lit("mass_deletion_guard")),
    })


def frozen_members(diff: DataFrame, assessed: DataFrame, scope: list[str], identity: str = "external_id") -> DataFrame:
    """Observed, missing and existing members of every held-back snapshot, one row per role."""
    held = assessed.filter("status = 'quarantined'").select(*scope)
    rows = diff.join(held, scope, "left_semi")
    kinds = F.array_compact(F.array(
        F.when(F.col("state") != "missing", F.lit("observed")),
        F.when(F.col("state") == "missing", F.lit("missing")),
        F.when(F.col("state") != "new", F.lit("existing")),
    ))
    return rows.select(*scope, identity, F.explode(kinds).alias("kind"))


def closing_identities(diff: DataFrame, assessed: DataFrame, scope: list[str]) -> DataFrame:
    """Missing identities of accepted snapshots."""
    accepted = assessed.filter("status = 'accepted'").select(*scope)
    return diff.filter("state = 'missing'").join(accepted, scope, "left_semi").drop("state")


def set_digest(members: DataFrame, scope: list[str], identity: str = "external_id") -> DataFrame:
    """Order-free digest of a set of identities: count, sum and xor of 64-bit hashes.

    It combines partial results, so a source of any size is digested by all tasks together.
    """
    value = F.trim(F.col(identity).cast("string"))
    distinct = members.select(*scope, value.alias("_id")).filter("_id <> ''").distinct()
    code = F.xxhash64("_id")
    return distinct.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(code.cast("decimal(20,0)")).alias("digest_sum"), F.bit_xor(code).alias("digest_xor"),
    )


def fingerprints(members: DataFrame, scope: list[str], identity: str = "external_id") -> DataFrame:
    """fnv1a32:<hex>:<count> over the sorted distinct trimmed identities of each source.

    The hash is a sequential fold, so a source is read in order by one task, but as a stream
    of Arrow batches carrying one number per source; the sort is Spark's and spills.
    """
    value = F.trim(F.col(identity).cast("string"))
    distinct = members.select(*scope, value.alias("_id")).filter("_id <> ''").distinct()
    ordered = distinct.repartition(*scope).sortWithinPartitions(*scope, "_id")
    schema = ", ".join(f"`{c}` {t}" for c, t in distinct.select(*scope).dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, count = None, FNV_OFFSET, 0
        for batch in batches:
            done = []
            rows = zip(batch[scope].itertuples(index=False, name=None), batch["_id"])
            for current, text in rows:
                if current != key:
                    if key is not None:
                        done.append((*key, f"fnv1a32:{state:08x}:{count}"))
                    key, state, count = current, FNV_OFFSET, 0
                units = text if count == 0 else "\n" + text
                for char in units:
                    code = ord(char)
                    if code > 0xFFFF:
                        code = 0xD800 + ((code - 0x10000) >> 10)
                    state = ((state ^ code) * FNV_PRIME) & MASK32
                count += 1
            if done:
                yield pd.DataFrame(done, columns=[*scope, "fingerprint"])
        if key is not None:
            yield pd.DataFrame([(*key, f"fnv1a32:{state:08x}:{count}")], columns=[*scope, "fingerprint"])

    return ordered.mapInPandas(fold, f"{schema}, fingerprint string")


EMPTY_FINGERPRINT = f"fnv1a32:{FNV_OFFSET:08x}:0"


def refresh_outcome(results: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Successes, failures, partial flag and whether a run reached the required share."""
    done = F.count_if(F.col("status") == "success")
    every = F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        every.alias("sources"), done.alias("successes"), (every - done).alias("failures"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed"),
        ((done > 0) & (done < every)).alias("partial_success"),
        (done / every >= threshold).alias("meets_threshold"),
    ).withColumn("overall_status", F.when(~F.col("meets_threshold"), "failed")
                 .when(F.col("successes") < F.col("sources"), "partial_success").otherwise("success"))


def same_sets(left: DataFrame, right: DataFrame, scope: list[str], identity: str = "external_id") -> DataFrame:
    """Whether two member lists of each source hold exactly the same identities."""
    keys = [*scope, identity]
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    odd = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    return a.join(b, keys, "full").groupBy(*scope).agg((odd == 0).alias("same"))


def rotating_window(df: DataFrame, order: list[str], cursor: int, limit: int) -> DataFrame:
    """The next ``limit`` rows of an ordered list from a cursor on, and the cursor after them.

    Places come from ranges of the order, so a deep cursor sorts no more than a shallow one; a cursor outside
    the list starts over, and reaching the end wraps to zero.
    """
    placed, size = in_order(df, [F.col(c).asc() for c in order], "position")
    start = cursor if 0 <= cursor < size else 0
    end = start + max(1, limit)
    page = placed.filter(F.col("position").between(start, end - 1))
    return page.withColumn("next_cursor", F.lit(0 if end >= size else end).cast("long"))
