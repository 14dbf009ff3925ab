"""Skew-proof building blocks shared by the operators.

A single key may own a third of all rows. These helpers keep every task bounded in that
case without dropping, sampling or capping rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def rank_in_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    slices: list[tuple[Column, bool]],
    out: str = "rn",
) -> DataFrame:
    """Exact ``row_number() over (keys order by order)`` that never sorts a whole group at once.

    ``slices`` are coarse, order-preserving parts of ``order`` as (expression, descending):
    rows in an earlier slice all precede rows in a later one. Each slice is numbered by itself
    and shifted by the size of the slices before it, so a task holds one slice of one group.
    """
    names = [f"_slice{i}" for i in range(len(slices))]
    # Rows that a join has dealt by the keys would stay together: they are dealt by slice as well.
    sliced = df.withColumns({n: e for n, (e, _) in zip(names, slices)}).repartition(*keys, *names)
    local = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    numbered = sliced.withColumn("_local", local)
    sizes = sliced.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_size"))
    sort = [
        F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_first()
        for n, (_, desc) in zip(names, slices)
    ]
    window = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(window), F.lit(0)))
    renamed = shifts.select(
        *[F.col(c).alias(f"_r_{c}") for c in [*keys, *names]], "_shift"
    )
    match = None
    for c in [*keys, *names]:
        part = numbered[c].eqNullSafe(renamed[f"_r_{c}"])
        match = part if match is None else match & part
    joined = numbered.join(renamed, match, "left")
    return joined.withColumn(out, (F.col("_local") + F.col("_shift")).cast("long")).drop(
        "_local", "_shift", *names, *[f"_r_{c}" for c in [*keys, *names]]
    )


def in_order(df: DataFrame, order: list[Column], out: str) -> tuple[DataFrame, int]:
    """Each row's place from zero in a total order over all rows, and their number.

    Rows are dealt by ranges of the order, numbered within their range and shifted by the ranges before. Only
    the sizes of the ranges reach the driver.
    """
    low = 33  # bits of a row's number within its partition
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = durable(ranged)  # from here on partitions stay as they are
    part = F.shiftright("_row", low).cast("int")
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for number in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(number, 0)
    shift = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), part + 1) if before else F.lit(0).cast("long")
    return rows.withColumn(out, F.col("_row").bitwiseAND(F.lit((1 << low) - 1)) + shift).drop("_row"), total


def group_size(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Size of a row's group, counted with map-side combine and joined back by key.

    Keys of the counts are unique, so a hot key is split by the adaptive skew join.
    """
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), keys)


PARTS = 64


def top_in_group(df: DataFrame, keys: list[str], order: list[Column], k: int, dealt: bool = True) -> DataFrame:
    """First ``k`` rows per key, in two levels so that a hot key never meets whole in one task.

    Each hash part of a key keeps its first ``k``, and the parts' rows, ``k`` times their number at most, are
    then ranked by key. Rows that a join may have dealt by the keys (``dealt``) are dealt by part first; for
    others Spark applies the limit per task before the shuffle.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)).cast("int")
    first = Window.partitionBy(*keys, "_part").orderBy(*order)
    parted = df.withColumn("_part", part)
    parts = (parted.repartition(*keys, "_part") if dealt else parted).withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    window = Window.partitionBy(*keys).orderBy(*order)
    return parts.drop("_part").withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k)


def first_in_group(df: DataFrame, keys: list[str], order: list[Column], dealt: bool = True) -> DataFrame:
    return top_in_group(df, keys, order, 1, dealt).drop("_rank")


def plan_text(df: DataFrame) -> str:
    """Physical plan as text, for plan assertions."""
    return df._jdf.queryExecution().executedPlan().toString()
