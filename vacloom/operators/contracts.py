"""Data contracts: value rules, key uniqueness, references and additive totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of(column: str, values: list[str]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def in_range(column: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def required_when(condition: Column, column: str) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.col(column).isNotNull()


def not_before(later: str, earlier: str) -> Column:
    return F.coalesce(F.col(later) >= F.col(earlier), F.lit(True))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per key and broken rule, in a single pass."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]))
    return df.select(*key, F.explode(broken).alias("rule"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Child rows whose reference has no parent; null references are not orphans."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in pairs])
    keys = parent.select(*[F.col(p).alias(c) for c, p in pairs.items()]).distinct()
    return child.filter(present).join(keys, list(pairs), "left_anti")


def wrong_counts(parents: DataFrame, children: DataFrame, key: str, stated: str) -> DataFrame:
    """Parents whose stated number of children differs from the rows there are."""
    actual = children.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return parents.select(key, stated).join(actual, key, "left").withColumn(
        "actual", F.coalesce("actual", F.lit(0).cast("long"))
    ).filter(F.col(stated) != F.col("actual"))
