"""Change feed pages after an exclusive (time, id) checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed_page(changes: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """Up to ``limit`` changes after the checkpoint in (occurred_at, id) order."""
    rows = changes
    if after is not None:
        at = F.lit(after[0]).cast("timestamp")
        rows = rows.filter((F.col("occurred_at") > at) | ((F.col("occurred_at") == at) & (F.col("id") > after[1])))
    return rows.orderBy("occurred_at", "id").limit(limit)


def feed_state(changes: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """High-water mark of a page, whether more follows, and whether the checkpoint expired."""
    ahead = feed_page(changes, limit + 1, after)
    page = feed_page(changes, limit, after)
    size = ahead.agg((F.count(F.lit(1)) > limit).alias("has_more")).withColumn("_one", F.lit(1))
    last = page.agg(F.max(F.struct("occurred_at", "id")).alias("mark")).withColumn("_one", F.lit(1))
    oldest = changes.agg(F.min("occurred_at").alias("oldest")).withColumn("_one", F.lit(1))
    expired = F.col("oldest") > F.lit(after[0]).cast("timestamp") if after else F.lit(False)
    kept = F.struct(F.lit(after[0] if after else None).cast("timestamp").alias("occurred_at"), F.lit(after[1] if after else "").alias("id"))
    return size.join(last, "_one").join(oldest, "_one").select(
        "has_more", F.coalesce("mark", kept).alias("mark"), F.coalesce(expired, F.lit(False)).alias("expired")
    )
