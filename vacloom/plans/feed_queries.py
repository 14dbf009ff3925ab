"""Pages of the change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import role, with_roles
from ..operators import feed as op
from .catalog import query

AFTER = ("2000-01-01 00:00:00", "o5")
NEXT = "(occurred_at > TIMESTAMP '2000-01-01' OR (occurred_at = TIMESTAMP '2000-01-01' AND id > 'o5'))"


@query("change_feed_page", with_roles("change", then=f"""
  SELECT id, change_type FROM change_role WHERE {NEXT} ORDER BY occurred_at, id LIMIT 100"""))
def change_feed_page(spark, sf_dir):
    return op.feed_page(role(spark, sf_dir, "change"), 100, AFTER).select("id", "change_type")


@query("change_feed_state", with_roles("change", then=f"""
  SELECT TRUE AS has_more, last(id ORDER BY occurred_at, id) AS mark, FALSE AS expired FROM (
    SELECT occurred_at, id FROM change_role WHERE {NEXT} ORDER BY occurred_at, id LIMIT 100)"""))
def change_feed_state(spark, sf_dir):
    return op.feed_state(role(spark, sf_dir, "change"), 100, AFTER).select("has_more", F.col("mark.id").alias("mark"), "expired")
