"""Imports of signals: the step that finds the domains of their companies."""

from pyspark.sql import functions as F

from vacloom.functions.urls import suffix_table
from vacloom.operators.signals import split_import
from vacloom.plans.skew import plan_text


def test_one_host_of_most_rows_is_not_sorted_in_one_task(spark):
    """The rows of an import meet the few hosts they name where they are: none is sorted, whichever host most rows share."""
    rows = spark.range(3000).select(
        F.col("id").alias("position"), F.concat(F.lit("sig"), "id").alias("id"), F.lit("Co").alias("company_name"),
        F.when(F.col("id") % 29 == 0, "localhost").when(F.col("id") % 31 == 0, None).otherwise("co.com").alias("company_domain"),
        *[F.lit(v).alias(n) for n, v in {"role_function": "Engineer", "summary": "Hiring", "source_kind": "rss", "permission_status": "permitted",
          "source_url": "https://co.com/a", "evidence_url": "https://co.com/b", "rights_url": "https://co.com/c", "application_url": ""}.items()],
        *[F.lit(d).cast("timestamp").alias(n) for n, d in {"observed_at": "2024-01-01", "last_verified_at": "2024-01-01", "expires_at": "2024-02-01"}.items()],
        F.lit(50).alias("confidence"))
    # Sizes are not known when the plan is made, as with large tables, but when the hosts have been found.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        refused = split_import(rows, "2024-01-20 00:00:00", suffix_table(spark))[1]
        found = {r.position for r in refused.collect()}
        plan = plan_text(refused).split("== Initial Plan ==")[0]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert found == {i for i in range(3000) if i % 29 == 0 or i % 31 == 0}
    above = plan[:plan.index("Range (")]
    assert "isFinalPlan=true" in above and "BroadcastHashJoin" in above and "SortMergeJoin" not in above
