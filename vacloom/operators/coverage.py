"""Coverage metrics: source health, distinct counts, scalar facts and the nested record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .discovery import queue_funnel, registry_funnel


def source_health(sources: DataFrame, as_of: str) -> DataFrame:
    fresh = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL '6' HOUR")
    ok = F.col("last_successful_at") >= fresh
    return sources.filter("enabled").agg(
        F.count(F.lit(1)).alias("configured"),
        F.count_if((F.col("discovery_status") == "active") & F.col("last_error").isNull() & ok).alias("healthy"),
        F.count_if(F.col("last_error").isNotNull()).alias("failed"),
        F.count_if(F.col("last_successful_at").isNull() | ~ok).alias("stale"),
        F.count_if(F.col("discovery_status") == "quarantined").alias("quarantined"),
    )


def investor_counts(investors: DataFrame, bridge: DataFrame) -> DataFrame:
    """Companies per enabled investor; investors without any stay with zero."""
    held = bridge.select("investor_id", "company_id").distinct().groupBy("investor_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return investors.filter("enabled").join(held, "investor_id", "left").select(
        "name", F.coalesce("_n", F.lit(0).cast("long")).alias("companies")
    ).orderBy("name")


def provider_counts(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled AND discovery_status = 'active'").groupBy("provider").agg(
        F.countDistinct("company_id").alias("companies")
    ).orderBy("provider")


def job_totals(jobs: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    """Open jobs, their companies (optionally approximate) and openings of the last day."""
    end = F.lit(as_of).cast("timestamp")
    last_day = F.col("first_seen_at").between(end - F.expr("INTERVAL '1' DAY"), end)
    companies = F.approx_count_distinct("company_id") if approximate else F.countDistinct("company_id")
    return jobs.filter("status = 'verified_open'").agg(
        F.count(F.lit(1)).alias("open_jobs"), companies.alias("active_companies"),
        F.count_if(last_day).alias("jobs_added_1d"),
    )


def company_growth(sources: DataFrame, as_of: str) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    active = sources.filter("discovery_status = 'active'")

    def since(days: int):
        recent = F.col("first_discovered_at") >= end - F.expr(f"INTERVAL '{days}' DAY")
        return F.count_distinct(F.when(recent, F.col("company_id")))

    latest = F.max("first_discovered_at")
    idle = F.floor((F.unix_millis(end) - F.unix_millis(latest)) / 86400000)
    return active.agg(
        since(7).alias("companies_added_7d"), since(1).alias("companies_added_1d"),
        F.coalesce(F.greatest(idle, F.lit(0)), F.lit(0)).cast("long").alias("days_without_growth"),
        F.max(F.when(F.col("enabled"), F.col("last_successful_at"))).alias("last_refresh"),
    )


def growth_warning(pending, days):
    return (pending > 0) & (days >= 3)


def one_row(*parts: DataFrame) -> DataFrame:
    """Side-by-side join of single-row aggregates; every input is an aggregate without keys."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def homepage_metrics(jobs: DataFrame, sources: DataFrame, investors: DataFrame, as_of: str) -> DataFrame:
    providers = sources.filter("enabled AND discovery_status = 'active'").agg(F.countDistinct("provider").alias("providers"))
    known = investors.agg(F.count_if("enabled").alias("investors"))
    growth = company_growth(sources, as_of).select("companies_added_7d", "last_refresh")
    return one_row(job_totals(jobs, as_of), growth, known, providers)


def coverage_record(
    jobs: DataFrame, sources: DataFrame, investors: DataFrame, bridge: DataFrame, registry: DataFrame,
    evidence: DataFrame, queue: DataFrame, reviews: DataFrame, as_of: str,
) -> DataFrame:
    """Everything as one nested row. Maps are over providers and investors, both small tables."""
    def as_map(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "companies")))).alias(out))

    def nested(df: DataFrame, out: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(out))

    record = one_row(
        job_totals(jobs, as_of), company_growth(sources, as_of),
        nested(source_health(sources, as_of), "source_health"),
        nested(registry_funnel(registry, evidence, queue), "registry"),
        nested(queue_funnel(queue, evidence, reviews, as_of), "queue"),
        as_map(provider_counts(sources), "provider", "providers"),
        as_map(investor_counts(investors, bridge), "name", "investors"),
    )
    return record.withColumn(
        "growth_warning", growth_warning(F.col("registry.pending"), F.col("days_without_growth"))
    )
