"""Hiring and evidence scores per company with receipts that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from .movements import CLOSED, OPENED, published_sector, within

HIRING_PARTS = [
    "Open role volume", "90-day net role growth", "Funding stage and recency", "Canonical board freshness",
]
HIRING_MAXIMA = [30, 30, 25, 15]
EVIDENCE_PARTS = [
    "Verification recency", "Canonical board coverage", "Company record completeness",
    "Independent source corroboration",
]
EVIDENCE_MAXIMA = [40, 30, 20, 10]


def score_inputs(
    companies: DataFrame, jobs: DataFrame, changes: DataFrame, as_of: str, mode: str = "as_of",
    successful: DataFrame | None = None,
) -> DataFrame:
    """Counts and clocks the scores are computed from.

    ``as_of``: a role is fresh when verified within two days, the clock is the newest open role.
    ``run``: fresh means verified exactly at this run, and a company whose source succeeded
    (table ``successful`` with company_id) is verified now.
    """
    now = F.lit(as_of).cast("timestamp")
    is_open = F.col("status") == "verified_open"
    if mode == "run":
        fresh = is_open & (F.col("last_verified_at") == now)
    elif mode == "as_of":
        fresh = is_open & within(F.col("last_verified_at"), as_of, 2)
    else:
        raise ValueError("mode must be as_of or run")
    roles = jobs.groupBy("company_id").agg(
        F.count_if(is_open).alias("open_jobs"), F.count_if(fresh).alias("fresh_open"),
        F.max(F.when(is_open, F.col("last_verified_at"))).alias("newest_open"),
    )
    recent = changes.filter(F.col("change_type").isin(OPENED, CLOSED)).filter(
        within(F.col("occurred_at"), as_of, s.GROWTH_WINDOW_DAYS)
    )
    growth = (
        recent.groupBy(F.col("entity_id").alias("job_id")).agg(
            F.count_if(F.col("change_type") == OPENED).alias("opened_90"),
            F.count_if(F.col("change_type") == CLOSED).alias("closed_90"),
        )
        .join(jobs.select("job_id", "company_id"), "job_id")
        .groupBy("company_id").agg(F.sum("opened_90").alias("opened_90"), F.sum("closed_90").alias("closed_90"))
    )
    joined = companies.join(roles, "company_id", "left").join(growth, "company_id", "left")
    zero = F.lit(0).cast("long")
    counts = {c: F.coalesce(F.col(c), zero) for c in ("open_jobs", "fresh_open", "opened_90", "closed_90")}
    joined = joined.withColumns(counts)
    if mode == "as_of":
        return joined.withColumn("verified_at", F.coalesce("newest_open", "last_verified_at")).drop("newest_open")
    if successful is None:
        raise ValueError("run mode needs the companies whose source succeeded")
    marked = joined.drop("board_verified").join(
        successful.select("company_id", F.lit(True).alias("board_verified")).distinct(), "company_id", "left"
    ).withColumn("board_verified", F.coalesce("board_verified", F.lit(False)))
    return marked.withColumn(
        "verified_at", F.when(F.col("board_verified"), now).otherwise(F.col("last_verified_at"))
    ).drop("newest_open")


def hiring_points(now: Column) -> list[Column]:
    return [
        s.volume_points(F.col("open_jobs")), s.growth_points(F.col("opened_90"), F.col("closed_90")),
        s.funding_points(F.col("stage"), F.col("latest_funding_date"), now),
        s.freshness_points(F.col("verified_at"), now),
    ]


def evidence_points(now: Column) -> list[Column]:
    return [
        s.recency_points(F.col("verified_at"), now),
        s.coverage_points(F.col("board_verified"), F.col("open_jobs"), F.col("fresh_open")),
        s.completeness_points(
            F.col("founded_year"), F.col("latest_funding_date"), F.col("source_url"), F.col("careers_url")
        ),
        s.corroboration_points(F.col("source_url"), F.col("careers_url")),
    ]


def with_receipts(inputs: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return inputs.withColumns({
        "hiring": s.receipt(s.HIRING_VERSION, HIRING_PARTS, hiring_points(now), HIRING_MAXIMA),
        "evidence": s.receipt(s.EVIDENCE_VERSION, EVIDENCE_PARTS, evidence_points(now), EVIDENCE_MAXIMA),
    })


def rescore(
    companies: DataFrame, jobs: DataFrame, changes: DataFrame, as_of: str, mode: str = "as_of",
    successful: DataFrame | None = None,
) -> DataFrame:
    """Companies with counts, clock, sector and both scores recomputed from state."""
    scored = with_receipts(score_inputs(companies, jobs, changes, as_of, mode, successful), as_of)
    return scored.withColumns({
        "open_job_count": F.col("open_jobs"),
        "hiring_score": F.col("hiring.value").cast("long"),
        "evidence_confidence": F.col("evidence.value").cast("long"),
        "last_verified_at": F.col("verified_at"),
        "sector": published_sector(),
    }).select(*companies.columns)


def receipt_violations(scored: DataFrame, column: str) -> DataFrame:
    """Receipts whose parts do not add up to the total or leave their bounds."""
    parts = F.col(f"{column}.components")
    total = F.aggregate(parts, F.lit(0).cast("decimal(8,2)"), lambda a, p: (a + p["points"]).cast("decimal(8,2)"))
    outside = F.exists(parts, lambda p: (p["points"] > p["max"]) | (p["points"] < 0))
    return scored.filter((total != F.col(f"{column}.value")) | outside)
