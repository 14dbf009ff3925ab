"""Scores of every customer seen as a hiring company."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, role, with_roles
from ..operators import scores as op
from .catalog import query

NOW = f"TIMESTAMP '{AS_OF}'"


def three(spark, sf_dir):
    return [role(spark, sf_dir, n) for n in ("company", "job", "change")]


def inputs_sql(fresh, verified, board="board_verified"):
    return f"""
  SELECT c.*, coalesce(j.open_jobs, 0) AS open_jobs, coalesce(j.fresh_open, 0) AS fresh_open,
    coalesce(g.opened_90, 0) AS opened_90, coalesce(g.closed_90, 0) AS closed_90, {verified} AS verified_at,
    {board} AS board_ok
  FROM company_role c LEFT JOIN (
    SELECT company_id, count(*) FILTER (WHERE status = 'verified_open') AS open_jobs,
      count(*) FILTER (WHERE status = 'verified_open' AND {fresh}) AS fresh_open,
      max(last_verified_at) FILTER (WHERE status = 'verified_open') AS newest_open
    FROM job_role GROUP BY 1) j ON j.company_id = c.company_id
  LEFT JOIN (
    SELECT job.company_id, count(*) FILTER (WHERE change_type = 'job_opened') AS opened_90,
      count(*) FILTER (WHERE change_type = 'job_closed') AS closed_90
    FROM change_role JOIN job_role job ON job.job_id = entity_id
    WHERE occurred_at BETWEEN {NOW} - INTERVAL '90' DAY AND {NOW} GROUP BY 1) g ON g.company_id = c.company_id"""


AS_OF_INPUTS = inputs_sql(
    f"last_verified_at BETWEEN {NOW} - INTERVAL '2' DAY AND {NOW}", "coalesce(j.newest_open, c.last_verified_at)")
SUCCEEDED = "c.company_id IN (SELECT company_id FROM source_role WHERE last_error IS NULL)"
RUN_INPUTS = inputs_sql(
    f"last_verified_at = {NOW}", f"CASE WHEN {SUCCEEDED} THEN {NOW} ELSE c.last_verified_at END", SUCCEEDED)


def age(column):
    return f"((epoch_ms({NOW}) - epoch_ms(CAST({column} AS TIMESTAMP))) / 86400000.0)"


def decay(days):
    return f"(CASE WHEN {days} <= 2 THEN 1.0 WHEN {days} >= 30 THEN 0.0 ELSE CAST(30.0 - {days} AS DOUBLE) / 28.0 END)"


CLOCK = f"CAST(greatest({age('verified_at')}, 0.0) AS DOUBLE)"
WEIGHT = """CASE lower(trim(stage)) WHEN 'pre-seed' THEN 0.5 WHEN 'seed' THEN 0.6 WHEN 'early stage' THEN 0.65
  WHEN 'series a' THEN 0.8 WHEN 'series b' THEN 0.9 WHEN 'series f' THEN 1.0 WHEN 'growth' THEN 1.0 ELSE 0.7 END"""
FUNDED = f"CAST({age('latest_funding_date')} AS DOUBLE)"
RECENCY = f"""CASE WHEN latest_funding_date IS NULL THEN 0.6 WHEN {FUNDED} <= 180 THEN 1.0 WHEN {FUNDED} >= 540 THEN 0.4
  ELSE 1 - CAST(0.6 AS DOUBLE) * (({FUNDED} - 180) / 360.0) END"""
HOST = "regexp_replace(regexp_extract(lower({}), '^https?://([^/]+)', 1), '^www\\.', '')"
HIRING = [
    "CAST(30.0 AS DOUBLE) * least(1.0, ln(1 + CAST(open_jobs AS DOUBLE)) / ln(CAST(13 AS DOUBLE)))",
    "CASE WHEN opened_90 + closed_90 = 0 THEN 9.0 ELSE CAST(15.0 AS DOUBLE) * (1 + greatest(-1.0, least(1.0, CAST(opened_90 - closed_90 AS DOUBLE) / 6.0))) END",
    f"CAST(25.0 AS DOUBLE) * CAST({WEIGHT} AS DOUBLE) * CAST({RECENCY} AS DOUBLE)",
    f"CAST(15.0 AS DOUBLE) * {decay(CLOCK)}",
]
EVIDENCE = [
    f"CAST(40.0 AS DOUBLE) * {decay(CLOCK)}",
    "CASE WHEN NOT board_ok THEN 0.0 WHEN open_jobs = 0 THEN 30.0 ELSE CAST(30.0 AS DOUBLE) * least(1.0, CAST(fresh_open AS DOUBLE) / open_jobs) END",
    """(CASE WHEN founded_year IS NULL THEN 0 ELSE 5 END + CASE WHEN latest_funding_date IS NULL THEN 0 ELSE 5 END
      + CASE WHEN source_url = '' THEN 0 ELSE 5 END + CASE WHEN careers_url = '' THEN 0 ELSE 5 END)""",
    f"""CASE WHEN {HOST.format('source_url')} <> '' AND {HOST.format('careers_url')} <> ''
      AND {HOST.format('source_url')} <> {HOST.format('careers_url')} THEN 10 ELSE 0 END""",
]


def receipt_sql(source, points, maxima):
    raw = ", ".join(f"CAST({p} AS DOUBLE) AS p{i}" for i, p in enumerate(points, 1))
    cents = ", ".join(f"CAST(floor(p{i} * 100 + 0.5) AS BIGINT) AS c{i}" for i in range(1, 5))
    steps = f"SELECT *, value * 100 - (c1 + c2 + c3 + c4) AS r4 FROM (SELECT company_id, CAST(floor(least(100.0, greatest(0.0, p1 + p2 + p3 + p4)) + 0.5) AS BIGINT) AS value, {cents} FROM (SELECT company_id, {raw} FROM ({source})))"
    for i in (4, 3, 2, 1):
        room = f"CASE WHEN r{i} > 0 THEN {maxima[i - 1] * 100} - c{i} ELSE c{i} END"
        steps = f"SELECT *, r{i} - a{i} AS r{i - 1} FROM (SELECT *, CAST(sign(r{i}) * least(abs(r{i}), {room}) AS BIGINT) AS a{i} FROM ({steps}))"
    return "SELECT company_id, value, " + ", ".join(f"c{i} + a{i} AS part{i}" for i in range(1, 5)) + f" FROM ({steps})"


def parts(df, column):
    cents = [
        (F.col(f"{column}.components")[i]["points"] * 100).cast("long").alias(f"part{i + 1}") for i in range(4)
    ]
    return df.select("company_id", F.col(f"{column}.value").cast("long").alias("value"), *cents)


def scored(spark, sf_dir):
    return op.with_receipts(op.score_inputs(*three(spark, sf_dir), AS_OF), AS_OF)


@query("score_inputs", with_roles("company", "job", "change", then=f"""
  SELECT company_id, open_jobs, fresh_open, opened_90, closed_90, strftime(verified_at, '%Y-%m-%d') AS verified_on
  FROM ({AS_OF_INPUTS})"""))
def score_inputs(spark, sf_dir):
    return op.score_inputs(*three(spark, sf_dir), AS_OF).select(
        "company_id", "open_jobs", "fresh_open", "opened_90", "closed_90",
        F.date_format("verified_at", "yyyy-MM-dd").alias("verified_on"),
    )


@query("hiring_score_receipts", with_roles("company", "job", "change", then=receipt_sql(AS_OF_INPUTS, HIRING, op.HIRING_MAXIMA)))
def hiring_score_receipts(spark, sf_dir):
    return parts(scored(spark, sf_dir), "hiring")


@query("evidence_confidence_receipts", with_roles("company", "job", "change", then=receipt_sql(AS_OF_INPUTS, EVIDENCE, op.EVIDENCE_MAXIMA)))
def evidence_confidence_receipts(spark, sf_dir):
    return parts(scored(spark, sf_dir), "evidence")


@query("rescore_after_run", with_roles("company", "job", "change", "source", then=f"""
  SELECT i.company_id, i.open_jobs AS open_job_count, h.value AS hiring_score, e.value AS evidence_confidence,
    strftime(i.verified_at, '%Y-%m-%d %H') AS verified
  FROM ({RUN_INPUTS}) i JOIN ({receipt_sql(RUN_INPUTS, HIRING, op.HIRING_MAXIMA)}) h ON h.company_id = i.company_id
  JOIN ({receipt_sql(RUN_INPUTS, EVIDENCE, op.EVIDENCE_MAXIMA)}) e ON e.company_id = i.company_id"""))
def rescore_after_run(spark, sf_dir):
    successful = role(spark, sf_dir, "source").filter("last_error IS NULL").select("company_id")
    return op.rescore(*three(spark, sf_dir), AS_OF, "run", successful).select(
        "company_id", "open_job_count", "hiring_score", "evidence_confidence",
        F.date_format("last_verified_at", "yyyy-MM-dd HH").alias("verified"),
    )


@query("receipt_checks", "SELECT 'hiring' AS receipt, (SELECT count(*) FROM customer) AS receipts, 0 AS violations "
       "UNION ALL SELECT 'evidence', (SELECT count(*) FROM customer), 0")
def receipt_checks(spark, sf_dir):
    df = scored(spark, sf_dir)

    def check(name):
        bad = op.receipt_violations(df, name).select(F.lit(0).alias("ok"), F.lit(1).alias("bad"))
        return df.select(F.lit(1).alias("ok"), F.lit(0).alias("bad")).unionByName(bad).agg(
            F.sum("ok").alias("receipts"), F.sum("bad").alias("violations")
        ).select(F.lit(name).alias("receipt"), "receipts", "violations")

    return check("hiring").unionByName(check("evidence"))


@query("score_components", with_roles("company", "job", "change", then="SELECT company_id, " + ", ".join(
    f"CAST(floor(CAST({p} AS DOUBLE) * 100 + 0.5) AS BIGINT) AS p{i}" for i, p in enumerate(HIRING + EVIDENCE, 1)) + f" FROM ({AS_OF_INPUTS})"))
def score_components(spark, sf_dir):
    now = F.lit(AS_OF).cast("timestamp")
    points = op.hiring_points(now) + op.evidence_points(now)
    return op.score_inputs(*three(spark, sf_dir), AS_OF).select(
        "company_id", *[F.floor(p * 100 + 0.5).alias(f"p{i}") for i, p in enumerate(points, 1)]
    )


