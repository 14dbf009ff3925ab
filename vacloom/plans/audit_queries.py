"""The quality audit over open orders, their line items being the current boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import role, table, with_roles
from ..operators import audit as op
from .catalog import query
from .snapshot_queries import FNV_SQL

HASH = FNV_SQL.format("'quality-v1:' || job_id")
SAMPLE = f"""SELECT * FROM (SELECT *, count(*) FILTER (WHERE nth = 1) OVER () AS companies FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY h, CAST(job_id AS VARCHAR)) AS nth FROM (
      SELECT j.*, 'src' || (company_id % 97) AS source_key, {HASH} AS h FROM job_role j WHERE status = 'verified_open')))
  ORDER BY CASE WHEN nth = 1 AND companies <= {{size}} THEN 0 ELSE 1 END, h, CAST(job_id AS VARCHAR) LIMIT {{size}}"""


def parts(spark, sf_dir):
    jobs = role(spark, sf_dir, "job").withColumn("source_key", F.concat(F.lit("src"), F.col("company_id") % 97))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber").join(
        jobs.select("job_id", "source_key", "external_id", "canonical_url"), "job_id")
    current = lines.filter("l_linenumber = 1").select("source_key", "external_id", "canonical_url")
    observed = lines.filter("l_linenumber <= 3").select("source_key", "external_id", "canonical_url")
    failures = table(spark, sf_dir, "supplier").filter("s_suppkey < 10").select(
        F.concat(F.lit("src"), "s_suppkey").alias("source_key"), F.lit("timeout").alias("message"))
    return jobs, current, observed, failures


@query("audit_sample", with_roles("job", then=f"SELECT job_id, company_id FROM ({SAMPLE.format(size=2000)})"))
def audit_sample(spark, sf_dir):
    return op.audit_sample(parts(spark, sf_dir)[0], 2000).select("job_id", "company_id")


ROWS = f"""SELECT s.job_id, CASE WHEN company_id % 97 < 10 THEN 'inconclusive'
    WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_linenumber = 1) THEN 'fresh'
    WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = job_id AND l_linenumber <= 3) THEN 'ineligible' ELSE 'stale' END AS freshness,
  count(*) OVER (PARTITION BY company_id, title, location, lower(replace(replace(employment_type, '-', ' '), '_', ' '))) AS cluster_size FROM ({SAMPLE.format(size=2000)}) s"""


@query("audit_rows", with_roles("job", then=ROWS))
def audit_rows(spark, sf_dir):
    return op.audit(*parts(spark, sf_dir), size=2000).select("job_id", "freshness", "cluster_size")


@query("audit_rates", with_roles("job", then=f"""
  SELECT count(*) AS sample, count(*) FILTER (WHERE freshness = 'fresh') AS fresh, count(*) FILTER (WHERE freshness = 'stale') AS stale,
    count(*) FILTER (WHERE freshness = 'ineligible') AS ineligible, count(*) FILTER (WHERE freshness = 'inconclusive') AS inconclusive, 0 AS duplicates
  FROM ({ROWS})"""))
def audit_rates(spark, sf_dir):
    return op.audit_rates(op.audit(*parts(spark, sf_dir), size=2000)).select("sample", "fresh", "stale", "ineligible", "inconclusive", "duplicates")


@query("audit_duplicates", """
  SELECT l_orderkey * 100000 + l_linenumber * 10000 + l_partkey AS job_id, nullif(min(l_orderkey * 100000 + l_linenumber * 10000 + l_partkey) OVER (PARTITION BY l_suppkey, l_partkey),
    l_orderkey * 100000 + l_linenumber * 10000 + l_partkey) AS duplicate_of FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def audit_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    key = F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")
    jobs = rows.select(
        key.alias("job_id"), F.col("l_suppkey").alias("source_key"), F.col("l_partkey").alias("external_id"),
        F.concat_ws("/", "l_suppkey", "l_partkey").alias("url"), F.lit(True).alias("_counted"),
    )
    return op.with_duplicates(jobs, "job_id").select("job_id", "duplicate_of")


@query("audit_coverage_gap", with_roles("job", then="""
  SELECT count(DISTINCT l_orderkey) AS eligible, count(DISTINCT CASE WHEN j.status <> 'verified_open' THEN l_orderkey END) AS not_in_inventory
  FROM lineitem JOIN job_role j ON j.job_id = l_orderkey WHERE l_linenumber = 1"""))
def audit_coverage_gap(spark, sf_dir):
    jobs, current, _, _ = parts(spark, sf_dir)
    return op.coverage_gap(current, jobs.filter("status = 'verified_open'"))


@query("employer_concentration", """
  SELECT o_custkey AS company_id, count(*) AS jobs, CAST(floor(count(*) * 1000000.0 / (SELECT count(*) FROM orders)) AS BIGINT) AS share_ppm FROM orders GROUP BY 1""")
def employer_concentration(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.count(F.lit(1)).alias("jobs"))
    return op.concentration(counts).select("company_id", "jobs", F.floor(F.col("share") * 1000000).alias("share_ppm"))


@query("employer_share_within_limit", "SELECT TRUE AS within_limit")
def employer_share_within_limit(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.count(F.lit(1)).alias("jobs"))
    return op.within_share(counts, 0.2)
