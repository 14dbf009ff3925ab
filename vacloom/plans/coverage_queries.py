"""Coverage, contracts and point reads over the bound tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..bindings import AS_OF, role, table, with_roles
from ..operators import contracts, coverage as op
from .catalog import query

NOW = f"TIMESTAMP '{AS_OF}'"
HEALTH = f"""SELECT count(*) AS configured,
    count(*) FILTER (WHERE discovery_status = 'active' AND last_error IS NULL AND last_successful_at >= {NOW} - INTERVAL '6' HOUR) AS healthy,
    count(*) FILTER (WHERE last_error IS NOT NULL) AS failed,
    count(*) FILTER (WHERE last_successful_at IS NULL OR last_successful_at < {NOW} - INTERVAL '6' HOUR) AS stale,
    count(*) FILTER (WHERE discovery_status = 'quarantined') AS quarantined FROM source_role WHERE enabled"""
JOBS = f"""SELECT count(*) AS open_jobs, count(DISTINCT company_id) AS active_companies,
    count(*) FILTER (WHERE first_seen_at BETWEEN {NOW} - INTERVAL '1' DAY AND {NOW}) AS jobs_added_1d
  FROM job_role WHERE status = 'verified_open'"""
GROWTH = f"""SELECT count(DISTINCT CASE WHEN first_discovered_at >= {NOW} - INTERVAL '7' DAY THEN company_id END) AS companies_added_7d,
    count(DISTINCT CASE WHEN first_discovered_at >= {NOW} - INTERVAL '1' DAY THEN company_id END) AS companies_added_1d,
    CAST(greatest(0, floor((epoch_ms({NOW}) - epoch_ms(max(first_discovered_at))) / 86400000.0)) AS BIGINT) AS days_without_growth,
    strftime(max(CASE WHEN enabled THEN last_successful_at END), '%Y-%m-%d') AS last_refresh
  FROM source_role WHERE discovery_status = 'active'"""


@query("source_health", with_roles("source", then=HEALTH))
def source_health(spark, sf_dir):
    return op.source_health(role(spark, sf_dir, "source"), AS_OF)


@query("investor_coverage", with_roles("investor", "bridge", then="""
  SELECT i.name, count(DISTINCT b.company_id) AS companies FROM investor_role i LEFT JOIN bridge_role b
  ON b.investor_id = i.investor_id WHERE i.enabled GROUP BY i.name"""))
def investor_coverage(spark, sf_dir):
    return op.investor_counts(role(spark, sf_dir, "investor"), role(spark, sf_dir, "bridge"))


@query("provider_coverage", with_roles("source", then="""
  SELECT provider, count(DISTINCT company_id) AS companies FROM source_role
  WHERE enabled AND discovery_status = 'active' GROUP BY 1"""))
def provider_coverage(spark, sf_dir):
    return op.provider_counts(role(spark, sf_dir, "source"))


@query("company_growth", with_roles("source", then=GROWTH))
def company_growth(spark, sf_dir):
    return op.company_growth(role(spark, sf_dir, "source"), AS_OF).withColumn(
        "last_refresh", F.date_format("last_refresh", "yyyy-MM-dd")
    )


@query("homepage_metrics", with_roles("job", "source", "investor", then=f"""
  SELECT j.*, g.companies_added_7d, g.last_refresh, (SELECT count(*) FROM investor_role WHERE enabled) AS investors,
    (SELECT count(DISTINCT provider) FROM source_role WHERE enabled AND discovery_status = 'active') AS providers
  FROM ({JOBS}) j, ({GROWTH}) g"""))
def homepage_metrics(spark, sf_dir):
    return op.homepage_metrics(*[role(spark, sf_dir, n) for n in ("job", "source", "investor")], AS_OF).withColumn(
        "last_refresh", F.date_format("last_refresh", "yyyy-MM-dd")
    )


@query("coverage_record", with_roles("job", "source", "registry", then=f"""
  SELECT j.*, g.companies_added_7d, g.days_without_growth, h.healthy, h.stale,
    (SELECT count(*) FROM registry_role WHERE review_status = 'pending') AS registry_pending,
    (SELECT count(*) FROM registry_role WHERE review_status = 'pending') > 0 AND g.days_without_growth >= 3 AS growth_warning,
    (SELECT count(DISTINCT company_id) FROM source_role WHERE enabled AND discovery_status = 'active' AND provider = 'lever') AS lever
  FROM ({JOBS}) j, ({GROWTH}) g, ({HEALTH}) h"""))
def coverage_record(spark, sf_dir):
    names = ("job", "source", "investor", "bridge", "registry", "evidence", "queue", "review")
    record = op.coverage_record(*[role(spark, sf_dir, n) for n in names], AS_OF)
    return record.select(
        "open_jobs", "active_companies", "jobs_added_1d", "companies_added_7d", "days_without_growth",
        "source_health.healthy", "source_health.stale", F.col("registry.pending").alias("registry_pending"),
        "growth_warning", F.col("providers")["lever"].alias("lever"),
    )


@query("contract_violations", with_roles("job", then="""
  SELECT job_id, 'status_known' AS rule FROM job_role WHERE status NOT IN ('verified_open')
  UNION ALL SELECT job_id, 'provider_required' FROM job_role WHERE status = 'verified_open' AND provider IS NULL
  UNION ALL SELECT job_id, 'verified_after_seen' FROM job_role WHERE last_verified_at < first_seen_at
  UNION ALL SELECT job_id, 'company_in_range' FROM job_role WHERE company_id NOT BETWEEN 1 AND 1000"""))
def contract_violations(spark, sf_dir):
    return contracts.violations(role(spark, sf_dir, "job"), ["job_id"], {
        "status_known": contracts.one_of("status", ["verified_open"]),
        "provider_required": contracts.required_when(F.col("status") == "verified_open", "provider"),
        "verified_after_seen": contracts.not_before("last_verified_at", "first_seen_at"),
        "company_in_range": contracts.in_range("company_id", 1, 1000),
    })


@query("repeated_line_keys", """
  SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_line_keys(spark, sf_dir):
    return contracts.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("referential_orphans", """
  SELECT 'order without customer' AS contract, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'order without line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def referential_orphans(spark, sf_dir):
    orders, customers, lines = [table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem")]
    found = {
        "order without customer": contracts.orphans(orders, customers, {"o_custkey": "c_custkey"}),
        "order without line": contracts.orphans(orders, lines, {"o_orderkey": "l_orderkey"}),
        "line without order": contracts.orphans(lines, orders, {"l_orderkey": "o_orderkey"}),
    }
    return reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("contract"), "rows") for name, df in found.items()
    ])


@query("stated_open_counts", with_roles("company", "job", then="""
  SELECT c.company_id, c.open_job_count, coalesce(n, 0) AS actual FROM company_role c LEFT JOIN (
    SELECT company_id, count(*) AS n FROM job_role WHERE status = 'verified_open' GROUP BY 1) j ON j.company_id = c.company_id
  WHERE c.open_job_count <> coalesce(n, 0)"""))
def stated_open_counts(spark, sf_dir):
    jobs = role(spark, sf_dir, "job").filter("status = 'verified_open'")
    return contracts.wrong_counts(role(spark, sf_dir, "company"), jobs, "company_id", "open_job_count")


@query("company_point_lookup", with_roles("company", "job", then="""
  SELECT c.company_id, c.slug, j.job_id FROM company_role c JOIN job_role j ON j.company_id = c.company_id WHERE c.slug = 'cust-42'"""))
def company_point_lookup(spark, sf_dir):
    chosen = role(spark, sf_dir, "company").filter("slug = 'cust-42'").select("company_id", "slug")
    return role(spark, sf_dir, "job").join(chosen, "company_id").select("company_id", "slug", "job_id")
