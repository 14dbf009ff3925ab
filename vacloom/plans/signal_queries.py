"""Signals bound to events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import domain_rules, role, table, with_roles
from ..operators import signals as op
from .catalog import query

NOW = "2024-01-20 00:00:00"


@query("active_signals", with_roles("signal", then=f"""
  SELECT signal_id, confidence FROM signal_role WHERE status = 'active' AND expires_at > TIMESTAMP '{NOW}'"""))
def active_signals(spark, sf_dir):
    return op.active_signals(role(spark, sf_dir, "signal"), NOW).select("signal_id", "confidence")


RECORD = """SELECT event_id AS position, CASE WHEN event_id % 31 = 0 THEN '-' ELSE 'sig' || CAST(event_id AS STRING) END AS id, 'Co' AS company_name,
    CASE WHEN event_id % 58 = 0 THEN 'localhost' WHEN event_id % 29 = 0 THEN 'co.n9' ELSE 'co.com' END AS company_domain, 'Engineer' AS role_function, 'Hiring' AS summary,
    CASE event_type WHEN 'error' THEN 'leak' ELSE 'rss' END AS source_kind, 'permitted' AS permission_status, 'https://co.com/a' AS source_url,
    CASE WHEN event_id % 23 = 0 THEN 'http://co.com/b' ELSE 'https://co.com/b' END AS evidence_url, 'https://co.com/c' AS rights_url, '' AS application_url,
    CAST(ts AS TIMESTAMP) AS observed_at, CAST(ts AS TIMESTAMP) AS last_verified_at, CAST(ts AS TIMESTAMP) + INTERVAL '12' DAY AS expires_at,
    CASE WHEN event_id % 19 = 0 THEN 101 ELSE 50 END AS confidence FROM {events}"""


@query("signal_import_refusals", f"""
  SELECT position, CASE WHEN id = '-' THEN 'id must be a stable 3 to 160 character key' WHEN company_domain IN ('localhost', 'co.n9') THEN 'companyName and a registrable companyDomain are required'
    WHEN source_kind = 'leak' THEN 'sourceKind or permissionStatus is not allowed' WHEN evidence_url LIKE 'http:%' THEN 'source, evidence, rights, and optional application URLs must use HTTPS'
    WHEN last_verified_at > TIMESTAMP '{NOW}' + INTERVAL '5' MINUTE OR expires_at <= TIMESTAMP '{NOW}' THEN 'timestamps must describe a current signal expiring within 90 days'
    ELSE 'confidence must be an integer from 0 to 100' END AS reason FROM ({RECORD.format(events='events')})
  WHERE id = '-' OR company_domain IN ('localhost', 'co.n9') OR source_kind = 'leak' OR evidence_url LIKE 'http:%' OR confidence > 100
    OR last_verified_at > TIMESTAMP '{NOW}' + INTERVAL '5' MINUTE OR expires_at <= TIMESTAMP '{NOW}'""")
def signal_import_refusals(spark, sf_dir):
    table(spark, sf_dir, "region")
    records = spark.sql(RECORD.format(events=f"parquet.`{sf_dir}/events.parquet`"))
    return op.split_import(records, NOW, domain_rules(spark, sf_dir))[1]


SIGNAL = """SELECT o_orderkey AS signal_id, o_custkey AS company_id, 'cust' || CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE o_custkey END AS STRING) || '.com' AS company_domain,
    CASE o_orderkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'submission' ELSE 'hacker_news' END AS source_kind,
    CASE WHEN o_orderkey % 2 = 0 THEN 'authorized' ELSE 'permitted' END AS permission_status, 'https://github.com/x' AS source_url, 'https://github.com/y' AS evidence_url,
    CASE WHEN o_orderkey % 5 = 0 THEN 'https://nowhere.example.org/' ELSE 'https://jobs.example.com/c' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) || '/apply?a=1&b=2' END AS application_url,
    CASE WHEN o_orderkey % 7 = 0 THEN 'expired' ELSE 'active' END AS status, CAST('2030-01-01' AS TIMESTAMP) AS expires_at FROM {orders}"""
OUTCOME = f"""SELECT signal_id, CASE WHEN status <> 'active' THEN 'signal_inactive_or_expired'
      WHEN source_kind = 'hacker_news' OR (source_kind = 'submission' AND permission_status <> 'authorized') THEN 'off_board_evidence_mismatch'
      WHEN company_domain <> 'cust' || company_id || '.com' THEN 'employer_domain_mismatch'
      WHEN company_id NOT IN (SELECT company_id FROM source_role WHERE enabled AND discovery_status = 'active') THEN 'canonical_source_required'
      WHEN application_url LIKE 'https://nowhere%' THEN 'exact_current_role_not_found' END AS reason FROM ({SIGNAL.format(orders='orders')})"""


@query("signal_promotions", with_roles("source", then=f"""
  SELECT signal_id, CASE WHEN reason IS NULL THEN 'promoted' ELSE 'not_promotable' END AS status, reason, CASE WHEN reason IS NULL THEN signal_id END AS job_id FROM ({OUTCOME})"""))
def signal_promotions(spark, sf_dir):
    return promoted(spark, sf_dir).select("signal_id", "status", "reason", "job_id")


def signal_rows(spark, sf_dir):
    table(spark, sf_dir, "region")
    return spark.sql(SIGNAL.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))


def promoted(spark, sf_dir):
    jobs = role(spark, sf_dir, "job")
    done = jobs.filter("1 = 0").select(F.col("job_id").alias("signal_id"), "job_id", "company_id")
    return op.promotions(signal_rows(spark, sf_dir), role(spark, sf_dir, "company"), role(spark, sf_dir, "source"), jobs, done, NOW, domain_rules(spark, sf_dir))


@query("signal_promotions_recorded", with_roles("source", "job", "company", then=f"""
  SELECT o.signal_id, c.name AS company_name, j.title FROM ({OUTCOME}) o JOIN job_role j ON j.job_id = o.signal_id AND j.status = 'verified_open'
  JOIN company_role c ON c.company_id = j.company_id WHERE reason IS NULL"""))
def signal_promotions_recorded(spark, sf_dir):
    jobs = role(spark, sf_dir, "job")
    none = jobs.filter("1 = 0").select(F.col("job_id").alias("signal_id"), "job_id", "company_id")
    stored, _ = op.record_promotions(signal_rows(spark, sf_dir), none, promoted(spark, sf_dir), NOW)
    return op.open_promotions(stored, jobs, role(spark, sf_dir, "company")).select("signal_id", "company_name", "title")
