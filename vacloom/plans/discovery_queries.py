"""The discovery queue bound to pending orders, registry to customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, domain_rules, role, table, with_roles
from ..operators import discovery as op
from .catalog import query

NOW = f"TIMESTAMP '{AS_OF}'"
PERMITTED = "EXISTS (SELECT 1 FROM evidence_role e WHERE e.canonical_domain = q.normalized_domain AND e.permission_status = 'permitted')"
REVIEWED = "EXISTS (SELECT 1 FROM review_role r WHERE r.candidate_id = q.id AND r.status NOT IN ('rejected', 'activated'))"
STALE = "(q.status = 'needs_review' AND coalesce(q.discovery_version, '') <> '2026-09-01')"
RUNNABLE = f"""((q.status IN ('discovered', 'canonical_source_found') OR {STALE}
    OR (q.status = 'resolving' AND (q.last_attempted_at IS NULL OR q.last_attempted_at < {NOW} - INTERVAL '1' HOUR)))
  AND {PERMITTED} AND (q.next_attempt_at IS NULL OR q.next_attempt_at <= {NOW}) AND NOT {REVIEWED})"""


def roles(then):
    return with_roles("queue", "evidence", "review", then=then)


def three(spark, sf_dir):
    return [role(spark, sf_dir, n) for n in ("queue", "evidence", "review")]


@query("queue_next_candidates", roles(f"""
  SELECT id, normalized_domain, status FROM queue_role q WHERE {RUNNABLE}
  ORDER BY coalesce(attempt_count, 0), first_discovered_at DESC, id DESC LIMIT 40"""))
def queue_next_candidates(spark, sf_dir):
    return op.next_candidates(*three(spark, sf_dir), AS_OF, 40).select("id", "normalized_domain", "status")


@query("queue_runnable", roles(f"SELECT id FROM queue_role q WHERE {RUNNABLE}"))
def queue_runnable(spark, sf_dir):
    return op.flagged(*three(spark, sf_dir)).filter(op.runnable(F.lit(AS_OF).cast("timestamp"))).select("id")


WAITING = "q.status IN ('discovered', 'canonical_source_found')"
FUNNEL = {
    "auto_eligible": PERMITTED, "permission_excluded": f"NOT {PERMITTED}", "ready": RUNNABLE,
    "in_progress": "q.status = 'resolving'", "discovered": "q.status = 'discovered'",
    "canonical_source_found": "q.status = 'canonical_source_found'", "needs_review": "q.status = 'needs_review'",
    "stale_needs_review": f"{STALE} AND {PERMITTED} AND NOT {REVIEWED}", "active": "q.status = 'active'",
    "unsupported": "q.status = 'unsupported'", "rejected": "q.status = 'rejected'",
    "never_attempted": f"{PERMITTED} AND q.last_attempted_at IS NULL", "review_gated": f"{PERMITTED} AND {REVIEWED}",
    "retry_due": f"{PERMITTED} AND q.next_attempt_at <= {NOW} AND {WAITING}",
    "retry_deferred": f"{PERMITTED} AND q.next_attempt_at > {NOW} AND {WAITING}",
}


@query("queue_funnel", roles("SELECT count(*) AS total, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN {name}_x THEN 1 ELSE 0 END), 0) AS BIGINT) AS {name}" for name in FUNNEL)
    + ", strftime(min(CASE WHEN ready_x THEN first_discovered_at END), '%Y-%m-%d') AS oldest_ready FROM (SELECT q.*, "
    + ", ".join(f"{c} AS {n}_x" for n, c in FUNNEL.items()) + " FROM queue_role q)"))
def queue_funnel(spark, sf_dir):
    return op.queue_funnel(*three(spark, sf_dir), AS_OF).withColumn(
        "oldest_ready", F.date_format("oldest_ready_at", "yyyy-MM-dd")
    ).drop("oldest_ready_at")


@query("queue_outcome_histogram", roles(f"""
  SELECT coalesce(last_outcome, 'unattempted') AS outcome, count(*) AS count FROM queue_role q WHERE {PERMITTED} GROUP BY 1"""))
def queue_outcome_histogram(spark, sf_dir):
    return op.histogram(op.flagged(*three(spark, sf_dir)).filter("permitted"), "last_outcome", "unattempted", "outcome")


@query("queue_reason_histogram", roles(f"""
  SELECT coalesce(last_error, 'unspecified') AS reason, count(*) AS count FROM queue_role q
  WHERE {PERMITTED} AND status = 'needs_review' GROUP BY 1"""))
def queue_reason_histogram(spark, sf_dir):
    rows = op.flagged(*three(spark, sf_dir)).filter("permitted AND status = 'needs_review'")
    return op.histogram(rows, "last_error", "unspecified", "reason")


ALLOWED = "EXISTS (SELECT 1 FROM evidence_role e WHERE e.canonical_domain = d.canonical_domain AND e.permission_status = 'permitted')"
QUEUED = "EXISTS (SELECT 1 FROM queue_role q WHERE q.normalized_domain = d.canonical_domain)"
FREE = "review_status = 'pending' AND company_id IS NULL"


@query("registry_funnel", with_roles("registry", "evidence", "queue", then=f"""
  SELECT count(*) AS total, count(*) FILTER (WHERE review_status = 'pending') AS pending,
    count(*) FILTER (WHERE review_status = 'verified' AND activity_state = 'active') AS verified_active,
    count(*) FILTER (WHERE review_status = 'rejected') AS rejected, count(*) FILTER (WHERE {FREE}) AS promotion_universe,
    count(*) FILTER (WHERE {FREE} AND allowed) AS eligible, count(*) FILTER (WHERE {FREE} AND NOT allowed) AS permission_excluded,
    count(*) FILTER (WHERE {FREE} AND allowed AND NOT queued) AS eligible_never_queued,
    count(*) FILTER (WHERE {FREE} AND allowed AND queued) AS eligible_queued
  FROM (SELECT d.*, {ALLOWED} AS allowed, {QUEUED} AS queued FROM registry_role d)"""))
def registry_funnel(spark, sf_dir):
    return op.registry_funnel(*[role(spark, sf_dir, n) for n in ("registry", "evidence", "queue")])


@query("registry_promotion", with_roles("registry", "evidence", "queue", then=f"""
  SELECT canonical_domain AS normalized_domain, company_name, max(CASE WHEN source_kind = 'directory' THEN 1 ELSE 0 END) AS directory_ranked
  FROM registry_role d JOIN evidence_role e USING (canonical_domain)
  WHERE e.permission_status = 'permitted' AND {FREE} AND NOT EXISTS (SELECT 1 FROM queue_role q
    WHERE q.normalized_domain = d.canonical_domain)
  GROUP BY canonical_domain, company_name, first_seen_at
  ORDER BY first_seen_at DESC, 3 DESC, canonical_domain LIMIT 60"""))
def registry_promotion(spark, sf_dir):
    registry, evidence, queue = [role(spark, sf_dir, n) for n in ("registry", "evidence", "queue")]
    return op.promote(registry, evidence, queue, AS_OF, 60).select(
        "normalized_domain", "company_name", "directory_ranked"
    )


RESOLUTION = """CASE id % 7 WHEN 0 THEN 'probe_error' WHEN 1 THEN 'fetch_error' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unsupported'
  WHEN 4 THEN 'no_ats_detected' WHEN 5 THEN 'empty_board' ELSE 'verified' END"""
TRANSIENT = "regexp_matches(coalesce(last_error, ''), '(?i)timeout|timed out|abort|network|fetch failed|robots|429|5\\d\\d')"
BLOCKED = "regexp_matches(coalesce(last_error, ''), '(?i)robots|permission|disallow')"


@query("candidate_outcomes", with_roles("queue", then=f"""
  SELECT id, tries AS attempt_count, CASE WHEN retry THEN 'discovered' WHEN res = 'unsupported' THEN 'unsupported'
      WHEN res = 'verified' AND slot THEN 'active' WHEN res = 'verified' THEN 'canonical_source_found' ELSE 'needs_review' END AS status,
    CASE WHEN res = 'probe_error' AND blocked THEN 'probe_blocked' WHEN res = 'probe_error' THEN 'probe_failed'
      WHEN res = 'fetch_error' THEN 'canonical_fetch_failed' WHEN res = 'empty_board' THEN 'no_us_openings'
      WHEN res <> 'verified' THEN res WHEN slot THEN 'activated' ELSE 'canonical_source_found' END AS last_outcome,
    CASE WHEN retry THEN least(604800, 21600 * CAST(pow(2, tries - 1) AS BIGINT)) WHEN res = 'verified' AND NOT slot THEN 7200 END AS wait_seconds
  FROM (SELECT *, (res = 'probe_error' AND NOT blocked AND transient) OR (res = 'fetch_error' AND transient) AS retry
    FROM (SELECT id, coalesce(attempt_count, 0) + 1 AS tries, {RESOLUTION} AS res, id % 2 = 0 AS slot, {TRANSIENT} AS transient,
      {BLOCKED} AS blocked FROM queue_role))"""))
def candidate_outcomes(spark, sf_dir):
    attempts = role(spark, sf_dir, "queue").select(
        "id", "attempt_count", F.expr(RESOLUTION).alias("resolution"), F.col("last_error").alias("message"),
        F.lit(None).cast("long").alias("retry_after_ms"), F.expr("id % 2 = 0").alias("slot_free"),
    )
    wait = F.unix_seconds("next_attempt_at") - F.unix_seconds(F.lit(AS_OF).cast("timestamp"))
    return op.outcomes(attempts, AS_OF).select(
        "id", "attempt_count", "status", "last_outcome", wait.alias("wait_seconds")
    )


@query("review_staging", roles("""
  SELECT id AS candidate_id FROM queue_role q WHERE status IN ('discovered', 'canonical_source_found')
    AND id NOT IN (SELECT candidate_id FROM review_role WHERE status NOT IN ('rejected', 'activated'))
  ORDER BY coalesce(attempt_count, 0), first_discovered_at DESC, id DESC LIMIT 50"""))
def review_staging(spark, sf_dir):
    queue, _, reviews = three(spark, sf_dir)
    return op.stage_reviews(queue, reviews, "batch", 50).select("candidate_id")


@query("review_batch_counts", with_roles("review", then="""
  SELECT *, CASE WHEN remaining > 0 THEN 'processing' WHEN awaiting > 0 THEN 'ready' ELSE 'completed' END AS status FROM (
    SELECT batch_id, count(*) AS assigned, count(*) FILTER (WHERE status NOT IN ('queued', 'processing')) AS processed,
      count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'needs_review') AS needs_review,
      count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'queued') AS remaining,
      count(*) FILTER (WHERE status IN ('ready', 'approved')) AS awaiting FROM review_role GROUP BY 1)"""))
def review_batch_counts(spark, sf_dir):
    return op.batch_counts(role(spark, sf_dir, "review"))


@query("review_rejection_cascade", roles("""
  SELECT status, count(*) AS rows FROM (SELECT CASE WHEN id IN (SELECT candidate_id FROM review_role
    WHERE batch_id % 3 = 0 AND status IN ('ready', 'needs_review', 'failed', 'rejected')) AND id IN (SELECT candidate_id FROM review_role WHERE batch_id % 3 = 0)
    THEN 'rejected' ELSE status END AS status FROM queue_role) GROUP BY 1"""))
def review_rejection_cascade(spark, sf_dir):
    queue, _, reviews = three(spark, sf_dir)
    batch = reviews.filter("batch_id % 3 = 0")
    registry = role(spark, sf_dir, "registry")
    after = op.reject(batch, queue, registry, batch.select("candidate_id"))["queue"]
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query("first_source_per_company", with_roles("source", then="""
  SELECT company_id, source_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY enabled DESC, source_id) AS n
    FROM source_role) WHERE n = 1"""))
def first_source_per_company(spark, sf_dir):
    return op.first_source(role(spark, sf_dir, "source")).select("company_id", "source_id", "provider")


RECEIPT = """SELECT l_suppkey AS domain, l_linenumber AS attempt, l_orderkey * 64 + CAST(l_quantity AS BIGINT) AS position,
    CASE l_partkey % 4 WHEN 0 THEN 'ashby' WHEN 1 THEN 'lever' WHEN 2 THEN 'greenhouse' END AS provider,
    CASE l_suppkey % 3 WHEN 0 THEN 'explicit_startup' ELSE 'unknown' END AS classification,
    CASE WHEN l_quantity < 25 THEN 'complete' ELSE 'http_error' END AS fetch_status,
    CASE WHEN l_quantity < 15 THEN 'verified_us_jobs' ELSE 'unverified' END AS verified_status,
    CAST(l_quantity AS BIGINT) AS verified_jobs FROM {lineitem}"""


def receipts(spark, sf_dir):
    table(spark, sf_dir, "region")
    return spark.sql(RECEIPT.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))


LATEST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY attempt DESC, position DESC, provider, verified_jobs) AS n
    FROM ({RECEIPT.format(lineitem='lineitem')})) WHERE n = 1"""
TOTALS = """count(*) AS measured, count(provider) AS detected, count(*) FILTER (WHERE fetch_status = 'complete') AS complete,
    count(*) FILTER (WHERE verified_status = 'verified_us_jobs') AS verified_companies, CAST(sum(verified_jobs) AS BIGINT) AS verified_jobs"""


@query("yield_summary", f"""
  SELECT 'provider' AS kind, provider AS label, {TOTALS} FROM ({LATEST}) WHERE provider IS NOT NULL GROUP BY provider
  UNION ALL SELECT 'classification', classification, {TOTALS} FROM ({LATEST}) GROUP BY classification
  UNION ALL SELECT 'total', 'all', {TOTALS} FROM ({LATEST})""")
def yield_summary(spark, sf_dir):
    return op.yield_summary(receipts(spark, sf_dir))


@query("elapsed_percentiles", """
  SELECT l_returnflag, list_extract(v, CAST(ceil((len(v) - 1) * 0.5) AS BIGINT) + 1) AS median,
    list_extract(v, CAST(ceil((len(v) - 1) * 0.75) AS BIGINT) + 1) AS p75, list_min(v) AS minimum, list_max(v) AS maximum
  FROM (SELECT l_returnflag, list(CAST(l_extendedprice AS BIGINT) ORDER BY CAST(l_extendedprice AS BIGINT)) AS v
    FROM (SELECT l_returnflag, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1)""")
def elapsed_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.floor("l_extendedprice").alias("elapsed"))
    return op.nearest_rank(rows, ["l_returnflag"], "elapsed", {"median": 0.5, "p75": 0.75})


INPUT = """SELECT 'https://www.site' || CAST(o_custkey AS STRING) || CASE o_custkey % 3 WHEN 0 THEN '.co.uk/x' WHEN 1 THEN '.co.n9/x' ELSE '.town.n7/x' END AS website_url, 'Company ' || CAST(o_orderkey AS STRING) AS company_name,
    CASE WHEN o_orderkey % 50 = 0 THEN 'explicit_startup' ELSE 'directory' END AS classification, 'k' || CAST(o_orderkey % 5 AS STRING) AS source_id,
    CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'pending' END AS review_status,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'prohibited' ELSE 'permitted' END AS permission_status, o_orderkey AS position FROM {orders}"""


@query("measurement_inputs", f"""
  SELECT row_number() OVER (ORDER BY domain) - 1 AS input_index, domain, company_name, classification, sources FROM (
    SELECT regexp_replace(regexp_replace(website_url, '^https://www.', ''), '/x$', '') AS domain, arg_min(company_name, position) AS company_name,
      CASE WHEN max(CASE classification WHEN 'explicit_startup' THEN 1 ELSE 0 END) = 1 THEN 'explicit_startup' ELSE 'directory' END AS classification,
      string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources
    FROM ({INPUT.format(orders='orders')}) WHERE review_status = 'pending' AND permission_status = 'permitted' GROUP BY 1)""")
def measurement_inputs(spark, sf_dir):
    table(spark, sf_dir, "region")
    records = spark.sql(INPUT.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return op.dense_index(op.measurement_inputs(records, domain_rules(spark, sf_dir)), "domain").select(
        "input_index", "domain", "company_name", "classification", F.array_join("sources", ",").alias("sources")
    )


@query("source_receipt_counts", """
  SELECT count(*) AS configured, count(*) FILTER (WHERE o_orderstatus <> 'P') AS fetched, 0 AS manual,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS blocked, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS completed, TRUE AS reconciled FROM orders""")
def source_receipt_counts(spark, sf_dir):
    state = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.when(state == "O", "completed").when(state == "F", "failed").otherwise("blocked").alias("status"),
        (state != "P").alias("fetched"),
    )
    return op.receipt_counts(rows)
