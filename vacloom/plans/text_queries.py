"""Text keys, labels and classifications over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, role, table, with_roles
from ..functions import classify as c
from ..functions import hashing as h
from ..functions import text as t
from ..functions import urls as u
from ..operators import discovery
from .catalog import query

KEY = "trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("document_text_keys", f"""
  SELECT doc_id, md5({KEY.format('text')}) AS digest,
    len(list_distinct(list_filter(string_split({KEY.format('text')}, ' '), lambda w: length(w) > 1))) AS tokens FROM documents""")
def document_text_keys(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", t.text_key(F.col("text")).alias("k"))
    return keyed.select("doc_id", F.md5("k").alias("digest"), F.size(t.token_set(F.col("k"))).cast("long").alias("tokens"))


@query("document_summaries", """
  SELECT doc_id, CASE WHEN body <> '' THEN substr(body, 1, 220) ELSE 'Canonical posting for ' || source || '.' END AS summary
  FROM (SELECT doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents)""")
def document_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.summary(F.col("source"), F.col("text")).alias("summary")
    )


@query("employment_types", with_roles("job", then="""
  SELECT job_id, CASE employment_type WHEN 'Contract' THEN 'contract' WHEN 'Part_Time' THEN 'parttime' ELSE 'fulltime' END AS type_key,
    CASE employment_type WHEN 'Contract' THEN 'Contract' WHEN 'Part_Time' THEN 'Part time' ELSE 'Full time' END AS label FROM job_role"""))
def employment_types(spark, sf_dir):
    return role(spark, sf_dir, "job").select(
        "job_id", t.employment_key(F.col("employment_type")).alias("type_key"),
        t.employment_label(F.col("employment_type")).alias("label"),
    )


@query("role_families", with_roles("job", then="""
  SELECT job_id, CASE title WHEN 'Senior Software Engineer' THEN 'Engineering' WHEN 'Product Designer' THEN 'Product'
    WHEN 'Data Scientist' THEN 'Data and research' WHEN 'Sales Lead' THEN 'GTM' WHEN 'Talent Partner' THEN 'People operations'
    WHEN 'chief of staff' THEN 'Operations' WHEN 'Backend Developer' THEN 'Engineering' ELSE 'Other' END AS family FROM job_role"""))
def role_families(spark, sf_dir):
    return role(spark, sf_dir, "job").select("job_id", c.role_family(F.col("title")).alias("family"))


@query("company_sectors", with_roles("company", then="""
  SELECT company_id, CASE industry WHEN 'AI / Precision medicine' THEN 'Healthcare' WHEN 'Payments and banking' THEN 'Financial Technology'
    WHEN 'Carbon removal' THEN 'Climate & Energy' WHEN 'Developer tools' THEN 'Developer Tools' WHEN 'B2B SaaS_workflow' THEN 'Enterprise Software'
    WHEN 'Not published' THEN CASE WHEN company_id % 10 = 1 THEN 'Legal Technology' ELSE 'Other' END ELSE 'Other' END AS sector FROM company_role"""))
def company_sectors(spark, sf_dir):
    companies = role(spark, sf_dir, "company").drop("sector")
    listed = companies.filter("company_id % 10 = 1").select("domain", F.lit("Legal Technology").alias("sector"))
    rows = c.with_sector_override(companies, "domain", listed)
    return rows.select("company_id", c.sector_of(
        F.col("industry"), name=F.col("name"), domain=F.col("domain"), override=F.col("override")
    ).alias("sector"))


@query("us_eligible_jobs", with_roles("job", then="""
  SELECT job_id FROM job_role WHERE location IN ('New York', 'San Francisco, USA')
    OR (remote_status = 'Remote' AND location IN ('Remote', ''))"""))
def us_eligible_jobs(spark, sf_dir):
    remote = F.col("remote_status") == "Remote"
    return role(spark, sf_dir, "job").filter(c.us_eligible(F.col("location"), remote)).select("job_id")


@query("job_url_keys", with_roles("job", then="""
  SELECT job_id, 'https://jobs.example.com/c' || company_id || '/' || job_id || '?a=1&b=2' AS url,
    'jobs.example.com' AS host FROM job_role"""))
def job_url_keys(spark, sf_dir):
    url = F.col("canonical_url")
    return role(spark, sf_dir, "job").select("job_id", u.canonical_url(url).alias("url"), u.bare_host(url).alias("host"))


@query("review_clusters", with_roles("job", then="""
  SELECT company_id, k AS cluster, count(*) AS rows FROM (SELECT company_id,
      trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(location), '[^a-z0-9]+', ' ', 'g'))
      || '|' || trim(regexp_replace(lower(employment_type), '[^a-z0-9]+', ' ', 'g')) AS k FROM job_role) GROUP BY 1, 2 HAVING count(*) > 1"""))
def review_clusters(spark, sf_dir):
    key = F.concat_ws("|", *[t.comparable_key(F.col(n)) for n in ("title", "location", "employment_type")])
    return role(spark, sf_dir, "job").groupBy("company_id", key.alias("cluster")).agg(
        F.count(F.lit(1)).alias("rows")
    ).filter("rows > 1")


@query("failure_classes", with_roles("queue", then="""
  SELECT id, CASE last_error WHEN 'HTTP 404' THEN 'http_error' WHEN 'fetch failed: HTTP 503' THEN 'http_error' ELSE 'fetch_error' END AS class,
    last_error IN ('fetch failed: HTTP 503', 'robots disallow') AS transient FROM queue_role WHERE last_error IS NOT NULL"""))
def failure_classes(spark, sf_dir):
    message = F.col("last_error")
    return role(spark, sf_dir, "queue").filter(message.isNotNull()).select(
        "id", c.failure_status(message).alias("class"), c.transient_failure(message).alias("transient")
    )


@query("retry_times", with_roles("queue", then=f"""
  SELECT id, least(604800, 21600 * CAST(pow(2, greatest(coalesce(attempt_count, 0) - 1, 0)) AS BIGINT)) AS seconds, 7200 AS activation
  FROM queue_role"""))
def retry_times(spark, sf_dir):
    now = F.lit(AS_OF).cast("timestamp")
    at = discovery.retry_at(now, F.coalesce("attempt_count", F.lit(0)))
    return role(spark, sf_dir, "queue").select(
        "id", (F.unix_seconds(at) - F.unix_seconds(now)).alias("seconds"),
        (F.unix_seconds(discovery.activation_due(now)) - F.unix_seconds(now)).alias("activation"),
    )


@query("probe_dispositions", """
  SELECT l_orderkey, CASE WHEN max(l_quantity) = 50 THEN 'source_detected' WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 'no_source_on_reachable_pages'
    WHEN count(DISTINCT l_returnflag) > 1 THEN 'all_probe_pages_failed_mixed' WHEN min(l_returnflag) = 'N' THEN 'all_http_error'
    ELSE 'all_robots_or_network_error' END AS disposition FROM lineitem GROUP BY 1""")
def probe_dispositions(spark, sf_dir):
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "fetched").when(flag == "N", "http_error").otherwise("robots_or_network_error")
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_quantity") == 50).alias("found"), F.collect_set(status).alias("statuses")
    )
    return grouped.select("l_orderkey", c.probe_disposition(F.col("found"), F.col("statuses")).alias("disposition"))


@query("directory_batches", """
  SELECT p_partkey, CASE WHEN p_size % 30 >= 18 THEN 'recent_yc_startup' ELSE 'yc_startup' END AS class FROM part""")
def directory_batches(spark, sf_dir):
    batch = F.concat(F.lit("S"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", c.directory_class(batch).alias("class"))


@query("slug_candidates", """
  SELECT p_partkey, CASE WHEN length(replace(p_name, ' ', '-')) < 3 THEN '' ELSE replace(p_name, ' ', '-') || ',' || replace(p_name, ' ', '') END AS slugs,
    replace(p_brand, '#', '') AS suffix FROM part""")
def slug_candidates(spark, sf_dir):
    domain = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".io"))
    brand = F.concat(F.lit("directory:"), F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(u.slug_candidates(domain), ",").alias("slugs"), u.identifier_suffix(brand).alias("suffix")
    )


@query("board_name_checks", """
  SELECT p_partkey, starts_with(lower(regexp_replace(p_name, '[^a-z]', '', 'g')), 'red') OR p_type = 'ECONOMY' AS agrees FROM part""")
def board_name_checks(spark, sf_dir):
    company = F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).otherwise("zz")
    return table(spark, sf_dir, "part").select(
        "p_partkey", u.board_name_matches(F.col("p_name"), company, F.lit("red")).alias("agrees")
    )


@query("job_identifiers", with_roles("job", then="""
  SELECT job_id, 'job_' || coalesce(provider, source) || '_' || source_id || '_' || external_id AS stem,
    coalesce(provider, source) || ':' || source_id || ':' || external_id AS identity FROM job_role"""))
def job_identifiers(spark, sf_dir):
    provider = F.coalesce("provider", "source")
    full = h.job_id(provider, F.col("source_id"), F.col("external_id"))
    return role(spark, sf_dir, "job").select(
        "job_id", F.regexp_replace(full, "_[0-9a-f]{16}$", "").alias("stem"),
        h.identity_key(provider, F.col("source_id"), F.col("external_id")).alias("identity"),
    )
