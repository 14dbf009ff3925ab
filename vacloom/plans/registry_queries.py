"""Registry building over orders seen as directory records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import domain_rules, table
from ..operators import registry as op
from .catalog import query

# Every eighth company's host ends in a suffix that only the nations' rules know.
SITE = "'https://www.co' || CAST(o_custkey AS STRING) || CASE WHEN o_custkey % 8 = 3 THEN '.co.n9/' WHEN o_custkey % 8 = 4 THEN '.town.n7/' ELSE '.com/' END"
RECORD = f"""SELECT o_orderkey AS record_id, o_orderkey AS position, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'Co  ' || CAST(o_orderkey AS STRING) END AS company_name,
    CASE WHEN o_orderkey % 19 = 0 THEN 'http://co.com' ELSE {SITE} END AS website_url, 'https://dir.example.org/' || CAST(o_custkey AS STRING) AS evidence_url,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'https://terms.example.org/' END AS terms_url, 'permitted' AS permission_status,
    'k' || CAST(o_orderkey % 3 AS STRING) AS source_id, 'directory' AS source_kind, 'startup' AS classification,
    CASE WHEN o_orderkey % 7 = 0 THEN 'active' WHEN o_orderkey % 7 = 1 THEN 'inactive' ELSE 'unknown' END AS activity_state,
    CASE WHEN o_orderkey % 5 = 0 THEN 'verified' ELSE 'pending' END AS review_status, CAST(o_orderdate AS TIMESTAMP) AS observed_at FROM {{orders}}"""
VALID = "company_name <> ' ' AND website_url NOT LIKE 'http:%' AND terms_url IS NOT NULL"
DOMAIN = "regexp_extract(website_url, '^https://www\\.([^/]+)/', 1)"


def spark_rows(spark, sf_dir, sql):
    table(spark, sf_dir, "region")
    for name in ("orders", "lineitem", "part", "customer"):
        sql = sql.replace("{" + name + "}", f"parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)


def built(spark, sf_dir):
    records = spark_rows(spark, sf_dir, RECORD).withColumn("observed_urls", F.array("website_url", F.concat("website_url", F.lit("about"))))
    aliases = records.filter("record_id % 11 = 0").select(
        "record_id", F.concat(F.lit("alias"), F.col("record_id") % 40, F.lit(".io")).alias("alias_domain"), "evidence_url"
    )
    acquisitions = records.filter("record_id % 13 = 0").select(
        "record_id", F.lit("buyer.com").alias("related_domain"), F.lit("acquired_by").alias("relation"), "evidence_url"
    )
    return op.build_registry(records, aliases, acquisitions, domain_rules(spark, sf_dir))


@query("registry_entries", f"""
  SELECT {DOMAIN} AS domain, regexp_replace(arg_min(company_name, position), ' +', ' ', 'g') AS company_name,
    coalesce(arg_min(activity_state, position) FILTER (WHERE activity_state <> 'unknown'), 'unknown') AS activity_state,
    coalesce(arg_min(review_status, position) FILTER (WHERE review_status <> 'pending'), 'pending') AS review_status
  FROM ({RECORD.format(orders='orders')}) WHERE {VALID} GROUP BY 1""")
def registry_entries(spark, sf_dir):
    return built(spark, sf_dir)["entries"].select("domain", "company_name", "activity_state", "review_status")


@query("registry_evidence", f"""
  SELECT {DOMAIN} AS domain, source_id, strftime(arg_max(observed_at, position), '%Y-%m-%d') AS observed FROM ({RECORD.format(orders='orders')}) WHERE {VALID} GROUP BY 1, 2""")
def registry_evidence(spark, sf_dir):
    return built(spark, sf_dir)["evidence"].select("domain", "source_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed"))


@query("registry_receipt", f"""
  SELECT count(*) AS input_records, count(*) FILTER (WHERE {VALID}) AS valid_records, count(*) FILTER (WHERE NOT ({VALID})) AS rejected_records,
    count(DISTINCT CASE WHEN {VALID} THEN {DOMAIN} END) AS domains,
    count(*) FILTER (WHERE {VALID}) - count(DISTINCT CASE WHEN {VALID} THEN {DOMAIN} END) AS duplicate_domains FROM ({RECORD.format(orders='orders')})""")
def registry_receipt(spark, sf_dir):
    return built(spark, sf_dir)["receipt"]


ALIAS = f"SELECT DISTINCT 'alias' || (record_id % 40) || '.io' AS alias_domain, {DOMAIN} AS domain FROM ({RECORD.format(orders='orders')}) WHERE {VALID} AND record_id % 11 = 0"


@query("registry_conflicts", f"""
  SELECT 'alias_has_multiple_owners' AS conflict, alias_domain FROM ({ALIAS}) GROUP BY 2 HAVING count(*) > 1""")
def registry_conflicts(spark, sf_dir):
    parts = built(spark, sf_dir)
    return op.identity_conflicts(parts["entries"], parts["aliases"])


@query("registry_resolution", f"""
  SELECT l_orderkey, l_linenumber, coalesce(e.domain, a.domain, v.value) AS canonical_domain FROM (
    SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'alias' || (l_orderkey % 60) || '.io' ELSE 'co' || l_suppkey || '.com' END AS value FROM lineitem) v
  LEFT JOIN (SELECT DISTINCT {DOMAIN} AS domain FROM ({RECORD.format(orders='orders')}) WHERE {VALID}) e ON e.domain = v.value
  LEFT JOIN (SELECT alias_domain, min(domain) AS domain FROM ({ALIAS}) GROUP BY 1) a ON a.alias_domain = v.value""")
def registry_resolution(spark, sf_dir):
    parts = built(spark, sf_dir)
    values = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(
        F.col("l_linenumber") == 1, F.concat(F.lit("alias"), F.col("l_orderkey") % 60, F.lit(".io"))
    ).otherwise(F.concat(F.lit("co"), "l_suppkey", F.lit(".com"))).alias("value")).distinct()
    return op.resolve_domains(values, "value", parts["entries"], parts["aliases"], domain_rules(spark, sf_dir)).select("l_orderkey", "l_linenumber", "canonical_domain")


@query("merged_candidates", """
  SELECT 'site' || l_suppkey || '.com' AS domain, arg_min('n' || l_orderkey, l_orderkey) AS name, count(DISTINCT l_partkey % 9) AS investors
  FROM lineitem GROUP BY 1""")
def merged_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), "l_orderkey").alias("name"), F.concat(F.lit("https://www.site"), "l_suppkey", F.lit(".com/x")).alias("website_url"),
        (F.col("l_partkey") % 9).alias("investor_id"), F.lit("https://e.example.org/").alias("evidence_url"), F.col("l_orderkey").alias("position"),
    )
    merged, links = op.merge_candidates(rows)
    return merged.join(links.groupBy("domain").agg(F.count(F.lit(1)).alias("investors")), "domain").select("domain", "name", "investors")


@query("directory_companies", """
  SELECT p_partkey % 700 AS n, arg_min(p_name, p_partkey) AS name, 'https://site' || min(p_partkey) || '.com/' AS website_url FROM part
  WHERE p_size % 3 <> 0 GROUP BY 1""")
def directory_companies(spark, sf_dir):
    part = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        (part % 700).cast("string").alias("slug"), F.col("p_name").alias("name"),
        F.concat(F.lit("ftp://x, http://site"), part, F.lit(".com/")).alias("website"),
        F.when(F.col("p_size") % 3 != 0, "Active").otherwise("Inactive").alias("status"), F.lit("W21").alias("batch"), part.alias("position"),
    )
    return op.directory_evidence(rows, domain_rules(spark, sf_dir)).select(F.col("slug").cast("long").alias("n"), "name", "website_url")


@query("chosen_websites", """
  SELECT o_custkey AS entity_id, arg_min(site, (length(path), length(site), site)) AS website_url FROM (
    SELECT o_custkey, 'https://a' || (o_orderkey % 3) || '.com/' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'p' || (o_orderkey % 5) END AS site,
      '/' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'p' || (o_orderkey % 5) END AS path FROM orders) GROUP BY 1""")
def chosen_websites(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.concat(
        F.lit("https://a"), key % 3, F.lit(".com/"), F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("p"), key % 5))
    ).alias("website"))
    return op.choose_websites(rows, domain_rules(spark, sf_dir))[0]
