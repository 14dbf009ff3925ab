"""Career pages made from orders: structured, broken, semantic and empty ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import dealt
from ..sources import pages as op
from .catalog import query

K = "CAST(o_orderkey AS STRING)"
HOST = "'www.acme' || CAST(o_custkey AS STRING) || '.com'"
POSTING = f"""'{{"@type":["Thing","JobPosting"],"title":"Engineer ' || {K} || '","description":"<p>Build things</p>","hiringOrganization":{{"name":"Acme","sameAs":"https://' || {HOST}
  || '/"}},"identifier":{{"value":"' || CASE WHEN o_orderkey % 32 = 0 THEN 'same' ELSE 'ID-' || {K} END || '"}},"jobLocation":' || CASE WHEN o_orderkey % 3 = 0
    THEN '[{{"address":{{"addressLocality":"Austin","addressRegion":"TX","addressCountry":"US"}}}},{{"name":"Austin"}}]' ELSE '{{"address":{{"addressLocality":"Austin","addressRegion":"TX","addressCountry":"US"}}}}' END
  || ',"jobLocationType":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'TELECOMMUTE' ELSE '' END || '","employmentType":' || CASE WHEN o_orderkey % 3 = 1 THEN '["FULL_TIME","CONTRACTOR"]' ELSE '"FULL_TIME"' END
  || ',"baseSalary":{{"currency":"USD","value":{{"minValue":10' || CASE WHEN o_orderkey % 5 = 1 THEN '' ELSE ',"maxValue":20' END || '}}}},"datePosted":"2001-02-03","validThrough":"'
  || CASE WHEN o_orderkey % 7 = 0 THEN '2001-01-01' ELSE '2031-01-01' END || '"}}'"""
LD = "'<script type=\"application/ld+json\">' || {} || '</script>'"
APPLY = f"'<a href=\"/apply/' || {K} || '\">Apply now</a>'"
BODY = f"""'<h1>Designer ' || {K} || '</h1><p>Location: Austin, TX, United States | Job ID: R' || {K} || ' | Full-time at $100,000 – $120,000 a year.</p><p>' || repeat('We design things. ', 20) || '</p>'"""
PAGES = f"""SELECT o_orderkey AS page_id, 'https://' || {HOST} || '/jobs/' || {K} AS url, CASE o_orderkey % 4
  WHEN 0 THEN {LD.format(f"CASE WHEN o_orderkey % 8 = 0 THEN '{{\"@graph\":[[{{\"@type\":\"Organization\"}}],' || {POSTING} || ']}}' ELSE {POSTING} END")} || {APPLY}
  WHEN 1 THEN {LD.format("'{broken'")} || {BODY} || {APPLY}
  WHEN 2 THEN {BODY} || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE {APPLY} END
  ELSE {LD.format("'{\"@type\":\"WebPage\"}'")} || '<h1>About us</h1>' END AS html FROM {{orders}}"""
AS_OF = "2001-08-01 00:00:00"
SHOWN = ["page_id", "external_id", "title", "location", "remote_status", "employment_type", "compensation", "canonical_url"]
STRUCTURED = f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 32 = 0 THEN 'same' ELSE 'ID-' || {K} END AS external_id, 'Engineer ' || {K} AS title, 'Austin, TX, US' AS location,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Remote' ELSE 'See posting' END AS remote_status, CASE WHEN o_orderkey % 3 = 1 THEN 'FULL_TIME, CONTRACTOR' ELSE 'FULL_TIME' END AS employment_type,
  CASE WHEN o_orderkey % 5 = 1 THEN 'USD 10–10' ELSE 'USD 10–20' END AS compensation, 'https://' || {HOST} || '/jobs/' || {K} AS canonical_url, o_custkey
  FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 7 <> 0"""
SEMANTIC = f"""SELECT o_orderkey AS page_id, 'R' || {K} AS external_id, 'Designer ' || {K} AS title, 'Austin, TX, United States' AS location, 'See posting' AS remote_status,
  'Full-time' AS employment_type, '$100,000 – $120,000' AS compensation, 'https://' || {HOST} || '/jobs/' || {K} AS canonical_url, o_custkey
  FROM orders WHERE o_orderkey % 4 = 2 AND o_orderkey % 6 <> 0"""


def career_pages(spark, sf_dir):
    own = PAGES.replace("{", "{{").replace("}", "}}").replace("{{orders}}", "{orders}")
    return spark.sql(own, orders=dealt(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))


@query("career_jsonld_nodes", "SELECT o_orderkey AS page_id, o_orderkey % 4 <> 1 AS complete, o_orderkey % 4 = 0 AS has_posting FROM orders")
def career_jsonld_nodes(spark, sf_dir):
    return op.jsonld_postings(career_pages(spark, sf_dir)).select("page_id", "complete", F.col("node").isNotNull().alias("has_posting"))


@query("career_structured_postings", f"SELECT {', '.join(SHOWN)} FROM ({STRUCTURED})")
def career_structured_postings(spark, sf_dir):
    return op.structured_postings(career_pages(spark, sf_dir), AS_OF).select(SHOWN)


@query("career_semantic_postings", f"SELECT {', '.join(SHOWN)} FROM ({SEMANTIC.replace('WHERE o_orderkey % 4 = 2', 'WHERE o_orderkey % 4 = 1 OR o_orderkey % 4 = 2')})")
def career_semantic_postings(spark, sf_dir):
    return op.semantic_postings(career_pages(spark, sf_dir)).select(SHOWN)


@query("career_postings", f"""
  WITH r AS (SELECT * FROM ({STRUCTURED}) UNION ALL SELECT * FROM ({SEMANTIC}))
  SELECT {', '.join(SHOWN)} FROM r WHERE o_custkey NOT IN (SELECT o_custkey FROM r GROUP BY o_custkey, external_id HAVING count(*) > 1)""")
def career_postings(spark, sf_dir):
    return op.career_postings(career_pages(spark, sf_dir), AS_OF).select(SHOWN)
