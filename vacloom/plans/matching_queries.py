"""Documents seen as postings of mirror boards, matched to the documents they repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import role, table, with_roles
from ..operators import matching as op
from .catalog import query

KEY = "trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def tokens(key):
    return f"list_distinct(list_filter(string_split({key}, ' '), lambda t: length(t) > 1))"


def jaccard(a, b):
    return f"(len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE))"


def features(role_name):
    return f"""SELECT *, {tokens('location_key')} AS place, {tokens(KEY.format('summary'))} AS words FROM (
      SELECT *, {KEY.format('title')} AS title_key, {KEY.format('location')} AS location_key FROM {role_name})"""


CONTENT = f"""
  SELECT x.posting_id, x.job_id, max(0.35 + 0.15 + location * 0.2 + description * 0.2 + 0.1) AS score FROM (
    SELECT p.posting_id, c.job_id,
      CASE WHEN p.location_key = c.location_key THEN 1.0 WHEN len(p.place) = 0 OR len(c.place) = 0 THEN 0.0
        ELSE {jaccard('p.place', 'c.place')} END AS location, {jaccard('p.words', 'c.words')} AS description
    FROM ({features('posting_role')}) p JOIN ({features('candidate_role')}) c
      ON c.company_id = p.company_id AND c.title_key = p.title_key AND c.status = 'verified_open'
      AND c.source_id <> p.source_id AND abs(epoch_ms(p.published_at) - epoch_ms(c.published_at)) <= 14 * 86400000
    WHERE p.location_key <> '' AND c.location_key <> '' AND len(p.words) > 0 AND len(c.words) > 0) x
  WHERE location >= 0.6 AND description >= 0.55 GROUP BY 1, 2"""
BEST = f"""
  SELECT posting_id, job_id, score FROM (
    SELECT *, row_number() OVER w AS nth, lead(score) OVER w AS second FROM ({CONTENT})
    WINDOW w AS (PARTITION BY posting_id ORDER BY score DESC, job_id))
  WHERE nth = 1 AND (second IS NULL OR NOT score - second < 0.05)"""


def both_sides(spark, sf_dir):
    return (
        role(spark, sf_dir, "posting"), role(spark, sf_dir, "candidate"),
    )


@query("match_content", with_roles("posting", "candidate", then=f"""
  SELECT posting_id, job_id, CAST(floor(score * 10000 + 0.5) AS BIGINT) AS score_bps FROM ({BEST})"""))
def match_content(spark, sf_dir):
    found = op.content_matches(*both_sides(spark, sf_dir))
    return found.select("posting_id", "job_id", F.floor(F.col("score") * 10000 + 0.5).alias("score_bps"))


@query("match_entities", with_roles("posting", "candidate", then=f"""
  , stable AS (SELECT p.posting_id, c.job_id FROM posting_role p JOIN candidate_role c
      USING (company_id, provider, source_id, external_id)),
  urls AS (SELECT posting_id, min(c.job_id) AS job_id FROM posting_role p JOIN candidate_role c ON p.company_id = c.company_id
      AND regexp_replace(regexp_replace(replace(lower(p.canonical_url), ':443', ''), '[?].*$', ''), '([^:])//', '\\1/')
        = regexp_replace(replace(lower(c.canonical_url), '/#top', ''), '[?].*$', '')
    WHERE posting_id NOT IN (SELECT posting_id FROM stable) GROUP BY 1 HAVING count(DISTINCT c.job_id) = 1),
  best AS ({BEST})
  SELECT posting_id, job_id, 'stable_id' AS method, 10000 AS score_bps FROM stable
  UNION ALL SELECT posting_id, job_id, 'canonical_url', 10000 FROM urls
  UNION ALL SELECT posting_id, job_id, 'high_confidence', CAST(floor(score * 10000 + 0.5) AS BIGINT) FROM best
    WHERE posting_id NOT IN (SELECT posting_id FROM stable) AND posting_id NOT IN (SELECT posting_id FROM urls)""").replace("\n\n  , stable", ", stable").replace("\n  , stable", ", stable"))
def match_entities(spark, sf_dir):
    found = op.match_entities(*both_sides(spark, sf_dir))
    return found.select(
        "posting_id", "job_id", "method", F.floor(F.col("score") * 10000 + 0.5).alias("score_bps")
    )


@query("candidate_universe_sizes", with_roles("candidate", then="""
  SELECT company_id, 2 * count(*) AS candidates, count(DISTINCT job_id) AS jobs FROM candidate_role GROUP BY 1"""))
def candidate_universe_sizes(spark, sf_dir):
    jobs = role(spark, sf_dir, "candidate")
    observations = jobs.select(
        "job_id", "provider", F.concat(F.lit("mirror-"), "source_id").alias("source_id"), "external_id",
        F.concat("canonical_url", F.lit("&m=1")).alias("canonical_url"),
    )
    return op.candidate_universe(jobs, observations).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("job_id").alias("jobs")
    )


REPEATED = """SELECT l_suppkey AS source_id, CAST(l_partkey AS STRING) AS external_id,
    l_returnflag AS title, l_orderkey * 100000 + l_linenumber * 1000 + CAST(l_quantity AS BIGINT) AS position FROM lineitem"""


@query("duplicate_postings", f"""
  SELECT source_id, external_id, count(DISTINCT title) > 1 AS conflicting FROM ({REPEATED}) GROUP BY 1, 2""")
def duplicate_postings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").cast("string").alias("external_id"),
        F.col("l_returnflag").alias("title"), F.col("l_orderkey").alias("position"),
    )
    # Each identity is its own scope here, so that a contradiction does not hide its neighbours.
    clean, conflicting = op.collapse_duplicates(rows, ["source_id", "external_id"], "external_id")
    return clean.distinct().select("source_id", "external_id", F.lit(False).alias("conflicting")).unionByName(
        conflicting.select("source_id", F.col("external_id"), F.lit(True).alias("conflicting"))
    )
