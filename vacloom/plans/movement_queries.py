"""Movements of open roles over the order history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, role, with_roles
from ..operators import movements as op
from .catalog import query

SECTOR = """CASE industry WHEN 'AI / Precision medicine' THEN 'Healthcare'
  WHEN 'Payments and banking' THEN 'Financial Technology' WHEN 'Carbon removal' THEN 'Climate & Energy'
  WHEN 'Developer tools' THEN 'Developer Tools' WHEN 'B2B SaaS_workflow' THEN 'Enterprise Software'
  ELSE sector END"""
SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def three(spark, sf_dir):
    return [role(spark, sf_dir, n) for n in ("company", "job", "change")]


def roles(then):
    return with_roles("company", "job", "change", then=then)


DELTA = f"""
  SELECT c.company_id, coalesce(sum(CASE ch.change_type WHEN 'job_opened' THEN 1 WHEN 'job_closed' THEN -1 END), 0) AS delta
  FROM company_role c LEFT JOIN (
    SELECT change_type, occurred_at, CASE WHEN entity_type = 'company' THEN entity_id ELSE j.company_id END AS owner
    FROM change_role LEFT JOIN job_role j ON entity_type = 'job' AND j.job_id = entity_id
    WHERE change_type IN ('job_opened', 'job_closed')
      AND occurred_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL '30' DAY AND TIMESTAMP '{AS_OF}') ch
  ON ch.owner = c.company_id GROUP BY c.company_id"""


@query("company_delta_30d", roles(f"SELECT company_id, CAST(delta AS BIGINT) AS delta FROM ({DELTA})"))
def company_delta_30d(spark, sf_dir):
    return op.company_deltas(*three(spark, sf_dir), AS_OF)


@query("sector_statistics", roles(f"""
  SELECT {SLUG.format('name')} AS key, name, companies, open_roles,
    CAST(floor(score / companies + 0.5) AS BIGINT) AS mean_score, delta_30d,
    CAST(floor(open_roles * 100.0 / sum(open_roles) OVER () + 0.5) AS BIGINT) AS share
  FROM (SELECT {SECTOR} AS name, count(*) AS companies, CAST(sum(open_job_count) AS BIGINT) AS open_roles,
      sum(hiring_score) AS score, CAST(sum(delta) AS BIGINT) AS delta_30d
    FROM company_role JOIN ({DELTA}) USING (company_id) GROUP BY 1)"""))
def sector_statistics(spark, sf_dir):
    companies, jobs, changes = three(spark, sf_dir)
    return op.sector_stats(companies, op.company_deltas(companies, jobs, changes, AS_OF))


@query("company_delta_trailing_series", roles("""
  SELECT company_id, strftime(day, '%Y-%m-%d') AS day, CAST(net AS BIGINT) AS net,
    CAST(sum(net) OVER (PARTITION BY company_id ORDER BY day RANGE BETWEEN INTERVAL '29' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS delta
  FROM (SELECT j.company_id, CAST(occurred_at AS DATE) AS day,
      sum(CASE change_type WHEN 'job_opened' THEN 1 ELSE -1 END) AS net
    FROM change_role JOIN job_role j ON j.job_id = entity_id AND entity_type = 'job'
    WHERE change_type IN ('job_opened', 'job_closed') GROUP BY 1, 2)"""))
def company_delta_trailing_series(spark, sf_dir):
    _, jobs, changes = three(spark, sf_dir)
    return op.trailing_deltas(jobs, changes).withColumn("day", F.col("day").cast("string"))


EVIDENCE = f"""
  SELECT day, job_id, change_type, e.source_url, j.company_id, j.title, c.slug, c.name, c.hiring_score, {SECTOR} AS sector
  FROM (SELECT CAST(occurred_at AS DATE) AS day, entity_id, change_type, source_url,
      row_number() OVER (PARTITION BY CAST(occurred_at AS DATE), entity_id, change_type ORDER BY occurred_at DESC, id DESC) AS nth
    FROM change_role WHERE change_type IN ('job_opened', 'job_closed')) e
  JOIN job_role j ON j.job_id = e.entity_id JOIN company_role c ON c.company_id = j.company_id WHERE nth = 1"""
#: Evidence is computed once, whatever reads it.
ONCE = f", evidence AS MATERIALIZED ({EVIDENCE})"
COUNTS = """count(*) FILTER (WHERE change_type = 'job_opened') AS opened,
    count(*) FILTER (WHERE change_type = 'job_closed') AS closed, count(*) AS evidence_count,
    count(DISTINCT source_url) AS source_url_count, count(DISTINCT company_id) AS company_count,
    list(title ORDER BY title, job_id, change_type) AS titles"""
TYPE = "CASE WHEN opened > 0 AND closed > 0 THEN 'mixed' WHEN opened > 0 THEN 'opened' ELSE 'closed' END"
TEXT = """CASE WHEN opened > 0 AND closed > 0 THEN opened || ' opened and ' || closed || ' closed: '
      WHEN opened > 0 THEN opened || ' opened: ' ELSE closed || ' closed: ' END
    || array_to_string(titles[1:3], ', ') || CASE WHEN evidence_count > 3 THEN ' +' || (evidence_count - 3) || ' more' ELSE '' END || '.'"""
MOVED = ["id", "day", "type", "title", "description", "sector", "opened", "closed", "net", "evidence_count",
         "source_url_count", "company_count"]
COMPANY_DAY = f"""
  SELECT 'movement:company:' || strftime(day, '%Y-%m-%d') || ':' || company_id AS id, strftime(day, '%Y-%m-%d') AS day,
    {TYPE} AS type, name || CASE WHEN closed = 0 THEN ' opened ' || opened || CASE WHEN opened = 1 THEN ' role' ELSE ' roles' END
      WHEN opened = 0 THEN ' closed ' || closed || CASE WHEN closed = 1 THEN ' role' ELSE ' roles' END
      ELSE ' changed ' || evidence_count || ' roles' END AS title,
    {TEXT} AS description, sector, opened, closed, opened - closed AS net, evidence_count, source_url_count, company_count
  FROM (SELECT day, company_id, name, sector, {COUNTS} FROM evidence GROUP BY day, company_id, name, sector)"""
SECTOR_DAY = f"""
  SELECT 'movement:sector:' || strftime(day, '%Y-%m-%d') || ':' || {SLUG.format('sector')} AS id,
    strftime(day, '%Y-%m-%d') AS day, {TYPE} AS type,
    CASE WHEN closed = 0 THEN opened || ' new ' || sector || CASE WHEN opened = 1 THEN ' posting' ELSE ' postings' END
      WHEN opened = 0 THEN closed || ' ' || sector || CASE WHEN closed = 1 THEN ' posting' ELSE ' postings' END || ' closed'
      ELSE sector || ' hiring changed across ' || evidence_count || ' roles' END AS title,
    {TEXT} AS description, sector, opened, closed, opened - closed AS net, evidence_count, source_url_count, company_count
  FROM (SELECT day, sector, {COUNTS} FROM evidence GROUP BY day, sector)"""
FUNDING = f"""
  SELECT id, strftime(occurred_at, '%Y-%m-%d') AS day, 'funding' AS type, title, description, {SECTOR} AS sector,
    0 AS opened, 0 AS closed, 0 AS net, 1 AS evidence_count, 1 AS source_url_count, 1 AS company_count
  FROM change_role JOIN company_role ON company_id = entity_id AND entity_type = 'company' WHERE change_type = 'funding_announced'"""


def shown(df):
    return df.withColumn("day", F.col("day").cast("string")).select(*MOVED)


@query("movement_evidence", roles(f"""
  SELECT strftime(day, '%Y-%m-%d') AS day, job_id, change_type, source_url, company_id, sector FROM ({EVIDENCE})"""))
def movement_evidence(spark, sf_dir):
    return op.movement_evidence(*three(spark, sf_dir)).select(
        F.col("day").cast("string").alias("day"), "job_id", "change_type", "source_url", "company_id", "sector"
    )


LISTED = """SELECT {id} AS id, 'evidence:' || change_type || ':' || job_id AS item, title AS about, source_url AS url FROM evidence
  UNION SELECT {id}, 'source', NULL, source_url FROM evidence"""


@query("movement_evidence_lists", roles(f"""{ONCE}
  {LISTED.format(id="'movement:company:' || strftime(day, '%Y-%m-%d') || ':' || company_id")}
  UNION ALL {LISTED.format(id="'movement:sector:' || strftime(day, '%Y-%m-%d') || ':' || " + SLUG.format('sector'))}"""))
def movement_evidence_lists(spark, sf_dir):
    """What each movement is counted from: its events with their titles, and its distinct source URLs."""
    evidence = op.movement_evidence(*three(spark, sf_dir))
    return op.evidence_lists(evidence, op.company_movement_id()).unionByName(op.evidence_lists(evidence, op.sector_movement_id()))


@query("movements_company_day", roles(ONCE + COMPANY_DAY))
def movements_company_day(spark, sf_dir):
    return shown(op.company_day_movements(op.movement_evidence(*three(spark, sf_dir))))


@query("movements_sector_day", roles(ONCE + SECTOR_DAY))
def movements_sector_day(spark, sf_dir):
    return shown(op.sector_day_movements(op.movement_evidence(*three(spark, sf_dir))))


@query("movements_several_companies", roles(f"{ONCE} SELECT id, company_count FROM ({SECTOR_DAY}) WHERE company_count > 1"))
def movements_several_companies(spark, sf_dir):
    moved = op.sector_day_movements(op.movement_evidence(*three(spark, sf_dir)))
    return moved.filter("company_count > 1").select("id", "company_count")


@query("movements_funding", roles(FUNDING))
def movements_funding(spark, sf_dir):
    companies, _, changes = three(spark, sf_dir)
    return shown(op.funding_movements(companies, changes))


@query("movements_all_groups", roles(f"{ONCE} {COMPANY_DAY} UNION ALL {SECTOR_DAY} UNION ALL {FUNDING}"))
def movements_all_groups(spark, sf_dir):
    return shown(op.by_weight(op.market_movements(*three(spark, sf_dir))))


@query("movements_sector_with_funding", roles(f"{ONCE} SELECT id, type, day FROM ({SECTOR_DAY} UNION ALL {FUNDING})"))
def movements_sector_with_funding(spark, sf_dir):
    moved = op.market_movements(*three(spark, sf_dir), group="sector", funding_with_sectors=True)
    return op.by_day(moved).select("id", "type", F.col("day").cast("string").alias("day"))


@query("movements_between", roles(f"""{ONCE}
  SELECT id, day, type, net FROM ({COMPANY_DAY} UNION ALL {FUNDING})
  WHERE day > '2000-03-01' AND day < '2000-09-01' AND type = 'mixed' AND lower(sector) = 'healthcare'
    OR day > '2000-03-01' AND day < '2000-09-01' AND type = 'funding' AND lower(sector) = 'healthcare'"""))
def movements_between(spark, sf_dir):
    moved = op.market_movements(*three(spark, sf_dir), group="company")
    bounds = {"after": "2000-03-01 23:59:59.999", "before": "2000-08-31 23:59:59.9995", "sector": "healthcare"}
    mixed, funding = [op.movement_filter(moved, kind=k, **bounds) for k in ("mixed", "funding")]
    return op.by_day(mixed.unionByName(funding)).select("id", F.col("day").cast("string").alias("day"), "type", "net")


@query("movements_matching_text", roles(f"""{ONCE}
  SELECT id FROM ({COMPANY_DAY}) WHERE (lower(title) LIKE '%customer#000000013%')
    AND (lower(description) LIKE '%engineer%' OR lower(title) LIKE '%engineer%' OR lower(sector) LIKE '%engineer%')"""))
def movements_matching_text(spark, sf_dir):
    moved = op.company_day_movements(op.movement_evidence(*three(spark, sf_dir)))
    return op.movement_filter(moved, company="Customer#000000013", q="engineer").select("id")


@query("movements_raw", roles(f"""
  SELECT ch.id, strftime(occurred_at, '%Y-%m-%d') AS day,
    CASE WHEN change_type = 'job_updated' THEN 'updated' WHEN j.job_id IS NULL THEN 'funding'
      WHEN change_type = 'job_opened' THEN 'opened' ELSE 'closed' END AS type,
    CASE WHEN c.company_id IS NULL THEN 'Other' ELSE {SECTOR} END AS sector, c.company_id, c.slug,
    CASE WHEN change_type = 'job_opened' THEN 1 WHEN change_type = 'job_closed' THEN -1 ELSE 0 END AS net,
    nullif(c.hiring_score, 0) AS hiring_score, j.title AS job_title,
    CASE WHEN j.job_id IS NOT NULL THEN '/job/' || j.job_id WHEN c.company_id IS NOT NULL THEN '/company/' || c.slug
      ELSE ch.source_url END AS href
  FROM change_role ch LEFT JOIN job_role j ON entity_type = 'job' AND j.job_id = entity_id
  LEFT JOIN company_role c ON c.company_id = coalesce(j.company_id, entity_id)"""))
def movements_raw(spark, sf_dir):
    return op.raw_movements(*three(spark, sf_dir)).select(
        "id", F.col("day").cast("string").alias("day"), "type", "sector", "company_id", "slug", "net",
        "hiring_score", F.try_element_at("jobs", F.lit(1))["title"].alias("job_title"), "href",
    )


@query("homepage_changes", roles("""
  SELECT ch.id, ch.change_type, c.company_id, c.name AS company_name
  FROM change_role ch LEFT JOIN job_role j ON entity_type = 'job' AND j.job_id = entity_id
  LEFT JOIN company_role c ON c.company_id = CASE WHEN entity_type = 'company' THEN entity_id ELSE j.company_id END
  WHERE ch.occurred_at >= TIMESTAMP '2001-06-15' OR ch.change_type = 'funding_announced'"""))
def homepage_changes(spark, sf_dir):
    return op.homepage_changes(*three(spark, sf_dir), since="2001-06-15").select(
        "id", "change_type", "company_id", "company_name"
    )


@query("moved_jobs", roles("""
  SELECT DISTINCT j.job_id, j.company_id FROM job_role j JOIN change_role ON entity_id = j.job_id
  WHERE occurred_at >= TIMESTAMP '2001-05-01' AND change_type IN ('job_opened', 'job_closed')"""))
def moved_jobs(spark, sf_dir):
    _, jobs, changes = three(spark, sf_dir)
    return op.moved_jobs(jobs, changes, "2001-05-01").select("job_id", "company_id")


@query("latest_data_timestamp", roles("""
  SELECT strftime(greatest((SELECT max(last_verified_at) FROM company_role), (SELECT max(last_verified_at) FROM job_role),
    (SELECT max(occurred_at) FROM change_role)), '%Y-%m-%d %H:%M:%S') AS latest"""))
def latest_data_timestamp(spark, sf_dir):
    return op.latest_timestamp(*three(spark, sf_dir)).select(
        F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest")
    )
