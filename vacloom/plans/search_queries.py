"""Search over jobs joined with companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..bindings import role, with_roles
from ..functions.classify import sector_of
from ..operators import search as op
from .catalog import query

PAGE_COLUMNS = ["position", "job_id", "company_id", "title", "hiring_score", "rn"]


def found(spark, sf_dir, spec):
    jobs, companies = role(spark, sf_dir, "job"), role(spark, sf_dir, "company")
    if spec.investor:
        return op.matching_jobs(
            jobs, companies, spec, role(spark, sf_dir, "bridge"), role(spark, sf_dir, "investor")
        )
    return op.matching_jobs(jobs, companies, spec)


RANKED = """
  SELECT j.*, c.name, c.slug, c.sector, c.industry, c.hiring_score,
    row_number() OVER (PARTITION BY j.company_id ORDER BY j.first_seen_at DESC, {tie} j.job_id) AS rn
  FROM job_role j JOIN company_role c ON c.company_id = j.company_id WHERE {where}"""
SIGNAL = "rn, hiring_score DESC, lower(name), job_id"


def page_sql(where, tie="", limit=50, offset=0):
    return with_roles("job", "company", then=f"""
      SELECT * FROM (SELECT row_number() OVER (ORDER BY {SIGNAL}) AS position, job_id, company_id, title,
        hiring_score, rn FROM ({RANKED.format(where=where, tie=tie)}))
      WHERE position > {offset} AND position <= {offset + limit}""")


OPEN = "j.status = 'verified_open'"
SIGNAL_SPEC = op.SearchSpec(limit=100)


@query("search_signal_page", page_sql(OPEN, limit=100))
def search_signal_page(spark, sf_dir):
    return op.search_page(found(spark, sf_dir, SIGNAL_SPEC), SIGNAL_SPEC).select(*PAGE_COLUMNS)


@query("search_round_robin_by_title", page_sql(OPEN, tie="j.title,", limit=100, offset=150))
def search_round_robin_by_title(spark, sf_dir):
    spec = op.SearchSpec(limit=100, offset=150)
    return op.search_page(found(spark, sf_dir, spec), spec, by_title=True).select(*PAGE_COLUMNS)


@query("search_signal_ranks", with_roles("job", "company", then=f"""
  SELECT job_id, company_id, rn FROM ({RANKED.format(where="1 = 1", tie="")})"""))
def search_signal_ranks(spark, sf_dir):
    ranked = op.signal_ranked(found(spark, sf_dir, op.SearchSpec(status="all")))
    return ranked.select("job_id", "company_id", "rn")


def totals_sql(where):
    return with_roles("job", "company", "bridge", "investor", then=f"""
      SELECT count(*) AS total, count(DISTINCT j.company_id) AS companies
      FROM job_role j JOIN company_role c ON c.company_id = j.company_id WHERE {where}""")


LIKE = " OR ".join(
    f"lower({c}) LIKE '%{{q}}%'" for c in
    ("j.title", "c.name", "j.role_family", "j.location", "j.employment_type", "c.sector", "c.industry")
)

FILTERS = {
    "search_text": (op.SearchSpec(q="EngIneer"), f"{OPEN} AND ({LIKE.format(q='engineer')})"),
    "search_text_wildcard": (op.SearchSpec(q="s_a_w"), f"{OPEN} AND ({LIKE.format(q='s_a_w')})"),
    "search_company_name": (
        op.SearchSpec(company="CUSTOMER#000000007", status="all"),
        "lower(c.name) = 'customer#000000007' OR lower(c.slug) = 'customer#000000007'"),
    "search_company_slug": (op.SearchSpec(company="Cust-11"), f"{OPEN} AND lower(c.slug) = 'cust-11'"),
    "search_location": (op.SearchSpec(location="germany"), f"{OPEN} AND lower(j.location) LIKE '%germany%'"),
    "search_employment_type": (
        op.SearchSpec(employment_type="full-time"),
        f"{OPEN} AND lower(translate(j.employment_type, '- _', '')) = 'fulltime'"),
    "search_provider": (
        op.SearchSpec(provider="Structured"),
        f"{OPEN} AND coalesce(j.provider, j.source) = 'structured'"),
    "search_investor": (
        op.SearchSpec(investor="supplier#000000003"),
        f"{OPEN} AND EXISTS (SELECT 1 FROM bridge_role b JOIN investor_role i ON i.investor_id = b.investor_id "
        "WHERE b.company_id = j.company_id AND lower(i.name) = 'supplier#000000003')"),
    "search_new_since": (
        op.SearchSpec(new_since="2000-06-01T00:00:00", status="verified_closed"),
        "j.status = 'verified_closed' AND j.first_seen_at >= TIMESTAMP '2000-06-01'"),
    "search_conjunction": (
        op.SearchSpec(sector="furniture", role_family="2-high", remote_status="remote", status="all"),
        "lower(c.sector) = 'furniture' AND lower(j.role_family) = '2-high' AND lower(j.remote_status) = 'remote'"),
}


def _register(name, spec, where):
    @query(name, totals_sql(where))
    def run(spark, sf_dir):
        return op.search_totals(found(spark, sf_dir, spec))


for _name, (_spec, _where) in FILTERS.items():
    _register(_name, _spec, _where)

ORDER_SQL = {
    "title": "lower(title), job_id",
    "title_desc": "lower(title) DESC, job_id",
    "company": "lower(name), lower(title), job_id",
    "company_desc": "lower(name) DESC, lower(title), job_id",
    "sector": "lower(sector), lower(title), job_id",
    "dept": "lower(role_family), lower(title), job_id",
    "loc": "lower(location), lower(title), job_id",
    "comp_low": "CASE WHEN compensation LIKE '$%' THEN compensation ELSE '~~~~' END, job_id",
    "comp_high": "CASE WHEN compensation LIKE '$%' THEN compensation ELSE '' END DESC, job_id",
    "recent": "job_role.last_verified_at DESC, job_id",
    "oldest": "job_role.last_verified_at, job_id",
}


@query("search_sort_orders", with_roles("job", "company", then="\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{name}' AS sort, row_number() OVER (ORDER BY {order}) AS position, job_id "
    f"FROM job_role JOIN company_role USING (company_id) WHERE status = 'verified_open') WHERE position <= 25"
    for name, order in ORDER_SQL.items())))
def search_sort_orders(spark, sf_dir):
    everything = found(spark, sf_dir, op.SearchSpec())
    pages = [
        op.search_page(everything, op.SearchSpec(sort=name, limit=25))
        .select(F.lit(name).alias("sort"), "position", "job_id")
        for name in ORDER_SQL
    ]
    return reduce(lambda a, b: a.unionByName(b), pages)


@query("job_descriptions", with_roles("job", then="""
  SELECT job_id, nullif(trim(description), '') AS description,
    nullif(trim(description), '') IS NOT NULL AS description_available,
    nullif(trim(description), '') IS NULL OR length(summary) < length(trim(description)) AS summary_truncated
  FROM job_role"""))
def job_descriptions(spark, sf_dir):
    return op.describe(role(spark, sf_dir, "job")).select(
        "job_id", "description", "description_available", "summary_truncated"
    )


SECTOR_SQL = """CASE industry WHEN 'AI / Precision medicine' THEN 'Healthcare'
  WHEN 'Payments and banking' THEN 'Financial Technology' WHEN 'Carbon removal' THEN 'Climate & Energy'
  WHEN 'Developer tools' THEN 'Developer Tools' WHEN 'B2B SaaS_workflow' THEN 'Enterprise Software'
  ELSE 'Other' END"""


@query("facet_lists", with_roles("job", "company", then="\nUNION\n".join(
    f"SELECT '{facet}' AS facet, {value} AS value FROM job_role JOIN company_role USING (company_id) WHERE {value} <> ''"
    for facet, value in {
        "departments": "role_family", "locations": "location", "employment_types": "employment_type",
        "providers": "coalesce(provider, source)", "companies": "name", "sectors": SECTOR_SQL,
    }.items())))
def facet_lists(spark, sf_dir):
    every = found(spark, sf_dir, op.SearchSpec(status="all"))
    return op.facet_values(every, {
        "departments": F.col("role_family"), "locations": F.col("location"),
        "employment_types": F.col("employment_type"), "providers": F.coalesce("provider", "source"),
        "companies": F.col("name"), "sectors": sector_of(F.col("industry")),
    })


@query("industry_labels_by_sector", with_roles("company", then="""
  SELECT sector, string_agg(DISTINCT industry, ' | ' ORDER BY industry) AS industries
  FROM company_role GROUP BY sector"""))
def industry_labels_by_sector(spark, sf_dir):
    pairs = role(spark, sf_dir, "company").select("sector", "industry").distinct()
    return pairs.groupBy("sector").agg(
        F.array_join(F.sort_array(F.collect_list("industry")), " | ").alias("industries")
    )


LISTS_SQL = """
  SELECT c.*, (SELECT string_agg(DISTINCT i.name, '|' ORDER BY i.name) FROM bridge_role b
      JOIN investor_role i ON i.investor_id = b.investor_id WHERE b.company_id = c.company_id) AS investor_names,
    (SELECT string_agg(DISTINCT s.provider, '|' ORDER BY s.provider) FROM source_role s
      WHERE s.company_id = c.company_id AND s.enabled) AS provider_names,
    (SELECT min(s.first_discovered_at) FROM source_role s WHERE s.company_id = c.company_id) AS first_at
  FROM company_role c"""


def listed(spark, sf_dir):
    return op.companies_with_lists(*[role(spark, sf_dir, n) for n in ("company", "bridge", "investor", "source")])


@query("company_lists", with_roles("company", "bridge", "investor", "source", then=f"""
  SELECT company_id, coalesce(investor_names, '') AS investors, coalesce(provider_names, '') AS providers,
    strftime(first_at, '%Y-%m-%d') AS first_discovered FROM ({LISTS_SQL})"""))
def company_lists(spark, sf_dir):
    return listed(spark, sf_dir).select(
        "company_id", F.array_join("investors", "|").alias("investors"),
        F.array_join("providers", "|").alias("providers"),
        F.date_format("first_discovered_at", "yyyy-MM-dd").alias("first_discovered"),
    )


@query("company_view_filtered", with_roles("company", "bridge", "investor", "source", then=f"""
  SELECT company_id, hiring_score, evidence_confidence FROM ({LISTS_SQL})
  WHERE hiring_score >= 20 AND evidence_confidence >= 10
    AND ('|' || investor_names || '|') LIKE '%|Supplier#000000005|%'
    AND (lower(name) LIKE '%customer%' OR lower(sector) LIKE '%customer%')"""))
def company_view_filtered(spark, sf_dir):
    return op.company_view(
        listed(spark, sf_dir), min_score=20, min_confidence=10, investor=" supplier#000000005", q="Customer"
    ).select("company_id", "hiring_score", "evidence_confidence")


@query("company_view_by_provider", with_roles("company", "bridge", "investor", "source", then=f"""
  SELECT company_id FROM ({LISTS_SQL})
  WHERE lower(sector) = 'machinery' AND ('|' || provider_names || '|') LIKE '%|lever|%'"""))
def company_view_by_provider(spark, sf_dir):
    return op.company_view(listed(spark, sf_dir), sector="Machinery", provider="LEVER").select("company_id")
