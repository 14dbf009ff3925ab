"""Crawled pages: links, metadata, funding wording and robots rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import SUFFIX_LINES, dealt, domain_rules, role, table, with_roles
from ..functions import text as t
from ..functions import urls as u
from ..operators import discovery, funding
from ..sources import pages as op
from .catalog import query

CLEAN = """trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'), '^ | $', '', 'g'))"""
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
HREF = "unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"''#]+)[\"'']', 1))"
ENCODED = """array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21\\x23-\\x3b\\x3d\\x3f-\\x5f\\x61-\\x7a\\x7c\\x7e]')
  THEN url_encode(c) ELSE c END), '')"""


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("page_links", f"""
  SELECT DISTINCT page_id, {ORIGIN} || {ENCODED.format('href')} AS link FROM (SELECT page_id, url, {HREF} AS href FROM pages)
  WHERE url LIKE 'https://%' AND href LIKE '/%'""")
def page_links(spark, sf_dir):
    return op.page_links(pages(spark, sf_dir)).select("page_id", "link")


@query("page_titles", f"""
  SELECT page_id, {CLEAN.format("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")} AS title FROM pages""")
def page_titles(spark, sf_dir):
    return op.page_metadata(pages(spark, sf_dir)).select("page_id", "title")


@query("page_text", f"SELECT page_id, length({CLEAN.format('html')}) AS characters, md5({CLEAN.format('html')}) AS digest FROM pages")
def page_text(spark, sf_dir):
    
    text = t.strip_tags(F.col("html"))
    return pages(spark, sf_dir).select("page_id", text.alias("text")).select(
        "page_id", F.length("text").cast("long").alias("characters"), F.md5("text").alias("digest")
    )


@query("page_hosts", """
  SELECT page_id, regexp_replace(host, '^www\\.', '') AS host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)""")
def page_hosts(spark, sf_dir):
    found = u.registrable_domains(pages(spark, sf_dir), "url", domain_rules(spark, sf_dir), "domain")
    return found.select("page_id", u.bare_host(F.col("url")).alias("host"), "domain")


@query("page_hosts_by_suffix_table", """
  SELECT page_id, CASE WHEN host LIKE '%.example.com' THEN regexp_extract(host, '([^.]+\\.example\\.com)$', 1)
      WHEN host = 'example.com' THEN '' ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS domain
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)""")
def page_hosts_by_suffix_table(spark, sf_dir):
    suffixes = table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("example.com"), F.lit("co.uk"))).alias("suffix"))
    hosts = pages(spark, sf_dir).select("page_id", u.hostname(F.col("url")).alias("host"))
    return u.registrable_domains(hosts, "host", suffixes, "domain").select("page_id", "domain")


NATION_HOST = """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'shop.cust' || CAST(c_custkey AS STRING) || '.co.n' WHEN 1 THEN 'cust' || CAST(c_custkey AS STRING) || '.n'
    WHEN 2 THEN 'www.n' WHEN 3 THEN 'a.b' || CAST(c_custkey AS STRING) || '.www.n' ELSE 'n' END || CAST(c_nationkey AS STRING) AS host FROM {customer}"""


@query("customer_domains_by_rules", f"""
  WITH h AS (SELECT c_custkey, host, string_split(host, '.') AS labels FROM ({NATION_HOST.format(customer='customer')})),
  r AS (SELECT CASE WHEN value LIKE '!%' THEN 'exception' WHEN value LIKE '*%' THEN 'wildcard' ELSE 'plain' END AS kind, regexp_replace(value, '^(!|\\*\\.)', '') AS suffix
    FROM ({SUFFIX_LINES.format(nation='nation')})),
  t AS (SELECT c_custkey, array_to_string(labels[i:], '.') AS ending, array_to_string(labels[i + 1:], '.') AS rest, len(labels) - i + 1 AS n
    FROM (SELECT c_custkey, labels, unnest(range(1, len(labels) + 1)) AS i FROM h)),
  m AS (SELECT c_custkey, true AS exception, n - 1 AS n FROM t JOIN r ON kind = 'exception' AND suffix = ending
    UNION ALL SELECT c_custkey, false, n FROM t JOIN r ON kind = 'plain' AND suffix = ending
    UNION ALL SELECT c_custkey, false, n FROM t JOIN r ON kind = 'wildcard' AND suffix = rest),
  c AS (SELECT c_custkey, coalesce(max(n) FILTER (exception), max(n)) AS n FROM m GROUP BY 1)
  SELECT h.c_custkey, CASE WHEN len(labels) > coalesce(n, 1) THEN array_to_string(labels[len(labels) - coalesce(n, 1):], '.') ELSE '' END AS domain
  FROM h LEFT JOIN c USING (c_custkey)""")
def customer_domains_by_rules(spark, sf_dir):
    pages(spark, sf_dir)
    hosts = spark.sql(NATION_HOST.format(customer=f"parquet.`{sf_dir}/customer.parquet`"))
    return u.registrable_domains(hosts, "host", domain_rules(spark, sf_dir), "domain").select("c_custkey", "domain")


@query("page_canonical_urls", """
  SELECT page_id, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM (
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/?([?#].*)?$') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/'
        ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/$', '') END AS base,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|source|trk|referrer|gh_src|lever-source)='))), '&') AS query FROM pages)""")
def page_canonical_urls(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", u.canonical_url(F.col("url")).alias("canonical"))


@query("page_domain_titles", """
  SELECT page_id, array_to_string(list_transform(string_split_regex(label, '[-_]'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM (
    SELECT page_id, string_split(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', ''), '.')[1] AS label FROM pages)""")
def page_domain_titles(spark, sf_dir):
    host = u.bare_host(F.col("url"))
    return pages(spark, sf_dir).select("page_id", t.domain_title(host).alias("title"))


BOARD_LINK = """SELECT l_orderkey AS site, 'https://site' || CAST(l_orderkey AS STRING) || '.example.org/p' || CAST(l_linenumber AS STRING) AS url,
    CASE l_partkey % 6 WHEN 0 THEN 'https://jobs.ashbyhq.com/board' || CAST(l_suppkey % 7 AS STRING) || '/x'
      WHEN 1 THEN 'https://boards.greenhouse.io/embed/job_board?for=gh' || CAST(l_suppkey % 7 AS STRING)
      WHEN 2 THEN 'https://jobs.lever.co/Lv' || CAST(l_suppkey % 7 AS STRING)
      WHEN 3 THEN 'https://r' || CAST(l_suppkey % 7 AS STRING) || '.recruitee.com/o/role'
      WHEN 4 THEN 'https://careers.other' || CAST(l_suppkey % 7 AS STRING) || '.com/jobs/apply?x=1' ELSE 'https://example.org/about' END AS link,
    l_partkey % 6 AS kind, l_suppkey % 7 AS board_no FROM {lineitem}"""


def board_links(spark, sf_dir):
    return spark.sql(BOARD_LINK, lineitem=dealt(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("board_candidates", f"""
  SELECT site, count(*) AS boards, CAST(sum(pages) AS BIGINT) AS evidence_pages, CASE WHEN count(*) = 1 THEN 'single' ELSE 'ambiguous' END AS detection,
    CASE WHEN count(*) = 1 THEN min(provider) END AS provider, CASE WHEN count(*) = 1 THEN min(board) END AS board FROM (
    SELECT site, CASE kind WHEN 0 THEN 'ashby' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' ELSE 'recruitee' END AS provider,
      CASE kind WHEN 0 THEN 'board' WHEN 1 THEN 'gh' WHEN 2 THEN 'lv' ELSE 'r' END || board_no AS board, count(DISTINCT url) AS pages
    FROM ({BOARD_LINK.format(lineitem='lineitem')}) WHERE kind < 4 GROUP BY 1, 2, 3) GROUP BY site""")
def board_candidates(spark, sf_dir):
    return op.board_candidates(board_links(spark, sf_dir), "site").drop("careers_url")


@query("unsupported_host_leads", f"""
  SELECT 'careers.other' || board_no || '.com' AS host, count(DISTINCT 'example.org') AS domains, count(DISTINCT url) AS pages,
    count(*) AS occurrences, 'apply_path,jobs_path' AS signals FROM ({BOARD_LINK.format(lineitem='lineitem')}) WHERE kind = 4 GROUP BY board_no""")
def unsupported_host_leads(spark, sf_dir):
    links = op.external_links(board_links(spark, sf_dir).withColumnRenamed("site", "page_id"), domain_rules(spark, sf_dir))
    return discovery.host_leads(links).select(
        "host", "domains", "pages", "occurrences", F.array_join("signals", ",").alias("signals")
    )


# A portfolio page per part: a heading, a labelled link to the company or to a social host, and links of its own site.
PORTFOLIO = """SELECT p_partkey AS page_id, 'https://fund' || CAST(p_partkey % 9 AS STRING) || '.example.org/portfolio/' || CAST(p_partkey AS STRING) AS url,
    CASE WHEN p_partkey % 4 = 0 THEN '<h1>Our Portfolio</h1>' WHEN p_partkey % 4 = 1 THEN '' ELSE '<h1 class="t">Firm <b>' || CAST(p_partkey AS STRING) || '</b></h1>' END
    || '<a href="https://' || CASE p_partkey % 5 WHEN 0 THEN 'www.linkedin.com/in/x' WHEN 1 THEN 'jobs.fund' || CAST(p_partkey % 9 AS STRING) || '.example.org/'
      ELSE 'www.big-co' || CAST(p_size AS STRING) || '.com/' END || '">' || CASE WHEN p_partkey % 7 = 0 THEN 'Read more' ELSE 'Visit <i>website</i>' END || '</a>'
    || '<a href="/companies/' || CAST(p_size AS STRING) || '">Profile</a><a href="/about">About</a>' AS html FROM {part}"""


def portfolio_pages(spark, sf_dir):
    return spark.sql(PORTFOLIO, part=dealt(spark, sf_dir, "part", "p_partkey", "p_size"))


@query("portfolio_candidates", """
  SELECT p_partkey AS page_id, 'https://www.big-co' || p_size || '.com/' AS website_url, 'big-co' || p_size || '.com' AS domain,
    CASE WHEN p_partkey % 4 >= 2 THEN 'Firm ' || p_partkey ELSE 'Big Co' || p_size END AS name FROM part WHERE p_partkey % 5 >= 2 AND p_partkey % 7 <> 0""")
def portfolio_candidates(spark, sf_dir):
    return op.portfolio_candidates(portfolio_pages(spark, sf_dir)).select("page_id", "website_url", "domain", "name")


@query("portfolio_profile_links", """
  SELECT p_partkey AS page_id, 'https://fund' || p_partkey % 9 || '.example.org/companies/' || p_size AS link FROM part""")
def portfolio_profile_links(spark, sf_dir):
    return op.detail_links(portfolio_pages(spark, sf_dir)).select("page_id", "link")


@query("excluded_domains", """
  SELECT p_partkey, p_partkey % 5 < 2 OR p_partkey % 6 = 0 AS excluded FROM part""")
def excluded_domains(spark, sf_dir):
    key = F.col("p_partkey")
    domain = F.when(key % 6 == 0, "").when(key % 5 == 0, "linkedin.com").when(key % 5 == 1, "jobs.fund.org").otherwise("big.com")
    return table(spark, sf_dir, "part").select("p_partkey", op.excluded_domain(domain, F.lit("fund.org")).alias("excluded"))


@query("career_fingerprints", """
  SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 THEN '' ELSE 'lever:board ' || s_suppkey || ':careers' || s_nationkey || '.example.com' END AS fingerprint FROM supplier""")
def career_fingerprints(spark, sf_dir):
    key = F.col("s_suppkey")
    board = F.when(key % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Board "), key))
    site = F.concat(F.when(key % 5 == 0, "http").otherwise("https"), F.lit("://www.Careers"), F.col("s_nationkey"), F.lit(".example.com/jobs"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", u.career_fingerprint(F.lit(" Lever "), board, site).alias("fingerprint"))


HEADLINE = """SELECT o_orderkey AS page_id, 'https://news' || CAST(o_custkey % 3 AS STRING) || '.example.org/' || CAST(o_orderkey AS STRING) AS url,
    'reputable' AS source_kind, 'Wire' AS publisher,
    CASE o_orderkey % 5 WHEN 4 THEN 'Rumour: ' ELSE '' END || 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0')
      || CASE o_orderkey % 5 WHEN 0 THEN ' raises $' || CAST(o_orderkey % 90 + 1 AS STRING) || 'M Series B' WHEN 1 THEN ' secured pre-seed funding'
        WHEN 2 THEN ' announces new office' WHEN 3 THEN ' closes seed round' ELSE ' in talks, raises series c' END AS title,
    '' AS description, CAST(o_orderdate AS TIMESTAMP) AS published_at FROM {orders}"""
RECENT = "published_at BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2001-06-16'"


def headlines(spark, sf_dir):
    pages(spark, sf_dir)
    return spark.sql(HEADLINE.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))


@query("funding_announcements", with_roles("company", then=f"""
  SELECT c.company_id, page_id, c.name || ' announced ' || label AS title, label AS funding_label,
    CASE page_id % 5 WHEN 0 THEN 'Series B' WHEN 1 THEN 'Pre-seed' ELSE 'Seed' END AS stage FROM (
    SELECT *, CASE page_id % 5 WHEN 0 THEN '$' || (page_id % 90 + 1) || 'M Series B' WHEN 1 THEN 'Pre-Seed Funding' ELSE 'Seed Round' END AS label
    FROM ({HEADLINE.format(orders='orders')}) WHERE {RECENT} AND page_id % 5 IN (0, 1, 3)) h
  JOIN company_role c ON h.title LIKE c.name || ' %'"""))
def funding_announcements(spark, sf_dir):
    found = funding.announcements(headlines(spark, sf_dir), role(spark, sf_dir, "company"), "2001-06-15 00:00:00")
    return found.select("company_id", "page_id", "title", "funding_label", "stage")


@query("funding_headline_names", f"""
  SELECT page_id, CASE WHEN page_id % 5 = 4 THEN regexp_extract(title, '^(.*,) raises', 1) ELSE regexp_extract(title, '^(Customer#[0-9]+)', 1) END AS company
  FROM ({HEADLINE.format(orders='orders')})""")
def funding_headline_names(spark, sf_dir):
    return headlines(spark, sf_dir).select(
        "page_id", funding.headline_company(F.col("title")).alias("company")
    )


@query("funding_profiles_applied", with_roles("company", then=f"""
  SELECT c.company_id, CASE WHEN newer THEN n.label END AS label, strftime(CASE WHEN newer THEN n.day ELSE c.latest_funding_date END, '%Y-%m-%d') AS funded_on
  FROM (SELECT c.*, n.day IS NOT NULL AND (latest_funding_date IS NULL OR latest_funding_date < n.day) AS newer FROM company_role c LEFT JOIN (
      SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS day FROM orders GROUP BY 1) n ON n.k = c.company_id) c
  LEFT JOIN (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS day, 'order ' || o_orderkey AS label,
      row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, 'funding_' || o_orderkey DESC) AS nth FROM orders) n
    ON n.k = c.company_id AND n.nth = 1"""))
def funding_profiles_applied(spark, sf_dir):
    discoveries = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("funding_"), "o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.lit("t").alias("title"),
        F.lit("d").alias("description"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
        F.lit("https://x.example.org/").alias("source_url"), F.concat(F.lit("order "), "o_orderkey").alias("funding_label"),
        F.lit(None).cast("string").alias("stage"),
    )
    changes = role(spark, sf_dir, "change")
    after = funding.apply_funding(role(spark, sf_dir, "company"), changes, discoveries)["companies"]
    return after.select(
        "company_id", F.col("latest_funding_label").alias("label"), F.col("latest_funding_date").cast("string").alias("funded_on")
    )


ROBOTS = """SELECT 'site' || CAST(s_suppkey AS STRING) || '.example.org' AS host,
    'User-agent: *' || chr(10) || 'Disallow: /private' || chr(10) || 'Allow: /private/open' || chr(10)
    || CASE WHEN s_suppkey % 3 = 0 THEN 'User-agent: careerbot' || chr(10) || 'Disallow: /*.pdf$' ELSE '' END AS robots FROM {supplier}"""
ROBOT_URL = """SELECT DISTINCT 'https://site' || CAST(l_suppkey AS STRING) || '.example.org' || CASE l_partkey % 4 WHEN 0 THEN '/private/x'
      WHEN 1 THEN '/private/open/y' WHEN 2 THEN '/docs/a.pdf' ELSE '/jobs' END AS url, l_suppkey, l_partkey % 4 AS kind FROM {lineitem}"""


@query("robots_permissions", f"""
  SELECT url, CASE WHEN l_suppkey % 3 = 0 THEN kind <> 2 ELSE kind <> 0 END AS allowed FROM ({ROBOT_URL.format(lineitem='lineitem')})""")
def robots_permissions(spark, sf_dir):
    pages(spark, sf_dir)
    robots = spark.sql(ROBOTS.format(supplier=f"parquet.`{sf_dir}/supplier.parquet`"))
    urls = spark.sql(ROBOT_URL.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`")).select("url")
    return op.allowed_urls(urls, op.robots_rules(robots), "CareerBot/1.0")
