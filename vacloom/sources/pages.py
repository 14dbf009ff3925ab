"""Web pages as tables: links, metadata, structured postings and portfolio entries.

A pages table has page_id, url and html. Fetching happens elsewhere; whole pages are read here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import application_pool, role_family, us_eligible
from ..functions.text import decode_entities, domain_title, plain_html, squeeze, strip_tags, summary
from ..functions.urls import (
    bare_host, canonical_url, detect_board, external_career_signals, hostname, is_https, normal_href,
    path_of, resolve_url, same_site, with_domains,
)
from ..session import durable
from .payloads import conflicting_sources

# Patterns that read links, calls to apply and requisition numbers from pages.

LINK = "(?i)href\\s*=\\s*[\"']([^\"'#]+)[\"']"
ANCHOR = "(?is)<a\\b([^>]*?)href\\s*=\\s*[\"']([^\"'#]+)[\"']([^>]*)>(.*?)</a>"


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct absolute https links of every page."""
    found = pages.select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("href")
    )
    absolute = resolve_url(F.col("href"), F.col("url"))
    return found.select("page_id", "url", absolute.alias("link")).filter(F.col("link").startswith("https://")).distinct()


def sitemap_links(sitemaps: DataFrame) -> DataFrame:
    """Distinct https addresses of sitemap documents (column xml)."""
    found = sitemaps.select("page_id", F.explode(F.regexp_extract_all("xml", F.lit("(?is)<loc\\b[^>]*>(.*?)</loc>"), F.lit(1))).alias("loc"))
    link = F.trim(F.replace("loc", F.lit("&amp;"), F.lit("&")))
    return found.select("page_id", link.alias("link")).filter(is_https(F.col("link"))).select(
        "page_id", normal_href(F.col("link")).alias("link")
    ).distinct()


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap addresses stated in robots files (column robots)."""
    return robots.select("page_id", F.explode(F.regexp_extract_all(
        "robots", F.lit("(?im)^\\s*sitemap\\s*:\\s*(https://\\S+)"), F.lit(1)
    )).alias("link"))


def meta_map(html: Column) -> Column:
    """First non-empty content per lower-case meta key, in page order."""
    tags = F.regexp_extract_all(html, F.lit("(?i)<meta\\b([^>]+)>"), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(
        F.lower(F.regexp_extract(t, "(?i)(?:property|name|itemprop)\\s*=\\s*[\"']([^\"']+)[\"']", 1)).alias("key"),
        F.regexp_extract(t, "(?i)content\\s*=\\s*[\"']([^\"']*)[\"']", 1).alias("value"),
    ))
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def _first_meta(metas: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k.lower()) for k in keys])
    return decode_entities(F.try_element_at(
        F.filter(metas, lambda p: F.array_contains(wanted, p["key"])), F.lit(1)
    )["value"])


def parsed_time(text: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(text, F.lit("EEE, d MMM yyyy HH:mm:ss z")),
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, description and publication time by preference order of their sources."""
    metas = pages.withColumn("_m", meta_map(F.col("html")))
    title = F.regexp_extract("html", "(?is)<title\\b[^>]*>(.*?)</title>", 1)
    stated = F.regexp_extract("html", "(?i)[\"']datePublished[\"']\\s*:\\s*[\"']([^\"']+)[\"']", 1)
    published = F.coalesce(
        _first_meta(F.col("_m"), ["article:published_time", "datePublished", "date", "publish-date", "parsely-pub-date"]),
        decode_entities(F.nullif(stated, F.lit(""))),
    )
    rest = [c for c in pages.columns if c not in {"title", "description"}]
    return metas.select(
        *rest,
        F.coalesce(_first_meta(F.col("_m"), ["og:title", "twitter:title", "headline"]), strip_tags(title)).alias("title"),
        F.coalesce(_first_meta(F.col("_m"), ["og:description", "twitter:description", "description"]), F.lit("")).alias("description"),
        parsed_time(published).alias("published_at"),
    )


def anchors(pages: DataFrame) -> DataFrame:
    """Every link with its absolute address, readable label and attributes, in page order."""
    def group(index: int) -> Column:
        return F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(index))

    zipped = F.arrays_zip(group(1).alias("before"), group(2).alias("href"), group(3).alias("after"), group(4).alias("inner"))
    rows = pages.select("page_id", "url", F.posexplode(zipped).alias("position", "a"))
    return rows.select(
        "page_id", "url", "position", resolve_url(F.col("a.href"), F.col("url")).alias("link"),
        strip_tags(F.col("a.inner")).alias("label"),
        F.concat_ws(" ", "a.before", "a.after").alias("attributes"),
    )


# Labels of a link to a company's own site, and headings that name the investor.
WEBSITE_LABEL = "(?i)(?:visit|view|company|official)\\s+(?:the\\s+)?(?:website|site)|^website$"
INVESTOR_HEADING = "(?i)(?:portfolio|our companies|general catalyst|sequoia capital)"
# Hosts that are never the company itself.
SOCIAL_HOSTS = "(?:linkedin|twitter|x|facebook|instagram|youtube|cloudfront|google|getro)\\.com$"


def excluded_domain(domain: Column, source_domain: Column) -> Column:
    own = (domain == source_domain) | domain.endswith(F.concat(F.lit("."), source_domain))
    return (domain == "") | own | domain.rlike(SOCIAL_HOSTS)


def portfolio_candidates(pages: DataFrame) -> DataFrame:
    """Companies that portfolio pages link to, named by the page heading or their domain."""
    heading = squeeze(F.regexp_replace(F.regexp_extract("html", "(?is)<h1\\b[^>]*>(.*?)</h1>", 1), "<[^>]*>", " "))
    named = pages.select("page_id", heading.alias("heading"))
    links = anchors(pages).filter(F.col("label").rlike(WEBSITE_LABEL) & F.col("link").startswith("https://"))
    domain = bare_host(F.col("link"))
    usable = F.length("heading").between(2, 120) & ~F.col("heading").rlike(INVESTOR_HEADING)
    return (
        links.join(named, "page_id").withColumn("domain", domain)
        .filter(~excluded_domain(F.col("domain"), bare_host(F.col("url"))))
        .select(
            "page_id", F.col("url").alias("evidence_url"), F.col("link").alias("website_url"), "domain",
            F.when(usable, F.col("heading")).otherwise(domain_title(F.col("domain"))).alias("name"),
        ).distinct()
    )


def detail_links(pages: DataFrame) -> DataFrame:
    """Links of a portfolio page to profiles on the same site."""
    links = page_links(pages)
    same = bare_host(F.col("link")) == bare_host(F.col("url"))
    return links.filter(same & (F.col("link") != F.col("url")) & path_of(F.col("link")).rlike("(?i)/(?:companies|company|portfolio)/"))


def board_candidates(links: DataFrame, site: str) -> DataFrame:
    """Boards each site points to: one is a detection, several are ambiguous."""
    found = links.select(F.col(site), "url", detect_board(F.col("link")).alias("b")).filter("b IS NOT NULL")
    distinct = found.groupBy(site, "b.provider", F.lower("b.board_id").alias("board")).agg(
        F.countDistinct("url").alias("evidence_pages"), F.min("b.careers_url").alias("careers_url")
    )
    return distinct.groupBy(site).agg(
        F.count(F.lit(1)).alias("boards"), F.sum("evidence_pages").alias("evidence_pages"),
        F.min(F.struct("provider", "board", "careers_url")).alias("first"),
    ).select(
        site, "boards", "evidence_pages",
        F.when(F.col("boards") == 1, "single").otherwise("ambiguous").alias("detection"),
        *[F.when(F.col("boards") == 1, F.col(f"first.{c}")).alias(c) for c in ("provider", "board", "careers_url")],
    )


def external_links(links: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Career-like links to other sites that are not on a known board."""
    # Domains are looked up for the career-like links alone, which are picked once for all look-ups.
    careers = durable(links.withColumn("signals", external_career_signals(F.col("link"))).filter(
        (F.size("signals") > 0) & detect_board(F.col("link")).isNull()))
    rows = with_domains(careers, {"url": "domain", "link": "_other"}, suffixes)
    return rows.filter(F.col("_other") != F.col("domain")).select(
        "page_id", hostname(F.col("link")).alias("host"), "domain",
        F.col("url").alias("page"), F.lit(1).cast("long").alias("occurrences"), "signals",
        F.regexp_replace("link", "[?#].*$", "").alias("url"),
    )


JSONLD = "(?is)<script\\b[^>]*type\\s*=\\s*[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"


def posting_nodes(values: DataFrame) -> DataFrame:
    """(page_id, node): every JobPosting object below the variants of ``values`` (page_id, v).

    Lists and graphs are opened level by level, all pages at once, until a level has none left; how deep
    they nest is not bounded.
    """
    found, level = None, values.select("page_id", "v")
    while True:
        items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
        is_list = F.schema_of_variant("v").startswith("ARRAY")
        graph = F.try_variant_get("v", '$["@graph"]', "variant")
        kinds = F.coalesce(F.try_variant_get("v", '$["@type"]', "array<string>"), F.array(F.try_variant_get("v", '$["@type"]', "string")))
        rows = durable(level.filter("v IS NOT NULL").withColumns({"is_list": is_list, "graph": graph}))
        posting = F.exists(kinds, lambda k: F.coalesce(F.lower(F.trim(k)) == "jobposting", F.lit(False)))
        nodes = rows.filter(~F.col("is_list") & posting).select("page_id", F.to_json("v").alias("node"))
        found = nodes if found is None else found.unionAll(nodes)
        level = rows.filter("is_list").select("page_id", F.explode(items).alias("v")).unionAll(
            rows.filter("NOT is_list AND graph IS NOT NULL").select("page_id", F.col("graph").alias("v")))
        if level.isEmpty():
            return found


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """One row per JobPosting node; malformed JSON-LD makes the page incomplete.

    Columns page_id, url, html, complete, node (JSON text, null where there is none).
    """
    scripts = F.transform(F.regexp_extract_all("html", F.lit(JSONLD), F.lit(1)), F.try_parse_json)
    read = pages.select("page_id", scripts.alias("scripts"))
    broken = read.filter(F.exists("scripts", lambda v: v.isNull())).select("page_id", F.lit(True).alias("_broken"))
    whole = read.join(broken, "page_id", "left_anti").select("page_id", F.explode("scripts").alias("v"))
    return pages.join(broken, "page_id", "left").join(posting_nodes(whole), "page_id", "left").withColumn(
        "complete", F.col("_broken").isNull()).drop("_broken")


def apply_link(html: Column, url: Column) -> Column:
    """First https link labelled as an application, else the first after an apply-now label."""
    def groups(index: int) -> Column:
        return F.regexp_extract_all(html, F.lit("(?is)<a\\b([^>]*?)href\\s*=\\s*[\"']([^\"']+)[\"']([^>]*)>(.*?)</a>"), F.lit(index))

    zipped = F.arrays_zip(groups(1).alias("a"), groups(2).alias("h"), groups(3).alias("b"), groups(4).alias("i"))
    calls = F.filter(zipped, lambda z: F.concat_ws(" ", plain_html(z["i"]), z["a"], z["b"]).rlike("(?i)\\bapply(?:\\s+now)?\\b"))
    links = F.filter(F.transform(calls, lambda z: resolve_url(z["h"], url)), lambda u: u.startswith("https://"))
    near = resolve_url(F.nullif(F.regexp_extract(
        html, "(?is)\\bApply\\s+Now\\b.{0,800}?<a\\b[^>]*href\\s*=\\s*[\"']([^\"']+)[\"']", 1), F.lit("")), url)
    return F.coalesce(F.try_element_at(links, F.lit(1)), F.when(near.startswith("https://"), near))


REQUISITION = "(?i)\\b(?:req(?:uisition)?|job)\\s*(?:id|#)\\s*[:#]?\\s*([a-z0-9][a-z0-9._-]*)\\b"


def _as_list(node: Column, path: str) -> Column:
    """A JSON value as a list of JSON texts, single values as a list of one."""
    raw = F.get_json_object(node, path)
    many = F.get_json_object(node, f"{path}[*]")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(
        raw.startswith("["), F.coalesce(F.from_json(F.when(many.startswith("["), many).otherwise(raw), "array<string>"), F.array(raw))
    ).otherwise(F.array(raw))


def structured_postings(pages: DataFrame, as_of: str) -> DataFrame:
    """Current, eligible postings from JSON-LD nodes of complete pages."""
    return postings_of_nodes(jsonld_postings(pages), as_of)


def postings_of_nodes(read: DataFrame, as_of: str) -> DataFrame:
    nodes = read.filter("complete AND node IS NOT NULL")

    def text(path: str) -> Column:
        return F.trim(F.coalesce(F.get_json_object("node", path), F.lit("")))

    places = F.concat(_as_list(F.col("node"), "$.jobLocation"), _as_list(F.col("node"), "$.applicantLocationRequirements"))
    fields = ["$.name", "$.address.addressLocality", "$.address.addressRegion", "$.address.addressCountry"]
    parts = F.flatten(F.transform(places, lambda p: F.filter(
        F.array(*[F.trim(F.coalesce(F.get_json_object(p, f), F.lit(""))) for f in fields]), lambda x: x != ""
    )))
    countries = F.filter(F.transform(places, lambda p: F.get_json_object(p, "$.address.addressCountry")), lambda x: F.coalesce(x, F.lit("")) != "")
    remote = text("$.jobLocationType").rlike("(?i)telecommute")
    low, high = F.get_json_object("node", "$.baseSalary.value.minValue"), F.get_json_object("node", "$.baseSalary.value.maxValue")
    currency = text("$.baseSalary.currency")
    single = F.coalesce(F.get_json_object("node", "$.baseSalary.value.value"), F.lit(""))
    pay = F.when(low.isNotNull() | high.isNotNull(), F.trim(F.concat(
        currency, F.lit(" "), F.coalesce(low, high), F.lit("–"), F.coalesce(high, low)
    ))).otherwise(plain_html(single))
    joined = F.array_join(F.array_distinct(parts), ", ")
    structured_id = F.coalesce(
        F.nullif(text("$.identifier.value"), F.lit("")), F.nullif(text("$.identifier.name"), F.lit("")),
        F.when(~text("$.identifier").startswith("{"), F.nullif(text("$.identifier"), F.lit(""))),
    )
    rows = nodes.select(
        "page_id", "url", "html", text("$.title").alias("title"), plain_html(text("$.description")).alias("description"),
        text("$.hiringOrganization.name").alias("_employer"),
        F.coalesce(F.nullif(text("$.hiringOrganization.sameAs"), F.lit("")), text("$.hiringOrganization.url")).alias("_employer_url"),
        resolve_url(F.coalesce(F.nullif(text("$.url"), F.lit("")), F.col("url")), F.col("url")).alias("canonical_url"),
        parsed_time(text("$.validThrough")).alias("_expires"), parsed_time(text("$.datePosted")).alias("published_at"),
        F.when(joined != "", joined).when(remote, "Remote").otherwise("").alias("location"), remote.alias("_remote"),
        F.try_element_at(countries, F.lit(1)).alias("_country"),
        F.coalesce(F.nullif(text("$.occupationalCategory.name"), F.lit("")), text("$.occupationalCategory")).alias("_department"),
        F.array_join(_as_list(F.col("node"), "$.employmentType"), ", ").alias("_type"), pay.alias("_pay"),
        structured_id.alias("_id"), apply_link(F.col("html"), F.col("url")).alias("apply_url"),
    )
    rows = durable(rows)  # the patterns run once, not again in each condition below
    page_host, employer_ok = F.col("url"), F.col("_employer_url") == ""
    kept = rows.filter(
        (F.col("title") != "") & (F.col("description") != "") & (F.col("_employer") != "") & F.col("apply_url").isNotNull()
        & F.col("canonical_url").startswith("https://") & same_site(F.col("canonical_url"), page_host)
        & (employer_ok | same_site(resolve_url(F.col("_employer_url"), page_host), page_host))
        & (F.col("_expires").isNull() | (F.col("_expires") > F.lit(as_of).cast("timestamp")))
        & us_eligible(F.col("location"), F.col("_remote"), F.col("_country"))
    )
    last_segment = F.element_at(F.split(F.regexp_replace(path_of(F.col("canonical_url")), "/+$", ""), "/"), -1)
    requisition = F.regexp_extract(plain_html(F.col("html")), REQUISITION, 1)
    return kept.select(
        "page_id", "url",
        F.coalesce("_id", F.nullif(requisition, F.lit("")), F.nullif(last_segment, F.lit("")), "canonical_url").alias("external_id"),
        "title", role_family(F.col("title"), F.col("_department")).alias("role_family"),
        F.when(F.col("location") != "", F.col("location")).otherwise("US eligibility stated in posting").alias("location"),
        F.when(F.col("_remote"), "Remote").otherwise("See posting").alias("remote_status"),
        F.when(F.col("_type") != "", F.col("_type")).otherwise("See posting").alias("employment_type"),
        F.when(F.col("_pay") != "", F.col("_pay")).otherwise("See posting").alias("compensation"),
        "canonical_url", "published_at", "description", summary(F.col("title"), F.col("description")).alias("summary"),
    )


def semantic_postings(pages: DataFrame, minimum_body: int = 250) -> DataFrame:
    """Postings read from headings and text where a page has no structured data."""
    head = F.regexp_extract("html", "(?is)^(.*?<h1\\b[^>]*>.*?</h1>)", 1)
    rest = F.when(head != "", F.substr(F.col("html"), F.length(head) + 1)).otherwise(F.col("html"))
    classed = F.regexp_extract(
        "html", "(?is)<[a-z][a-z0-9]*\\b[^>]*class\\s*=\\s*[\"'](?:[^\"']*\\s)?(?:job-post-location|job-location)(?:\\s[^\"']*)?[\"'][^>]*>([^<]*)", 1)
    rows = pages.select(
        "page_id", "url", plain_html(F.regexp_extract("html", "(?is)<h1\\b[^>]*>(.*?)</h1>", 1)).alias("title"),
        plain_html(rest).alias("description"), plain_html(classed).alias("_classed"),
        apply_link(F.col("html"), F.col("url")).alias("apply_url"),
    )
    rows = durable(rows)
    stated = F.trim(F.regexp_extract("description", "(?i)\\bLocation\\s*:\\s*([^|•]{2,100})", 1))
    rows = rows.withColumns({
        "location": F.coalesce(F.nullif("_classed", F.lit("")), stated),
        "external_id": F.regexp_extract("description", REQUISITION, 1),
    }).withColumn("_remote", F.col("location").rlike("(?i)\\bremote\\b"))
    kept = rows.filter(
        (F.col("title") != "") & F.col("apply_url").isNotNull() & (F.col("external_id") != "")
        & (F.length("description") >= minimum_body) & us_eligible(F.col("location"), F.col("_remote"))
    )

    def stated_as(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract("description", pattern, 0), F.lit("")), F.lit("See posting"))

    return kept.select(
        "page_id", "url", "external_id", "title", role_family(F.col("title")).alias("role_family"), "location",
        F.when(F.col("_remote"), "Remote").otherwise("See posting").alias("remote_status"),
        stated_as("(?i)\\b(?:Full[- ]time|Part[- ]time|Contract|Temporary)\\b").alias("employment_type"),
        stated_as("(?i)\\$\\d[\\d,]*(?:\\.\\d+)?(?:\\s*[–-]\\s*\\$\\d[\\d,]*(?:\\.\\d+)?)?").alias("compensation"),
        F.col("url").alias("canonical_url"), F.lit(None).cast("timestamp").alias("published_at"), "description",
        summary(F.col("title"), F.col("description")).alias("summary"),
    )


def career_postings(pages: DataFrame, as_of: str) -> DataFrame:
    """Structured postings, or the semantic reading of pages that have none.

    A site's postings count once each; a site on which one id stands for different postings gives none.
    """
    read = durable(jsonld_postings(pages))
    structured = durable(postings_of_nodes(read, as_of))
    broken = read.filter("NOT complete").select("page_id")
    rest = pages.join(structured.select("page_id"), "page_id", "left_anti").join(broken, "page_id", "left_anti")
    rows = structured.unionByName(semantic_postings(rest)).withColumn("source_id", bare_host(F.col("url")))
    told = rows.drop("page_id", "url")
    kept = rows.join(conflicting_sources(told), "source_id", "left_anti")
    first = kept.groupBy("source_id", "external_id").agg(F.min("page_id").alias("page_id"))
    return kept.join(first, ["source_id", "external_id", "page_id"]).withColumn("canonical_key", canonical_url(F.col("canonical_url")))


def robots_rules(robots: DataFrame) -> DataFrame:
    """Rules of robots files as rows: host, group number, agents of the group, allow, rule.

    A run of user-agent lines opens a group; rules belong to the group before them.
    """
    lines = F.split(F.col("robots"), "\\r?\\n")
    clean = F.filter(
        F.transform(lines, lambda line: F.trim(F.regexp_replace(line, "\\s*#.*$", ""))), lambda line: line.contains(":")
    )
    fields = F.transform(clean, lambda line: F.struct(
        F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"),
        F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"),
    ))
    start = F.struct(
        F.lit(0).alias("group"), F.lit(True).alias("closed"),
        F.array().cast("array<struct<group:int,field:string,value:string>>").alias("rows"),
    )

    def step(done: Column, item: Column) -> Column:
        is_agent = item["field"] == "user-agent"
        group = done["group"] + F.when(is_agent & done["closed"], 1).otherwise(0)
        is_rule = item["field"].isin("allow", "disallow") & (done["group"] > 0)
        row = F.struct(group.alias("group"), item["field"].alias("field"), item["value"].alias("value"))
        return F.struct(
            group.alias("group"), F.when(is_agent, F.lit(False)).when(is_rule, F.lit(True)).otherwise(done["closed"]).alias("closed"),
            F.when(is_agent | is_rule, F.concat(done["rows"], F.array(row))).otherwise(done["rows"]).alias("rows"),
        )

    rows = robots.select("host", F.explode(F.aggregate(fields, start, step)["rows"]).alias("r")).select("host", "r.*")
    agents = rows.filter("field = 'user-agent'").groupBy("host", "group").agg(F.collect_set(F.lower("value")).alias("agents"))
    rules = rows.filter("field <> 'user-agent' AND value <> ''").select(
        "host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("rule")
    )
    return agents.join(rules, ["host", "group"], "left")


def allowed_urls(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether robots rules allow each address: longest matching rule, allow wins ties.

    Groups naming the agent take precedence over the general group. ``rules`` comes from
    robots_rules(); rows are joined on the host, never crossed.
    """
    named = rules.withColumn("_exact", F.exists("agents", lambda a: (a != "*") & F.lit(agent.lower()).contains(a)))
    exact_hosts = named.filter("_exact").select("host").distinct().withColumn("_has", F.lit(True))
    chosen = named.join(exact_hosts, "host", "left").filter(
        F.when(F.col("_has"), F.col("_exact")).otherwise(F.array_contains("agents", "*")) & F.col("rule").isNotNull()
    )
    body = F.regexp_replace(F.regexp_replace("rule", "\\$$", ""), "([.+?^${}()|\\[\\]\\\\])", "\\\\$1")
    pattern = F.concat(
        F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(F.col("rule").endswith("$"), "$").otherwise("")
    )
    rules_by_host = chosen.select("host", "allow", F.length("rule").alias("_length"), pattern.alias("_pattern"))
    rows = urls.withColumn("host", hostname(F.col("url"))).withColumn(
        "_path", F.concat(path_of(F.col("url")), F.regexp_extract("url", "(\\?[^#]*)", 1))
    )
    hits = rows.join(rules_by_host, ["host"]).filter(F.expr("_path RLIKE _pattern"))
    winner = hits.groupBy("url").agg(F.max(F.struct("_length", "allow")).alias("w"))
    return urls.join(winner, "url", "left").select(*urls.columns, F.coalesce("w.allow", F.lit(True)).alias("allowed"))


def pool_pages(pages: DataFrame) -> DataFrame:
    """Pages that only invite general applications."""
    title = strip_tags(F.regexp_extract("html", "(?is)<title\\b[^>]*>(.*?)</title>", 1))
    return pages.filter(application_pool(title, strip_tags(F.col("html")))).select("page_id")
