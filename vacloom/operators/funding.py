"""Funding announcements found on pages, matched to companies and applied to their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import funding_id
from ..functions.text import plain_words
from ..functions.urls import bare_host, host_suffixes, is_https, normal_href, resolve_url, with_domains
from ..plans.skew import top_in_group

# Wording of a funding announcement, look-back and excluded hosts.
ACTION = "(?i)\\b(?:raises?|raised|secures?|secured|closes?|closed|lands?|landed|announces?|announced)\\b"
OBJECT = (
    "(?i)(?:\\bfunding\\b|\\bfinancing\\b|\\binvestment\\b|\\bround\\b|\\bpre[- ]?seed\\b|\\bseed\\b|"
    "\\bseries\\s+[a-h]\\b|[$€£]\\s?\\d)"
)
SPECULATIVE = "(?i)\\b(?:in talks|seeks?|seeking|plans? to raise|reportedly raising|targeting)\\b"
AMOUNT = "(?i)[$€£]\\s?\\d+(?:[.,]\\d+)?\\s?(?:[kmb]|million|billion)?\\+?"
ROUND = "(?i)\\b(?:pre[- ]?seed|seed|series\\s+[a-h]|growth)(?:\\s+(?:round|funding))?\\b"
LOOKBACK_DAYS = 14
NOT_A_COMPANY = (
    "(?i)(?:^|\\.)(?:techcrunch|crunchbase|yahoo|msn|google|apple|microsoft|amazon|facebook|instagram|linkedin|"
    "twitter|youtube|wikipedia|cloudfront|googleapis|wixstatic|substack)\\.com$|^(?:www\\.)?(?:x\\.com|t\\.co|bit\\.ly)$"
)


def is_announcement(text: Column) -> Column:
    return text.rlike(ACTION) & text.rlike(OBJECT) & ~text.rlike(SPECULATIVE)


def _capitalised(text: Column) -> Column:
    """First letter of every word in upper case, the rest unchanged."""
    pieces = F.regexp_extract_all(text, F.lit("\\w+|\\W+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))
    )), "")


def funding_label(text: Column) -> Column:
    amount = F.regexp_replace(F.regexp_extract(text, AMOUNT, 0), "\\s+", " ")
    round_name = _capitalised(F.regexp_extract(text, ROUND, 0))
    return (
        F.when((amount != "") & (round_name != ""), F.concat(amount, F.lit(" "), round_name))
        .when(amount != "", F.concat(amount, F.lit(" funding round"))).when(round_name != "", round_name)
        .otherwise(F.lit("Funding announced"))
    )


def stage(text: Column) -> Column:
    series = F.regexp_extract(text, "(?i)\\bseries\\s+([a-h])\\b", 1)
    return (
        F.when(series != "", F.concat(F.lit("Series "), F.upper(series)))
        .when(text.rlike("(?i)\\bpre[- ]?seed\\b"), "Pre-seed").when(text.rlike("(?i)\\bseed\\b"), "Seed")
        .when(text.rlike("(?i)\\bgrowth\\b"), "Growth")
    )


def headline_company(title: Column) -> Column:
    """Company a funding headline begins with, or null."""
    clean = F.trim(F.regexp_replace(title, "\\s+", " "))
    name = F.regexp_extract(
        clean, "(?i)^(.{2,80}?)\\s+(?:raises?|raised|secures?|secured|closes?|closed|lands?|landed|announces?|announced)\\b", 1)
    name = F.trim(F.regexp_replace(name, "^[\\s:;|–—-]+|[\\s:;|–—-]+$", ""))
    usable = (name != "") & ~name.rlike("(?i)^(breaking|exclusive|how|why|what|the)\\b") & (F.size(F.split(name, "\\s+")) <= 8)
    return F.when(usable, name)


def name_agrees(name: Column, domain: Column) -> Column:
    label = F.split(domain, "\\.")[0]
    a, b = F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (a.contains(b) | b.contains(a))


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Rows whose text contains a company name as whole words: (key, company_id).

    Word n-grams of the text, as long as the longest name, are joined to the names on
    equality, so the work grows with the texts and never with texts times names.
    """
    named = names.select("company_id", plain_words(F.col("name")).alias("gram")).filter(F.length("gram") >= 3).withColumn(
        "_words", F.size(F.split("gram", " "))
    )
    lengths = named.select("_words").distinct()
    words = texts.select(key, F.split(plain_words(F.col(text)), " ").alias("w"))
    shapes = lengths.agg(F.sort_array(F.collect_set("_words")).alias("_shapes"))
    sized = words.withColumn("_one", F.lit(1)).join(shapes.withColumn("_one", F.lit(1)), "_one").drop("_one")
    grams = sized.select(key, F.explode(F.array_distinct(F.flatten(F.transform(
        F.col("_shapes"),
        lambda n: F.when(n <= F.size("w"), F.transform(
            F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")
        )).otherwise(F.array().cast("array<string>")),
    )))).alias("gram"))
    return grams.join(named.select("gram", "company_id"), ["gram"]).select(key, "company_id").distinct()


def official_hosts(urls: DataFrame, url: str, companies: DataFrame) -> DataFrame:
    """Addresses on a company's own domain or below it: (url, company_id)."""
    suffixes = urls.select(url).distinct().select(url, F.explode(host_suffixes(bare_host(F.col(url)))).alias("_host"))
    domains = companies.select("company_id", F.regexp_replace(F.lower("domain"), "^www\\.", "").alias("_host"))
    return suffixes.join(domains, ["_host"]).select(url, "company_id")


def announcements(pages: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Funding discoveries from pages with metadata.

    ``pages`` has page_id, url, source_kind (official or reputable), publisher, title,
    description, published_at. Official pages must be on the company's domain, reputable ones
    must mention it.
    """
    now = F.lit(as_of).cast("timestamp")
    combined = F.concat(F.col("title"), F.lit(". "), F.col("description"))
    dated = F.col("published_at").between(now - F.expr(f"INTERVAL '{LOOKBACK_DAYS}' DAY"), now + F.expr("INTERVAL '1' DAY"))
    usable = pages.withColumn("combined", combined).filter(dated & is_https(F.col("url")) & is_announcement(F.col("combined")))
    reputable = usable.filter("source_kind = 'reputable'")
    official = usable.filter("source_kind = 'official'")
    by_name = reputable.join(mentions(reputable, "page_id", "combined", companies), "page_id")
    by_host = official.join(official_hosts(official, "url", companies), "url")
    matched = by_name.unionByName(by_host).join(companies.select("company_id", F.col("name").alias("company_name")), ["company_id"])
    label = funding_label(F.col("combined"))
    href = normal_href(F.col("url"))
    rows = matched.select(
        funding_id(F.col("company_id").cast("string"), href).alias("id"), "company_id", "company_name", "page_id",
        F.when(label == "Funding announced", F.concat("company_name", F.lit(" announced new funding")))
        .otherwise(F.concat("company_name", F.lit(" announced "), label)).alias("title"),
        F.coalesce(F.nullif("description", F.lit("")), F.col("title")).alias("description"),
        F.col("published_at").alias("occurred_at"), href.alias("source_url"), "source_kind", "publisher",
        label.alias("funding_label"), stage(F.col("combined")).alias("stage"),
    )
    keep = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max(F.struct("occurred_at", *[c for c in keep if c != "occurred_at"])).alias("r")).select("id", "r.*")


def funding_links(links: DataFrame) -> DataFrame:
    """Links of news pages that announce funding; the last label of an address wins."""
    context = F.concat_ws(" ", "label", "attributes")
    hits = links.filter(is_announcement(context) & F.col("link").startswith("https://"))
    return hits.groupBy("page_id", "link").agg(
        F.max_by("label", F.col("position")).alias("label"), F.min("position").alias("position")
    )


def bounded_links(links: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """First links per page in page order, the reference's bound on what is followed."""
    return top_in_group(links, keys, [F.col("position"), F.col("link")], limit).drop("_rank")


def outside_websites(pages: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The one company website a page points to, for pages that point to exactly one."""
    hrefs = F.regexp_extract_all("html", F.lit("(?i)<a\\b[^>]*href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    scripts = F.regexp_extract_all(
        "html", F.lit("(?is)<script\\b[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    organisations = F.transform(
        F.filter(scripts, lambda s: F.coalesce(F.get_json_object(s, "$['@type']"), F.lit("")).rlike("(?i)organization|corporation")),
        lambda s: F.get_json_object(s, "$.url"),
    )
    found = pages.select("page_id", "url", F.explode(F.concat(F.array_compact(organisations), hrefs)).alias("href"))
    link = resolve_url(F.col("href"), F.col("url"))
    rows = found.select("page_id", "url", link.alias("link")).filter(F.col("link").startswith("https://"))
    host = bare_host(F.col("link"))
    away = rows.filter((host != bare_host(F.col("url"))) & ~host.rlike(NOT_A_COMPANY)).withColumn("_host", host)
    outside = with_domains(away, {"_host": "domain"}, suffixes).filter("domain <> ''")
    return outside.groupBy("page_id").agg(F.min("domain").alias("_a"), F.max("domain").alias("_b")).filter("_a = _b").select(
        "page_id", F.col("_a").alias("website_domain"), F.concat(F.lit("https://"), F.col("_a"), F.lit("/")).alias("website_url")
    )


def company_leads(pages: DataFrame, companies: DataFrame, as_of: str, suffixes: DataFrame) -> DataFrame:
    """Unmatched announcements whose headline company agrees with the one linked website."""
    known = announcements(pages, companies, as_of).select("page_id").distinct()
    now = F.lit(as_of).cast("timestamp")
    combined = F.concat(F.col("title"), F.lit(". "), F.col("description"))
    dated = F.col("published_at").between(now - F.expr(f"INTERVAL '{LOOKBACK_DAYS}' DAY"), now + F.expr("INTERVAL '1' DAY"))
    fresh = pages.filter(dated & is_https(F.col("url")) & is_announcement(combined) & (F.col("source_kind") == "reputable"))
    rest = fresh.join(known, "page_id", "left_anti").withColumn("company_name", headline_company(F.col("title")))
    leads = rest.filter("company_name IS NOT NULL").join(outside_websites(fresh, suffixes), "page_id").filter(
        name_agrees(F.col("company_name"), F.col("website_domain"))
    )
    return leads.groupBy("website_url").agg(F.max_by(
        F.struct("company_name", F.col("url").alias("evidence_url"), "publisher", F.col("published_at").alias("observed_at")),
        F.struct("published_at", "url"),
    ).alias("r")).select("website_url", "r.*")


def apply_funding(companies: DataFrame, changes: DataFrame, discoveries: DataFrame) -> dict[str, DataFrame]:
    """New funding events once per id, and profiles updated only by newer facts."""
    known = discoveries.join(companies.select("company_id"), "company_id", "left_semi")
    events = known.join(changes.select("id"), "id", "left_anti").select(
        "id", F.lit("company").alias("entity_type"), F.col("company_id").alias("entity_id"),
        F.lit("funding_announced").alias("change_type"), "title", "description", "occurred_at", "source_url",
    )
    newest = known.groupBy("company_id").agg(
        F.max_by(F.struct("funding_label", "occurred_at"), F.struct(F.to_date("occurred_at"), F.col("id"))).alias("_new"),
        F.max_by("stage", F.when(F.col("stage").isNotNull(), F.struct(F.to_date("occurred_at"), F.col("id")))).alias("_stage"),
    )
    day = F.to_date("_new.occurred_at")
    newer = F.col("_new").isNotNull() & (F.col("latest_funding_date").isNull() | (F.col("latest_funding_date") < day))
    updated = companies.join(newest, "company_id", "left").select(
        *[c for c in companies.columns if c not in {"stage", "latest_funding_date", "latest_funding_label"}],
        F.when(newer, F.coalesce("_stage", "stage")).otherwise(F.col("stage")).alias("stage"),
        F.when(newer, F.col("_new.funding_label")).otherwise(
            F.col("latest_funding_label") if "latest_funding_label" in companies.columns else F.lit(None).cast("string")
        ).alias("latest_funding_label"),
        F.when(newer, day).otherwise(F.col("latest_funding_date")).alias("latest_funding_date"),
    )
    return {"events": events, "companies": updated}
