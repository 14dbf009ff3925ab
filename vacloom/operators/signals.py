"""Off-board hiring signals: validation, expiry, evidence rules and promotion to roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, hostname, is_https, url_variants, with_domains
from .merging import insert_new

# Accepted kinds and permissions of a signal, and the providers it can lead to.
SOURCE_KINDS = ["submission", "company_blog", "rss", "github", "hacker_news", "authorized_api"]
PERMISSIONS = ["permitted", "authorized", "manual_reviewed"]
PROVIDERS = ["ashby", "greenhouse", "lever", "workable", "recruitee", "personio", "smartrecruiters", "structured"]
GITHUB_HOSTS = ["github.com", "api.github.com"]
NEWS_HOSTS = ["news.ycombinator.com", "hacker-news.firebaseio.com"]
LIFETIME_DAYS = 90


def import_reason(as_of: str) -> Column:
    """First reason a signal record is refused, or null; ``_domain`` is that of its company."""
    now = F.lit(as_of).cast("timestamp")

    def text(column: str) -> Column:
        return F.trim(F.coalesce(F.col(column), F.lit("")))

    application = text("application_url")
    clock = (
        F.col("observed_at").isNull() | F.col("last_verified_at").isNull() | F.col("expires_at").isNull()
        | (F.col("last_verified_at") < F.col("observed_at"))
        | (F.col("last_verified_at") > now + F.expr("INTERVAL '5' MINUTE")) | (F.col("expires_at") <= now)
        | (F.unix_millis("expires_at") - F.unix_millis("observed_at") > LIFETIME_DAYS * 86400000)
    )
    return (
        F.when(~text("id").rlike("^[A-Za-z0-9][A-Za-z0-9._:-]{2,159}$"), "id must be a stable 3 to 160 character key")
        .when((text("company_name") == "") | (F.length(text("company_name")) > 200) | (F.col("_domain") == ""),
              "companyName and a registrable companyDomain are required")
        .when((text("role_function") == "") | (F.length(text("role_function")) > 200) | (text("summary") == "") | (F.length(text("summary")) > 1000),
              "roleFunction and summary are required")
        .when(~(text("source_kind").isin(*SOURCE_KINDS) & text("permission_status").isin(*PERMISSIONS)),
              "sourceKind or permissionStatus is not allowed")
        .when(~(is_https(text("source_url")) & is_https(text("evidence_url")) & is_https(text("rights_url"))) | ((application != "") & ~is_https(application)),
              "source, evidence, rights, and optional application URLs must use HTTPS")
        .when(clock, "timestamps must describe a current signal expiring within 90 days")
        .when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 100) | (F.col("confidence") != F.floor("confidence")),
              "confidence must be an integer from 0 to 100")
    )


def split_import(records: DataFrame, as_of: str, suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records and (position, reason) of refused ones; one refusal refuses the batch."""
    checked = with_domains(records, {"company_domain": "_domain"}, suffixes).withColumn("reason", import_reason(as_of)).drop("_domain")
    refused = checked.filter("reason IS NOT NULL").select("position", "reason")
    gate = refused.agg((F.count(F.lit(1)) == 0).alias("_ok")).withColumn("_one", F.lit(1))
    accepted = checked.filter("reason IS NULL").withColumn("_one", F.lit(1)).join(gate.filter("_ok"), "_one").drop("_one", "_ok", "reason")
    return accepted, refused


def active_signals(signals: DataFrame, as_of: str) -> DataFrame:
    return signals.filter((F.col("status") == "active") & (F.col("expires_at") > F.lit(as_of).cast("timestamp")))


def evidence_allows() -> Column:
    """Whether kind, hosts and permission of a signal allow promoting it."""
    source, evidence = hostname(F.col("source_url")), hostname(F.col("evidence_url"))
    kind, domain = F.col("source_kind"), F.col("_company_site")
    own = (F.col("_source_site") == domain) & (F.col("_evidence_site") == domain)
    return F.coalesce(
        F.when((source == "") | (evidence == ""), F.lit(False)).when(kind.isin("company_blog", "rss"), own)
        .when(kind == "github", source.isin(*GITHUB_HOSTS) & evidence.isin(*GITHUB_HOSTS))
        .when(kind == "hacker_news", source.isin(*NEWS_HOSTS) & evidence.isin(*NEWS_HOSTS))
        .when(kind == "authorized_api", F.col("permission_status") == "authorized")
        .when(kind == "submission", F.col("permission_status").isin("authorized", "manual_reviewed")),
        F.lit(False),
    )


def exact_roles(signals: DataFrame, roles: DataFrame) -> DataFrame:
    """The one current role of the signal's company an address of the signal names.

    ``roles`` has company_id, source_id, external_id, job_id, canonical_url of complete,
    current collections.
    """
    targets = signals.select("signal_id", "company_id", F.explode(F.array_distinct(F.concat(
        url_variants(F.col("source_url")), url_variants(F.col("evidence_url")), url_variants(F.col("application_url"))
    ))).alias("url"))
    keyed = roles.select("company_id", "source_id", "external_id", "job_id", canonical_url(F.col("canonical_url")).alias("url"))
    hits = targets.join(keyed, ["company_id", "url"]).select("signal_id", "source_id", "external_id", "job_id").distinct()
    per_source = hits.groupBy("signal_id", "source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("external_id", "job_id")).alias("r")
    ).filter("_n = 1")
    return per_source.groupBy("signal_id").agg(F.min(F.struct("source_id", "r.external_id", "r.job_id")).alias("m")).select("signal_id", "m.*")


def promotions(
    signals: DataFrame, companies: DataFrame, sources: DataFrame, roles: DataFrame, done: DataFrame, as_of: str, suffixes: DataFrame
) -> DataFrame:
    """Outcome of every signal: promoted with its role, already promoted, or why not."""
    now = F.lit(as_of).cast("timestamp")
    domains = with_domains(companies.select("company_id", "domain"), {"domain": "_domain"}, suffixes).drop("domain")
    signals = with_domains(
        signals, {"company_domain": "_company_site", "source_url": "_source_site", "evidence_url": "_evidence_site"}, suffixes)
    live = sources.filter(F.col("enabled") & (F.col("discovery_status") == "active") & F.col("provider").isin(*PROVIDERS)).select(
        "company_id", F.lit(True).alias("_source")
    ).distinct()
    matched = exact_roles(signals, roles)
    before = done.select("signal_id", F.lit(True).alias("_done")).distinct()
    rows = signals.join(domains, "company_id", "left").join(live, "company_id", "left").join(
        matched, "signal_id", "left").join(before, "signal_id", "left")
    reason = (
        F.when(F.col("_done").isNotNull(), F.lit(None).cast("string"))
        .when(F.col("company_id").isNull(), "canonical_company_required")
        .when((F.col("status") != "active") | (F.col("expires_at") <= now), "signal_inactive_or_expired")
        .when(~evidence_allows(), "off_board_evidence_mismatch")
        .when(~F.col("_domain").eqNullSafe(F.col("_company_site")), "employer_domain_mismatch")
        .when(F.col("_source").isNull(), "canonical_source_required")
        .when(F.col("job_id").isNull(), "exact_current_role_not_found")
    )
    status = F.when(F.col("_done").isNotNull(), "already_promoted").when(F.col("reason").isNull(), "promoted").otherwise("not_promotable")
    return rows.withColumn("reason", reason).select(
        "signal_id", status.alias("status"), "reason", "company_id", F.when(status == "promoted", F.col("job_id")).alias("job_id")
    )


def record_promotions(signals: DataFrame, stored: DataFrame, outcome: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Promotion rows once per signal, and signals flipped only where a promotion exists."""
    live = active_signals(signals, as_of).select("signal_id")
    rows = outcome.filter("status = 'promoted'").join(live, "signal_id", "left_semi").select("signal_id", "job_id", "company_id")
    after = insert_new(stored, rows, ["signal_id"])
    jobs = after.select("signal_id", F.col("job_id").alias("_job"))
    flips = F.col("_job").isNotNull() & (F.col("status") == "active") & (F.col("expires_at") > F.lit(as_of).cast("timestamp"))
    updated = signals.join(jobs, "signal_id", "left").withColumn(
        "status", F.when(flips, "promoted").otherwise(F.col("status"))
    ).drop("_job")
    return after, updated


def open_promotions(promoted: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Promoted roles that are still open, with their employer."""
    return promoted.join(
        jobs.filter("status = 'verified_open'").select("job_id", "title", "location"), "job_id"
    ).join(companies.select("company_id", F.col("name").alias("company_name")), "company_id")
