"""Domain registry: validation, merge by canonical domain, identity conflicts, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import directory_class
from ..functions.text import squeeze
from ..functions.urls import bare_host, hostname, is_https, path_of, with_domains

# Accepted states of registry records.
PERMISSIONS = ["permitted", "manual_only", "awaiting_permission", "prohibited"]
ACTIVITIES = ["unknown", "active", "inactive"]
REVIEWS = ["pending", "verified", "rejected"]


def merge_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates by domain (first name and address win) and their distinct investor links.

    ``rows`` has name, website_url, investor_id, evidence_url, position.
    """
    keyed = rows.withColumn("domain", bare_host(F.col("website_url"))).filter("domain <> ''")
    merged = keyed.groupBy("domain").agg(F.min_by(F.struct("name", "website_url"), F.col("position")).alias("f")).select("domain", "f.*")
    links = keyed.groupBy("domain", "investor_id").agg(F.min_by("evidence_url", F.col("position")).alias("evidence_url"))
    return merged, links


def record_problem(row: dict[str, str] | None = None) -> Column:
    """First rule a registry record breaks, or null. Columns as in the registry input table, and ``domain``."""
    def empty(column: str) -> Column:
        return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""

    terms = is_https(F.col("terms_url"))
    return (
        F.when(empty("company_name"), "company_name").when(~is_https(F.col("website_url")), "website_url")
        .when(~is_https(F.col("evidence_url")), "evidence_url")
        .when(F.col("terms_url").isNotNull() & ~terms, "terms_url")
        .when((F.col("permission_status") == "permitted") & ~F.coalesce(terms, F.lit(False)), "terms_required")
        .when(empty("source_id"), "source_id").when(empty("source_kind"), "source_kind")
        .when(empty("classification"), "classification")
        .when(~F.coalesce(F.col("permission_status").isin(*PERMISSIONS), F.lit(False)), "permission_status")
        .when(~F.coalesce("activity_state", F.lit("unknown")).isin(*ACTIVITIES), "activity_state")
        .when(~F.coalesce("review_status", F.lit("pending")).isin(*REVIEWS), "review_status")
        .when(F.col("observed_at").isNull(), "observed_at")
        .when(F.col("domain") == "", "registrable_domain")
    )


def build_registry(records: DataFrame, aliases: DataFrame, acquisitions: DataFrame, suffixes: DataFrame) -> dict[str, DataFrame]:
    """Registry tables of valid records.

    ``records`` has record_id, position and the record columns plus observed_urls (array);
    ``aliases`` has record_id, alias_domain; ``acquisitions`` record_id, related_domain,
    relation; both carry evidence_url. Later records win per alias, acquisition and evidence;
    the first state that is not the default stays.
    """
    checked = with_domains(records, {"website_url": "domain"}, suffixes).withColumn("problem", record_problem())
    own = checked.select("record_id", "domain", "position")

    def bad(child: DataFrame, column: str) -> DataFrame:
        rows = with_domains(child.join(own, "record_id"), {column: "_d"}, suffixes)
        return rows.filter((F.col("_d") == "") | (F.col("_d") == F.col("domain")) | ~is_https(F.col("evidence_url"))).select("record_id")

    refused = bad(aliases, "alias_domain").unionByName(bad(acquisitions, "related_domain")).distinct()
    valid = checked.filter("problem IS NULL").join(refused, "record_id", "left_anti")
    default_activity = F.col("activity_state").isNull() | (F.col("activity_state") == "unknown")
    default_review = F.col("review_status").isNull() | (F.col("review_status") == "pending")
    entries = valid.groupBy("domain").agg(
        F.min_by(F.struct(squeeze(F.col("company_name")).alias("company_name"), "website_url"), F.col("position")).alias("f"),
        F.coalesce(F.min_by("activity_state", F.when(~default_activity, F.col("position"))), F.lit("unknown")).alias("activity_state"),
        F.coalesce(F.min_by("review_status", F.when(~default_review, F.col("position"))), F.lit("pending")).alias("review_status"),
    ).select("domain", "f.*", "activity_state", "review_status")
    kept = valid.select("record_id", "domain", "position")

    def latest(child: DataFrame, keys: list[str]) -> DataFrame:
        return child.join(kept, "record_id").groupBy("domain", *keys).agg(F.max_by("evidence_url", F.col("position")).alias("evidence_url"))

    named = with_domains(aliases, {"alias_domain": "_d"}, suffixes).withColumn("alias_domain", F.col("_d"))
    related = with_domains(acquisitions, {"related_domain": "_d"}, suffixes).withColumn("related_domain", F.col("_d"))
    alias_rows = latest(named, ["alias_domain"])
    acquired = latest(related, ["relation", "related_domain"])
    key = ["domain", "source_kind", "source_id", "evidence_url"]
    evidence = valid.groupBy(*key).agg(F.max_by(F.struct("permission_status", "terms_url", "observed_at", "classification"), F.col("position")).alias("e")).select(*key, "e.*")
    observed = valid.select(*key, F.explode("observed_urls").alias("observed_url"), "website_url").filter(
        "observed_url <> website_url"
    ).select(*key, "observed_url").distinct()
    receipt = checked.join(refused.withColumn("_x", F.lit(True)), "record_id", "left").agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(F.col("problem").isNull() & F.col("_x").isNull()).alias("valid_records"),
        F.countDistinct(F.when(F.col("problem").isNull() & F.col("_x").isNull(), F.col("domain"))).alias("domains"),
    ).withColumns({
        "rejected_records": F.col("input_records") - F.col("valid_records"),
        "duplicate_domains": F.col("valid_records") - F.col("domains"),
    })
    return {"entries": entries, "aliases": alias_rows, "acquisitions": acquired, "evidence": evidence, "observed": observed, "receipt": receipt}


def identity_conflicts(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases that are canonical somewhere, and aliases with several owners."""
    canonical = aliases.select(F.col("alias_domain").alias("domain")).join(entries.select("domain"), "domain", "left_semi")
    several = aliases.groupBy("alias_domain").agg(F.min("domain").alias("_a"), F.max("domain").alias("_b")).filter("_a <> _b")
    return canonical.select(F.lit("alias_is_canonical").alias("conflict"), F.col("domain").alias("alias_domain")).unionByName(
        several.select(F.lit("alias_has_multiple_owners").alias("conflict"), "alias_domain")
    ).distinct()


def resolve_domains(values: DataFrame, column: str, entries: DataFrame, aliases: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Canonical domain of each value: itself if registered, else its alias owner, else itself."""
    rows = with_domains(values, {column: "_d"}, suffixes)
    direct = entries.select(F.col("domain").alias("_d"), F.col("domain").alias("_direct")).distinct()
    via = aliases.groupBy(F.col("alias_domain").alias("_d")).agg(F.min("domain").alias("_via"))
    joined = rows.join(direct, ["_d"], "left").join(via, ["_d"], "left")
    return joined.withColumn("canonical_domain", F.coalesce("_direct", "_via", "_d")).drop("_d", "_direct", "_via")


def directory_evidence(directory: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Active directory companies with their first usable website, first row per slug.

    ``directory`` has slug, name, website (comma list), status, batch, position.
    """
    sites = F.transform(F.split("website", ","), lambda s: F.regexp_replace(F.trim(s), "^http://", "https://"))
    secure = F.filter(sites, lambda s: s.startswith("https://") & is_https(s))
    active = directory.filter((F.trim("slug") != "") & (F.trim("name") != "") & (F.lower("status") == "active"))
    rows = active.select("slug", "name", "batch", "position", F.posexplode(secure).alias("_i", "website_url"))
    rows = with_domains(rows, {"website_url": "_d"}, suffixes).filter("_d <> ''")
    first = rows.groupBy(F.trim("slug").alias("slug")).agg(
        F.min_by(F.struct("name", "website_url", "batch"), F.struct("position", "_i")).alias("f"))
    return first.select("slug", "f.name", "f.website_url", directory_class(F.col("f.batch")).alias("classification"))


def choose_websites(rows: DataFrame, suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Best website per entity: shortest path, then shortest host, then text; the rest observed."""
    secure = rows.select("entity_id", "website").distinct().filter(is_https(F.col("website")))
    usable = with_domains(secure, {"website": "_d"}, suffixes).filter("_d <> ''").drop("_d")
    best = usable.groupBy("entity_id").agg(F.min(F.struct(
        F.length(path_of(F.col("website"))).alias("p"), F.length(hostname(F.col("website"))).alias("h"), "website"
    )).alias("b")).select("entity_id", F.col("b.website").alias("website_url"))
    rest = usable.join(best, "entity_id").filter("website <> website_url").select("entity_id", F.col("website").alias("observed_url"))
    return best, rest
