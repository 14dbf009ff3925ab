"""Data-quality audit: deterministic sample, freshness, duplicates, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv32_units
from ..functions.text import comparable_key
from ..functions.urls import canonical_url
from ..plans.skew import first_in_group, group_size


def audit_sample(jobs: DataFrame, size: int = 200, seed: str = "quality-v1") -> DataFrame:
    """Hash-ranked sample that holds every company when the size allows it.

    The size is small by definition (at most a few thousand rows); each company offers one row
    and the rest come from one distributed top-k.
    """
    ranked = jobs.filter("status = 'verified_open'").withColumn(
        "_h", fnv32_units(F.concat(F.lit(f"{seed}:"), F.col("job_id").cast("string")))
    )
    order = [F.col("_h").asc(), F.col("job_id").cast("string").asc()]
    firsts = first_in_group(ranked, ["company_id"], order)
    companies = firsts.agg(F.count(F.lit(1)).alias("_c"))
    allowed = firsts.withColumn("_one", F.lit(1)).join(
        companies.filter(F.col("_c") <= size).withColumn("_one", F.lit(1)), "_one"
    ).select("job_id", F.lit(0).alias("_first"))
    marked = ranked.join(allowed, "job_id", "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    return marked.orderBy(F.col("_first").asc(), *order).limit(max(0, size)).drop("_first", "_h")


def freshness(sample: DataFrame, current: DataFrame, observed: DataFrame, failures: DataFrame) -> DataFrame:
    """fresh, stale, ineligible or inconclusive for every sampled role.

    ``current`` and ``observed`` are the eligible and the raw collections per source_key with
    external_id and canonical_url; ``failures`` lists source_key, message. Identity and URL are
    two equi-joins, never one join on either.
    """
    keyed = sample.withColumn("url", canonical_url(F.col("canonical_url")))

    # A posting may be in both collections and come several times: it is read and its address made canonical once.
    columns = ["source_key", "external_id", "canonical_url"]
    told = current.select(*columns, F.lit(True).alias("c"), F.lit(None).cast("boolean").alias("o")).unionByName(
        observed.select(*columns, F.lit(None).cast("boolean").alias("c"), F.lit(True).alias("o")))
    postings = told.groupBy(*columns).agg(F.max("c").alias("c"), F.max("o").alias("o"))

    def present(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.max("c").alias(f"_c_{name}"), F.max("o").alias(f"_o_{name}"))

    ids = present(postings, ["source_key", "external_id"], "id")
    addresses = present(postings.withColumn("url", canonical_url(F.col("canonical_url"))), ["source_key", "url"], "url")
    collected = postings.groupBy("source_key").agg(F.max(F.coalesce("c", "o")).alias("_known"), F.max("o").alias("_raw"))
    failed = failures.groupBy("source_key").agg(F.min("message").alias("_failure"))
    joined = keyed
    for side, on in [
        (ids, ["source_key", "external_id"]), (addresses, ["source_key", "url"]), (collected, ["source_key"]), (failed, ["source_key"]),
    ]:
        joined = joined.join(side, on, "left")
    is_current = F.coalesce("_c_id", "_c_url", F.lit(False))
    is_observed = F.coalesce("_o_id", "_o_url", F.lit(False))
    state = (
        F.when(F.col("source_key").isNull() | F.col("_failure").isNotNull() | F.col("_known").isNull(), "inconclusive")
        .when(is_current, "fresh").when(F.col("_raw").isNull(), "inconclusive")
        .when(is_observed, "ineligible").otherwise("stale")
    )
    return joined.select(*sample.columns, "url", state.alias("freshness"), F.coalesce("_known", F.lit(False)).alias("_counted"))


def with_duplicates(rows: DataFrame, order: str) -> DataFrame:
    """First owner of a row's identity or else URL, null for the owner itself."""
    counted = rows.filter("_counted")

    def owner(keys: list[str], name: str) -> DataFrame:
        return counted.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("at"), "job_id")).alias(name))

    ids, urls = owner(["source_key", "external_id"], "_i"), owner(["url"], "_u")
    joined = rows.join(ids, ["source_key", "external_id"], "left").join(urls, "url", "left")
    by_id = F.when(F.col("_i.job_id") != F.col("job_id"), F.col("_i.job_id"))
    by_url = F.when(F.col("_u.job_id") != F.col("job_id"), F.col("_u.job_id"))
    return joined.withColumn("duplicate_of", F.when(F.col("_counted"), F.coalesce(by_id, by_url))).drop("_i", "_u")


def review_clusters(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("cluster", F.concat_ws("|", F.col("company_id").cast("string"), *[
        comparable_key(F.col(c)) for c in ("title", "location", "employment_type")
    ]))
    return group_size(keyed, ["cluster"], "cluster_size")


def audit_rates(rows: DataFrame) -> DataFrame:
    """Counts and rates; stale and ineligible over conclusive rows, null when there are none."""
    def kind(name: str):
        return F.count_if(F.col("freshness") == name)

    counts = rows.agg(
        F.count(F.lit(1)).alias("sample"), kind("fresh").alias("fresh"), kind("stale").alias("stale"),
        kind("ineligible").alias("ineligible"), kind("inconclusive").alias("inconclusive"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.count_distinct(F.when(F.col("cluster_size") > 1, F.col("cluster"))).alias("review_clusters"),
    )
    conclusive = F.nullif(F.col("fresh") + F.col("stale") + F.col("ineligible"), F.lit(0).cast("long"))
    return counts.withColumns({
        "stale_rate": F.col("stale") / conclusive, "ineligible_rate": F.col("ineligible") / conclusive,
        "duplicate_rate": F.coalesce(F.try_divide(F.col("duplicates"), F.col("sample")), F.lit(0.0)),
    })


def coverage_gap(current: DataFrame, inventory: DataFrame) -> DataFrame:
    """Eligible roles of the audited sources, and those missing from the inventory by id and URL."""
    rows = current.groupBy("source_key", "external_id").agg(F.min(canonical_url(F.col("canonical_url"))).alias("url"))
    ids = inventory.select("source_key", "external_id").distinct().withColumn("_i", F.lit(True))
    urls = inventory.select(canonical_url(F.col("canonical_url")).alias("url")).distinct().withColumn("_u", F.lit(True))
    joined = rows.join(ids, ["source_key", "external_id"], "left").join(urls, "url", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("_i").isNull() & F.col("_u").isNull()).alias("not_in_inventory")
    )


def audit(jobs: DataFrame, current: DataFrame, observed: DataFrame, failures: DataFrame, size: int = 200) -> DataFrame:
    """The whole audit as one row per sampled role; audit_rates() sums it up."""
    sample = audit_sample(jobs, size)
    return review_clusters(with_duplicates(freshness(sample, current, observed, failures), "job_id")).drop("_counted")


def passes_gates(rates: DataFrame, stale: float = 0.02, duplicates: float = 0.01) -> DataFrame:
    return rates.withColumn(
        "passes", (F.coalesce("stale_rate", F.lit(1.0)) < stale) & (F.col("duplicate_rate") < duplicates)
    )


def concentration(counts: DataFrame) -> DataFrame:
    """Share of every employer in the inventory, largest first. ``counts`` has company_id, jobs."""
    merged = counts.filter("company_id IS NOT NULL AND jobs > 0").groupBy("company_id").agg(F.sum("jobs").alias("jobs"))
    total = merged.agg(F.sum("jobs").alias("_total")).withColumn("_one", F.lit(1))
    shares = merged.withColumn("_one", F.lit(1)).join(total, "_one")
    return shares.select("company_id", "jobs", (F.col("jobs") / F.col("_total")).alias("share")).orderBy(
        F.col("jobs").desc(), F.col("company_id")
    )


def within_share(counts: DataFrame, limit: float) -> DataFrame:
    """Whether no employer exceeds the share; an empty inventory is within it."""
    return concentration(counts).agg((F.coalesce(F.max("share"), F.lit(0.0)) <= limit).alias("within_limit"))
