"""Discovery work queue: what may run next, in which order, and what an attempt leads to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import transient_failure
from ..functions.hashing import prefixed_id
from ..functions.text import domain_title
from ..functions.urls import career_fingerprint, with_domains
from ..plans.skew import first_in_group, in_order
from ..session import durable

# Version of the discovery rules, retry clock and statuses.
PIPELINE_VERSION = "2026-09-01"
RETRY_BASE_MS = 6 * 3600 * 1000
RETRY_MAXIMUM_MS = 7 * 24 * 3600 * 1000
ACTIVATION_DEFER_MS = 2 * 3600 * 1000
CLOSED_REVIEWS = ["rejected", "activated"]
WAITING = ["discovered", "canonical_source_found"]


def plus_millis(at: Column, millis: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(at) + millis.cast("long"))


def retry_at(attempted: Column, attempts: Column, retry_after_ms: Column | None = None) -> Column:
    """Exponential back-off from six hours to seven days, never sooner than the server asked."""
    steps = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(40))
    wait = F.least(F.lit(float(RETRY_MAXIMUM_MS)), F.lit(float(RETRY_BASE_MS)) * F.pow(F.lit(2.0), steps))
    asked = F.coalesce(retry_after_ms, F.lit(0)) if retry_after_ms is not None else F.lit(0)
    return plus_millis(attempted, F.greatest(wait.cast("long"), asked.cast("long")))


def activation_due(verified: Column) -> Column:
    return plus_millis(verified, F.lit(ACTIVATION_DEFER_MS))


def flagged(queue: DataFrame, evidence: DataFrame, reviews: DataFrame) -> DataFrame:
    """Queue rows with whether access is permitted and whether a review is active."""
    permitted = evidence.filter("permission_status = 'permitted'").select(
        F.col("canonical_domain").alias("normalized_domain"), F.lit(True).alias("_permitted")
    ).distinct()
    active = reviews.filter(~F.col("status").isin(*CLOSED_REVIEWS)).select(
        F.col("candidate_id").alias("id"), F.lit(True).alias("_reviewed")
    ).distinct()
    return queue.join(permitted, "normalized_domain", "left").join(active, "id", "left").withColumns({
        "permitted": F.coalesce("_permitted", F.lit(False)), "review_active": F.coalesce("_reviewed", F.lit(False)),
    }).drop("_permitted", "_reviewed")


def runnable(now: Column, version: str = PIPELINE_VERSION) -> Column:
    """Predicate on flagged rows: due, permitted, not under review."""
    stale = F.col("last_attempted_at").isNull() | (F.col("last_attempted_at") < now - F.expr("INTERVAL '1' HOUR"))
    old = F.coalesce("discovery_version", F.lit("")) != version
    state = (
        F.col("status").isin(*WAITING) | ((F.col("status") == "needs_review") & old)
        | ((F.col("status") == "resolving") & stale)
    )
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return state & F.col("permitted") & due & ~F.col("review_active")


def queue_order() -> list[Column]:
    return [
        F.coalesce("attempt_count", F.lit(0)).asc(), F.col("first_discovered_at").desc(), F.col("id").desc(),
    ]


def next_candidates(
    queue: DataFrame, evidence: DataFrame, reviews: DataFrame, as_of: str, limit: int = 10
) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    return flagged(queue, evidence, reviews).filter(runnable(now)).orderBy(*queue_order()).limit(limit)


def queue_funnel(queue: DataFrame, evidence: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """Counts of the whole queue in one pass over rows flagged beforehand."""
    now = F.lit(as_of).cast("timestamp")
    ready = runnable(now)
    allowed, waiting = F.col("permitted"), F.col("status").isin(*WAITING)

    def status(value: str) -> Column:
        return F.col("status") == value

    stale = status("needs_review") & (F.coalesce("discovery_version", F.lit("")) != PIPELINE_VERSION)
    counts = {
        "auto_eligible": allowed, "permission_excluded": ~allowed, "ready": ready,
        "in_progress": status("resolving"), "discovered": status("discovered"),
        "canonical_source_found": status("canonical_source_found"), "needs_review": status("needs_review"),
        "stale_needs_review": stale & allowed & ~F.col("review_active"), "active": status("active"),
        "unsupported": status("unsupported"), "rejected": status("rejected"),
        "never_attempted": allowed & F.col("last_attempted_at").isNull(),
        "review_gated": allowed & F.col("review_active"),
        "retry_due": allowed & (F.col("next_attempt_at") <= now) & waiting,
        "retry_deferred": allowed & (F.col("next_attempt_at") > now) & waiting,
    }
    return flagged(queue, evidence, reviews).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()],
        F.min(F.when(ready, F.col("first_discovered_at"))).alias("oldest_ready_at"),
    )


def histogram(rows: DataFrame, column: str, missing: str, out: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(out)).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.col("count").desc(), F.col(out))


def registry_funnel(registry: DataFrame, evidence: DataFrame, queue: DataFrame) -> DataFrame:
    permitted = evidence.filter("permission_status = 'permitted'").select("canonical_domain", F.lit(True).alias("_p")).distinct()
    queued = queue.select(F.col("normalized_domain").alias("canonical_domain"), F.lit(True).alias("_q")).distinct()
    rows = registry.join(permitted, "canonical_domain", "left").join(queued, "canonical_domain", "left")
    allowed, waiting = F.col("_p").isNotNull(), F.col("_q").isNotNull()
    pending = F.col("review_status") == "pending"
    free = pending & F.col("company_id").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"),
        F.count_if((F.col("review_status") == "verified") & (F.col("activity_state") == "active")).alias("verified_active"),
        F.count_if(F.col("review_status") == "rejected").alias("rejected"),
        F.count_if(free).alias("promotion_universe"), F.count_if(free & allowed).alias("eligible"),
        F.count_if(free & ~allowed).alias("permission_excluded"),
        F.count_if(free & allowed & ~waiting).alias("eligible_never_queued"),
        F.count_if(free & allowed & waiting).alias("eligible_queued"),
    )


def promote(
    registry: DataFrame, evidence: DataFrame, queue: DataFrame, as_of: str, limit: int = 150,
    directory_kind: str = "directory",
) -> DataFrame:
    """Permitted, pending, unowned and unqueued registry domains as new queue rows."""
    ranked = evidence.filter("permission_status = 'permitted'").groupBy("canonical_domain").agg(
        F.max((F.col("source_kind") == directory_kind).cast("int")).alias("directory_ranked")
    )
    open_rows = registry.filter("review_status = 'pending' AND company_id IS NULL").join(ranked, "canonical_domain")
    free = open_rows.join(
        queue.select(F.col("normalized_domain").alias("canonical_domain")), "canonical_domain", "left_anti"
    )
    chosen = free.orderBy(
        F.col("first_seen_at").desc(), F.col("directory_ranked").desc(), F.col("canonical_domain")
    ).limit(max(0, limit))
    domain = F.col("canonical_domain")
    name = F.trim("company_name")
    return chosen.select(
        prefixed_id("candidate", domain).alias("id"), domain.alias("normalized_domain"),
        F.when(name != "", name).otherwise(domain_title(domain)).alias("company_name"), "website_url",
        F.lit("discovered").alias("status"), F.lit(as_of).cast("timestamp").alias("first_discovered_at"),
        "directory_ranked",
    )


def outcomes(attempts: DataFrame, as_of: str) -> DataFrame:
    """Status, outcome and next attempt that each resolution attempt leads to.

    ``attempts`` has id, attempt_count (before this attempt), resolution (one of probe_error,
    fetch_error, no_detection outcomes, empty_board, verified), message, retry_after_ms,
    slot_free.
    """
    now = F.lit(as_of).cast("timestamp")
    tries = F.coalesce("attempt_count", F.lit(0)) + 1
    kind, message = F.col("resolution"), F.coalesce("message", F.lit(""))
    blocked = message.rlike("(?i)robots|permission|disallow")
    probe_retry = (kind == "probe_error") & ~blocked & transient_failure(message)
    fetch_retry = (kind == "fetch_error") & transient_failure(message)
    retry = probe_retry | fetch_retry
    unresolved = kind.isin("ambiguous", "unsupported", "no_ats_detected")
    status = (
        F.when(retry, "discovered").when(kind == "unsupported", "unsupported")
        .when((kind == "verified") & F.col("slot_free"), "active")
        .when(kind == "verified", "canonical_source_found").otherwise("needs_review")
    )
    outcome = (
        F.when((kind == "probe_error") & blocked, "probe_blocked").when(kind == "probe_error", "probe_failed")
        .when(kind == "fetch_error", "canonical_fetch_failed").when(unresolved, kind)
        .when(kind == "empty_board", "no_us_openings").when(F.col("slot_free"), "activated")
        .otherwise("canonical_source_found")
    )
    error = (
        F.when(kind.isin("probe_error", "fetch_error"), F.substring(message, 1, 500))
        .when(kind == "ambiguous", "multiple_canonical_ats_candidates")
        .when(kind == "unsupported", "unsupported_external_career_system")
        .when(kind == "no_ats_detected", "canonical_ats_not_detected")
        .when(kind == "empty_board", "no_verified_us_open_jobs")
    )
    next_at = (
        F.when(probe_retry, retry_at(now, tries)).when(fetch_retry, retry_at(now, tries, F.col("retry_after_ms")))
        .when((kind == "verified") & ~F.col("slot_free"), activation_due(now))
    )
    return attempts.select(
        "id", tries.alias("attempt_count"), status.alias("status"), outcome.alias("last_outcome"),
        error.alias("last_error"), next_at.alias("next_attempt_at"), F.lit(PIPELINE_VERSION).alias("discovery_version"),
    )


def activation(
    candidates: DataFrame, companies: DataFrame, sources: DataFrame, investor_links: DataFrame, as_of: str
) -> dict[str, DataFrame]:
    """Rows an activated candidate adds: company, source, investor links and registry update.

    ``candidates`` has candidate_id, normalized_domain, company_name, provider, board_id,
    careers_url, evidence_url. Existing companies keep their id.
    """
    now = F.lit(as_of).cast("timestamp")
    owned = companies.groupBy(F.lower("domain").alias("normalized_domain")).agg(F.min("company_id").alias("_owner"))
    named = candidates.join(owned, "normalized_domain", "left").withColumn(
        "company_id", F.coalesce(F.col("_owner").cast("string"), prefixed_id("company", F.col("normalized_domain")))
    ).withColumn("source_id", F.concat_ws(":", "provider", F.lower("board_id")))
    new_companies = named.filter("_owner IS NULL").select(
        "company_id", F.regexp_replace("normalized_domain", "[^a-z0-9]+", "-").alias("slug"),
        F.col("company_name").alias("name"), F.col("normalized_domain").alias("domain"),
        F.lit("Not published").alias("industry"), "careers_url", F.col("evidence_url").alias("source_url"),
        now.alias("last_verified_at"),
    )
    new_sources = named.select("source_id", "company_id", "provider", "board_id", "careers_url").join(
        sources.select(F.col("source_id").cast("string").alias("source_id")), "source_id", "left_anti"
    )
    links = investor_links.join(named.select("candidate_id", "company_id"), "candidate_id").select(
        "company_id", "investor_id"
    ).distinct()
    registry = named.select(
        F.col("normalized_domain").alias("canonical_domain"), "company_id", F.lit("active").alias("activity_state"),
        F.lit("verified").alias("review_status"),
        career_fingerprint(F.col("provider"), F.col("board_id"), F.col("careers_url")).alias("career_fingerprint"),
    )
    queue = named.select(F.col("candidate_id").alias("id"), F.lit("active").alias("status"), F.lit("activated").alias("last_outcome"))
    return {"companies": new_companies, "sources": new_sources, "links": links, "registry": registry, "queue": queue}


ACTIVE_REVIEWS = ["queued", "processing", "ready", "needs_review", "failed", "approved"]


def stage_reviews(queue: DataFrame, reviews: DataFrame, batch_id: str, size: int) -> DataFrame:
    """Next unassigned candidates as queued reviews of a new batch."""
    assigned = reviews.filter(F.col("status").isin(*ACTIVE_REVIEWS)).select(F.col("candidate_id").alias("id"))
    free = queue.filter(F.col("status").isin(*WAITING)).join(assigned, "id", "left_anti")
    return free.orderBy(*queue_order()).limit(size).select(
        F.lit(batch_id).alias("batch_id"), F.col("id").alias("candidate_id"), F.lit("queued").alias("status")
    )


def batch_counts(reviews: DataFrame) -> DataFrame:
    """Counters and roll-up status of every review batch."""
    def among(*values: str) -> Column:
        return F.count_if(F.col("status").isin(*values))

    counted = reviews.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if(~F.col("status").isin("queued", "processing")).alias("processed"),
        among("ready").alias("ready"), among("needs_review").alias("needs_review"), among("failed").alias("failed"),
        among("queued", "processing").alias("remaining"), among("ready", "approved").alias("awaiting"),
    )
    return counted.withColumn(
        "status", F.when(F.col("remaining") > 0, "processing").when(F.col("awaiting") > 0, "ready").otherwise("completed")
    )


def approvals(reviews: DataFrame, expected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Whether each requested approval holds, with the first reason it does not.

    ``expected`` has candidate_id, expected_fingerprint; ``fresh`` has candidate_id,
    fresh_fingerprint and job_count of the board as it is now.
    """
    rows = expected.join(reviews, "candidate_id", "left").join(fresh, "candidate_id", "left")
    complete = F.col("fingerprint").isNotNull() & (F.col("status") == "ready")
    reason = (
        F.when(F.col("status").isNull(), "candidate_not_in_batch").when(F.col("status") == "activated", "already_activated")
        .when(~complete, F.concat(F.lit("candidate_not_ready:"), F.col("status")))
        .when(F.col("expected_fingerprint") != F.col("fingerprint"), "staged_fingerprint_mismatch")
        .when(
            (F.coalesce("job_count", F.lit(0)) == 0) | ~F.col("fresh_fingerprint").eqNullSafe(F.col("fingerprint")),
            "canonical_board_changed_since_review",
        )
    )
    return rows.select("candidate_id", reason.isNull().alias("approved"), reason.alias("reason"))


def reject(reviews: DataFrame, queue: DataFrame, registry: DataFrame, rejected: DataFrame) -> dict[str, DataFrame]:
    """Reviews, queue rows and unowned registry domains after rejecting candidates."""
    asked = rejected.select("candidate_id", F.lit(True).alias("_r")).distinct()
    open_states = F.col("status").isin("ready", "needs_review", "failed")
    after = reviews.join(asked, "candidate_id", "left").withColumn(
        "status", F.when(F.col("_r").isNotNull() & open_states, "rejected").otherwise(F.col("status"))
    )
    done = after.filter("_r AND status = 'rejected'").select(F.col("candidate_id").alias("id"), F.lit(True).alias("_d")).distinct()
    queue_after = queue.join(done, "id", "left").withColumn(
        "status", F.when(F.col("_d"), "rejected").otherwise(F.col("status"))
    )
    domains = queue_after.filter("_d").select(F.col("normalized_domain").alias("canonical_domain"), F.lit(True).alias("_x")).distinct()
    registry_after = registry.join(domains, "canonical_domain", "left").withColumn(
        "review_status", F.when(F.col("_x") & F.col("company_id").isNull(), "rejected").otherwise(F.col("review_status"))
    )
    return {"reviews": after.drop("_r"), "queue": queue_after.drop("_d"), "registry": registry_after.drop("_x")}


def first_source(sources: DataFrame) -> DataFrame:
    """First source per company: enabled ones first, then by id."""
    return first_in_group(sources, ["company_id"], [F.col("enabled").desc(), F.col("source_id").asc()])


def latest_attempts(receipts: DataFrame) -> DataFrame:
    """Latest attempt per domain; the later row wins a tie."""
    return first_in_group(receipts, ["domain"], [F.col("attempt").desc(), F.col("position").desc()])


def yield_summary(receipts: DataFrame) -> DataFrame:
    """Totals by provider, by classification and overall from the latest attempts."""
    latest = latest_attempts(receipts)
    detected = F.col("provider").isNotNull()
    grouped = latest.groupingSets([["provider"], ["classification"], []], "provider", "classification").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("measured"), F.count_if(detected).alias("detected"),
        F.count_if(F.col("fetch_status") == "complete").alias("complete"),
        F.count_if(F.col("verified_status") == "verified_us_jobs").alias("verified_companies"),
        F.coalesce(F.sum("verified_jobs"), F.lit(0)).alias("verified_jobs"),
    )
    kind = F.when(F.col("_g") == 1, "provider").when(F.col("_g") == 2, "classification").otherwise("total")
    label = F.when(F.col("_g") == 1, F.col("provider")).when(F.col("_g") == 2, F.col("classification")).otherwise("all")
    return grouped.withColumns({"kind": kind, "label": label}).filter("label IS NOT NULL").select(
        "kind", "label", "measured", "detected", "complete", "verified_companies", "verified_jobs"
    )


def host_leads(links: DataFrame, samples: int = 3) -> DataFrame:
    """Unsupported career hosts: domains, evidence pages, occurrences, signals, sample links.

    ``links`` has host, domain, page, occurrences, signals, url. Samples are the first in order.
    """
    counts = links.groupBy("host").agg(
        F.countDistinct("domain").alias("domains"), F.countDistinct("page").alias("pages"),
        F.sum("occurrences").alias("occurrences"),
    )
    signals = links.select("host", F.explode("signals").alias("signal")).distinct().groupBy("host").agg(
        F.sort_array(F.collect_list("signal")).alias("signals")
    )
    urls = links.select("host", "url").distinct()
    window = Window.partitionBy("host").orderBy("url")
    sample = urls.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= samples).groupBy("host").agg(
        F.sort_array(F.collect_list("url")).alias("sample_urls")
    )
    return counts.join(signals, "host", "left").join(sample, "host", "left").orderBy(
        F.col("domains").desc(), F.col("occurrences").desc(), F.col("host")
    )


def receipt_counts(receipts: DataFrame) -> DataFrame:
    """Counts of source receipts by status and whether they add up."""
    def status(value: str) -> Column:
        return F.col("status") == value

    fits = (
        F.when(status("completed"), F.col("fetched")).when(status("manual") | status("blocked"), ~F.col("fetched"))
        .otherwise(F.lit(True))
    )
    counted = receipts.agg(
        F.count(F.lit(1)).alias("configured"), F.count_if(F.col("fetched")).alias("fetched"),
        *[F.count_if(status(s)).alias(s) for s in ("manual", "blocked", "failed", "completed")],
        F.count_if(status("failed") & F.col("fetched")).alias("_fetched_failed"), F.count_if(~fits).alias("_odd"),
    )
    adds_up = (
        (F.col("configured") == F.col("completed") + F.col("manual") + F.col("blocked") + F.col("failed"))
        & (F.col("fetched") == F.col("completed") + F.col("_fetched_failed")) & (F.col("_odd") == 0)
    )
    return counted.withColumn("reconciled", adds_up).drop("_fetched_failed", "_odd")


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles (index ceil((n - 1) f)) of a column that has an order; null values do not count.

    Equal values of a key are counted as one row, and these rows are dealt by ranges of key and value. The sizes of
    a key's ranges tell which one holds an index; only that one is numbered. A task sees a range, never a whole key.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    given = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(value).alias("_v")).filter("_v IS NOT NULL")
    counted = given.groupBy(*own, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranges = durable(counted.repartitionByRange(*own, "_v").withColumn("_range", F.spark_partition_id()))  # from here on partitions stay as they are
    parts = ranges.groupBy(*own, "_range").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = durable(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    ends = parts.groupBy(*own).agg(F.sum("_n").alias("_size"), F.min("_low").alias("minimum"), F.max("_high").alias("maximum"))

    def same(names: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"a{k}")) for k in names])

    def other(frame: DataFrame, names: list[str]) -> DataFrame:
        return frame.withColumnsRenamed({k: f"a{k}" for k in names})

    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.ceil((F.col("_size") - 1) * F.lit(float(f))).alias("skip")) for n, f in fractions.items()]))
    sized = parts.join(other(ends.select(*own, "_size"), own), same(own)).select(*own, "_range", "_before", "_n", asked.alias("a"))
    near = sized.filter("a.skip >= _before AND a.skip < _before + _n").select(*own, "_range", "a.name", (F.col("a.skip") - F.col("_before")).alias("skip"))
    at = [*own, "_range"]
    inside = Window.partitionBy(*at, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.join(other(near, at), same(at)).withColumn("_upto", F.sum("_n").over(inside)).filter("skip >= _upto - _n AND skip < _upto")
    found = placed.groupBy(*own).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(f"_f_{n}") for n in fractions])
    return ends.join(other(found, own), same(own)).select(
        *[F.col(k).alias(n) for k, n in zip(own, keys)], *[F.col(f"_f_{n}").alias(n) for n in fractions], "minimum", "maximum")


def measurement_inputs(records: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Permitted pending records merged by domain with a dense index in domain order.

    ``records`` has website_url, company_name, classification, source_id, review_status,
    permission_status, position. The first record names the company, the explicit class wins.
    """
    pending = records.filter("review_status = 'pending' AND permission_status = 'permitted'")
    usable = with_domains(pending, {"website_url": "domain"}, suffixes).filter((F.col("domain") != "") & F.col("website_url").startswith("https://"))
    explicit = F.max((F.col("classification") == "explicit_startup").cast("int"))
    first = F.min_by(F.struct("company_name", "website_url", "classification"), F.col("position"))
    merged = usable.groupBy("domain").agg(explicit.alias("_e"), first.alias("_f"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    return merged.select(
        "domain", "_f.company_name", "_f.website_url", "sources",
        F.when(F.col("_e") == 1, "explicit_startup").otherwise(F.coalesce("_f.classification", F.lit("unknown"))).alias("classification"),
    )


def dense_index(df: DataFrame, order: str, out: str = "input_index") -> DataFrame:
    """Dense index from zero in global order."""
    return in_order(df, [F.col(order).asc()], out)[0]
