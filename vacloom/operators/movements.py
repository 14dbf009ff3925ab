"""Movements of open roles per company, sector and day, derived from the change feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import kept_sector, sector_or_null
from ..functions.text import round_half_up, slug
from ..session import durable

OPENED, CLOSED, FUNDED = "job_opened", "job_closed", "funding_announced"
ROLE_MOVES = [OPENED, CLOSED]


def direction(change_type: Column) -> Column:
    return F.when(change_type == OPENED, F.lit(1)).when(change_type == CLOSED, F.lit(-1)).otherwise(F.lit(0))


def within(at: Column, as_of: str, days: int) -> Column:
    """Both ends of the trailing window belong to it."""
    end = F.lit(as_of).cast("timestamp")
    return (at >= end - F.expr(f"INTERVAL '{days}' DAY")) & (at <= end)


def published_sector(industry: str = "industry", stored: str = "sector") -> Column:
    return kept_sector(sector_or_null(F.col(industry)), F.col(stored))


def owned_counts(changes: DataFrame, jobs: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Sums per company over events of the company itself or of one of its jobs.

    Events are summed per entity before the join, so that an entity with very many events
    travels as one row per task.
    """
    per_entity = changes.groupBy("entity_type", "entity_id").agg(
        *[F.sum(expression).alias(name) for name, expression in counts.items()]
    )
    own = per_entity.filter("entity_type = 'company'").withColumn("company_id", F.col("entity_id"))
    via = per_entity.filter("entity_type <> 'company'").withColumnRenamed("entity_id", "job_id").join(
        jobs.select("job_id", "company_id"), "job_id"
    )
    columns = ["company_id", *counts]
    return own.select(*columns).unionByName(via.select(*columns)).groupBy("company_id").agg(
        *[F.sum(name).alias(name) for name in counts]
    )


def company_deltas(
    companies: DataFrame, jobs: DataFrame, changes: DataFrame, as_of: str, days: int = 30
) -> DataFrame:
    """Net roles opened minus closed in the window; silent companies are zero. Repeats count."""
    recent = changes.filter(F.col("change_type").isin(*ROLE_MOVES)).filter(
        within(F.col("occurred_at"), as_of, days)
    )
    nets = owned_counts(recent, jobs, {"delta": direction(F.col("change_type"))})
    return companies.select("company_id").join(nets, "company_id", "left").withColumn(
        "delta", F.coalesce("delta", F.lit(0)).cast("long")
    )


def trailing_deltas(jobs: DataFrame, changes: DataFrame, days: int = 30) -> DataFrame:
    """Net movement per company over the trailing days, for every day with an event."""
    daily = (
        changes.filter(F.col("change_type").isin(*ROLE_MOVES)).filter("entity_type = 'job'")
        .groupBy("entity_id", F.to_date("occurred_at").alias("day"))
        .agg(F.sum(direction(F.col("change_type"))).alias("net"))
        .withColumnRenamed("entity_id", "job_id")
        .join(jobs.select("job_id", "company_id"), "job_id")
        .groupBy("company_id", "day").agg(F.sum("net").alias("net"))
    )
    window = Window.partitionBy("company_id").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    return daily.withColumn("delta", F.sum("net").over(window))


def sector_stats(companies: DataFrame, deltas: DataFrame) -> DataFrame:
    """Companies, open roles, mean score, net delta and share of open roles per sector."""
    per_sector = (
        companies.withColumn("sector_name", published_sector())
        .join(deltas, "company_id", "left")
        .groupBy(F.col("sector_name").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("companies"), F.sum("open_job_count").alias("open_roles"),
            F.sum("hiring_score").alias("_score"), F.sum(F.coalesce("delta", F.lit(0))).alias("delta_30d"),
        )
    )
    total = F.sum("open_roles").over(Window.partitionBy())
    share = F.when(total > 0, round_half_up(F.col("open_roles") / total * 100)).otherwise(F.lit(0))
    return per_sector.select(
        slug(F.col("name")).alias("key"), "name", "companies", "open_roles",
        round_half_up(F.col("_score") / F.col("companies")).cast("long").alias("mean_score"),
        "delta_30d", share.cast("long").alias("share"),
    ).orderBy(F.col("open_roles").desc(), F.col("name"))


def newest_per_day(changes: DataFrame) -> DataFrame:
    """One opening and one closing per entity and UTC day, the newest event of each."""
    moves = changes.filter(F.col("change_type").isin(*ROLE_MOVES) & F.col("occurred_at").isNotNull())
    return (
        moves.groupBy(F.to_date("occurred_at").alias("day"), "entity_id", "change_type")
        .agg(F.max(F.struct("occurred_at", "id", "source_url")).alias("event"))
        .select("day", F.col("entity_id").alias("job_id"), "change_type", "event.source_url")
    )


def movement_evidence(companies: DataFrame, jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per counted opening or closing with its company and sector, computed once for all that read it."""
    owned = newest_per_day(changes).join(jobs.select("job_id", "company_id", "title", "canonical_url"), "job_id").join(companies.select("company_id", "slug", "name", "hiring_score", published_sector().alias("sector")), ["company_id"])
    return durable(owned)


def role_summaries(evidence: DataFrame, keys: list[str], shown: int = 3) -> DataFrame:
    """First titles of every movement, joined; the remainder is stated by its count."""
    # Evidence is a written table, not dealt by these keys: each task passes on a movement's first rows only.
    window = Window.partitionBy(*keys).orderBy(F.col("title").asc(), F.col("job_id").asc(), F.col("change_type"))
    first = evidence.select(*keys, "title", "job_id", "change_type").withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= shown)
    titles = [F.col("title"), *[F.lead("title", i).over(window) for i in range(1, shown)]]
    return first.withColumn("_titles", F.concat_ws(", ", *titles)).filter("_rank = 1").select(*keys, "_titles")


def distinct_of(evidence: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Openings, closings and events per key set and the number of its values of a column, in two sums."""
    opened, closed = F.col("change_type") == OPENED, F.col("change_type") == CLOSED
    each = evidence.groupBy(*keys, F.col(column).alias("_value")).agg(
        F.count_if(opened).alias("opened"), F.count_if(closed).alias("closed"), F.count(F.lit(1)).alias("evidence_count"))
    return each.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("opened", "closed", "evidence_count")], F.count("_value").alias(out))


def day_movements(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of one movement per key set. Evidence stays a table of its own."""
    def same(left: str, right: str) -> list[Column]:
        return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]

    counts = distinct_of(evidence, keys, "source_url", "source_url_count")
    if "company_id" in keys:
        counts = counts.withColumn("company_count", F.col("company_id").isNotNull().cast("long"))
    else:
        owners = distinct_of(evidence, keys, "company_id", "company_count").select(*keys, "company_count")
        counts = counts.alias("c").join(owners.alias("o"), same("c", "o")).select("c.*", "o.company_count")
    joined = counts.alias("c").join(role_summaries(evidence, keys).alias("t"), same("c", "t")).select("c.*", "t._titles")
    more = F.col("evidence_count") - 3
    shown = F.concat(
        F.col("_titles"),
        F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")),
    )
    both = (F.col("opened") > 0) & (F.col("closed") > 0)
    text = (
        F.when(both, F.concat(F.col("opened"), F.lit(" opened and "), F.col("closed"), F.lit(" closed: ")))
        .when(F.col("opened") > 0, F.concat(F.col("opened"), F.lit(" opened: ")))
        .otherwise(F.concat(F.col("closed"), F.lit(" closed: ")))
    )
    return joined.withColumns({
        "net": F.col("opened") - F.col("closed"),
        "type": F.when(both, "mixed").when(F.col("opened") > 0, "opened").otherwise("closed"),
        "description": F.concat(text, shown, F.lit(".")),
    }).drop("_titles")


def company_movement_id() -> Column:
    return F.concat(F.lit("movement:company:"), F.col("day").cast("string"), F.lit(":"), F.col("company_id").cast("string"))


def sector_movement_id() -> Column:
    return F.concat(F.lit("movement:sector:"), F.col("day").cast("string"), F.lit(":"), slug(F.col("sector")))


def evidence_lists(evidence: DataFrame, movement_id: Column) -> DataFrame:
    """The evidence and the distinct source URLs of movements as rows by movement id, however many one has."""
    events = evidence.select(
        movement_id.alias("id"), F.concat(F.lit("evidence:"), "change_type", F.lit(":"), F.col("job_id").cast("string")).alias("item"),
        F.col("title").alias("about"), F.col("source_url").alias("url"))
    sources = evidence.select(movement_id.alias("id"), F.lit("source").alias("item"), F.lit(None).cast("string").alias("about"), F.col("source_url").alias("url"))
    return events.unionByName(sources.distinct())


def _counted(number: Column, one: str, many: str) -> Column:
    return F.when(number == 1, F.lit(one)).otherwise(F.lit(many))


def company_day_movements(evidence: DataFrame) -> DataFrame:
    keys = ["day", "company_id", "slug", "name", "sector", "hiring_score"]
    moved = day_movements(evidence, keys)
    title = (
        F.when(F.col("closed") == 0, F.concat(F.lit(" opened "), F.col("opened"), F.lit(" "), _counted(F.col("opened"), "role", "roles")))
        .when(F.col("opened") == 0, F.concat(F.lit(" closed "), F.col("closed"), F.lit(" "), _counted(F.col("closed"), "role", "roles")))
        .otherwise(F.concat(F.lit(" changed "), F.col("evidence_count"), F.lit(" "), _counted(F.col("evidence_count"), "role", "roles")))
    )
    return moved.withColumns({
        "id": company_movement_id(),
        "group": F.lit("company"),
        "title": F.concat(F.col("name"), title),
    })


def sector_day_movements(evidence: DataFrame) -> DataFrame:
    moved = day_movements(evidence, ["day", "sector"])
    sector = F.col("sector")
    title = (
        F.when(F.col("closed") == 0, F.concat(F.col("opened"), F.lit(" new "), sector, F.lit(" "), _counted(F.col("opened"), "posting", "postings")))
        .when(F.col("opened") == 0, F.concat(F.col("closed"), F.lit(" "), sector, F.lit(" "), _counted(F.col("closed"), "posting", "postings"), F.lit(" closed")))
        .otherwise(F.concat(sector, F.lit(" hiring changed across "), F.col("evidence_count"), F.lit(" roles")))
    )
    return moved.withColumns({
        "id": sector_movement_id(),
        "group": F.lit("sector"),
        "title": title,
    })


def funding_movements(companies: DataFrame, changes: DataFrame) -> DataFrame:
    """Funding announcements as movements of their own, once per event id."""
    events = (
        changes.filter((F.col("change_type") == FUNDED) & (F.col("entity_type") == "company"))
        .filter(F.col("occurred_at").isNotNull())
        .groupBy("id").agg(F.max(F.struct("occurred_at", "entity_id", "title", "description", "source_url")).alias("e"))
        .select("id", "e.*").withColumnRenamed("entity_id", "company_id")
    )
    owned = events.join(companies.select("company_id", "slug", "name", "hiring_score", published_sector().alias("sector")), ["company_id"])
    zero = F.lit(0).cast("long")
    return owned.withColumns({
        "group": F.lit("company"), "type": F.lit("funding"), "day": F.to_date("occurred_at"),
        "opened": zero, "closed": zero, "net": zero, "evidence_count": F.lit(1).cast("long"),
        "source_url_count": F.lit(1).cast("long"), "company_count": F.lit(1).cast("long"),
    }).drop("occurred_at", "source_url")


def market_movements(
    companies: DataFrame, jobs: DataFrame, changes: DataFrame, group: str = "all",
    funding_with_sectors: bool = False,
) -> DataFrame:
    """Company, sector and funding movements by group option."""
    evidence = movement_evidence(companies, jobs, changes)
    parts = []
    if group in {"company", "all"}:
        parts.append(company_day_movements(evidence))
    if group in {"sector", "all"}:
        parts.append(sector_day_movements(evidence))
    if group != "sector" or funding_with_sectors:
        parts.append(funding_movements(companies, changes))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def by_weight(movements: DataFrame) -> DataFrame:
    return movements.orderBy(F.col("day").desc(), F.abs("net").desc(), F.col("id"))


def by_day(movements: DataFrame) -> DataFrame:
    return movements.orderBy(F.col("day").desc(), F.col("id"))


def movement_filter(
    movements: DataFrame, after: str | None = None, before: str | None = None, kind: str | None = None,
    company: str | None = None, sector: str | None = None, q: str | None = None,
) -> DataFrame:
    """Both time bounds are exclusive; a grouped movement happens at the end of its day."""
    if "occurred_at" in movements.columns:
        at = F.col("occurred_at")
    else:
        at = F.col("day").cast("timestamp") + F.expr("INTERVAL '86399.999' SECOND")
    found: list[Column] = []
    if after:
        found.append(at > F.lit(after).cast("timestamp"))
    if before:
        found.append(at < F.lit(before).cast("timestamp"))
    if kind:
        found.append(F.col("type") == kind)
    if sector:
        found.append(F.lower(F.trim("sector")) == sector.strip().lower())

    def any_has(columns: list[str], wanted: str) -> Column:
        text = wanted.strip().lower()
        return reduce(lambda a, b: a | b, [
            F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).contains(text), F.lit(False)) for c in columns
        ])

    if company:
        found.append(any_has(["company_id", "slug", "name"], company))
    if q:
        found.append(any_has(["title", "description", "sector", "name"], q))
    return reduce(lambda d, p: d.filter(p), found, movements)


def movement_type(opened: Column, closed: Column, evidence: Column, given: Column) -> Column:
    return (
        F.when(given == "updated", F.lit("updated")).when(evidence == 0, F.lit("funding"))
        .when((opened > 0) & (closed > 0), F.lit("mixed")).when(opened > 0, F.lit("opened"))
        .otherwise(F.lit("closed"))
    )


def raw_movements(companies: DataFrame, jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Every change as a movement. A role change whose job is unknown reads as funding."""
    job_side = jobs.select(
        F.col("job_id").alias("entity_id"), F.lit("job").alias("entity_type"),
        F.col("company_id").alias("_job_company"), F.col("title").alias("job_title"), F.col("canonical_url"),
    )
    with_jobs = changes.join(job_side, ["entity_type", "entity_id"], "left").withColumn(
        "company_id", F.coalesce("_job_company", "entity_id")
    )
    owned = with_jobs.join(companies.select("company_id", "slug", "hiring_score", published_sector().alias("sector"), F.lit(True).alias("_known")), ["company_id"], "left")
    known, kind, has_job = F.coalesce("_known", F.lit(False)), F.col("change_type"), F.col("_job_company").isNotNull()
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    opened = F.when(kind == OPENED, one).otherwise(zero)
    closed = F.when(kind == CLOSED, one).otherwise(zero)
    given = F.when(kind == OPENED, "opened").when(kind == CLOSED, "closed").when(kind == "job_updated", "updated").otherwise("funding")
    return owned.select(
        "id", F.to_date("occurred_at").alias("day"), "occurred_at", "title", "description",
        movement_type(opened, closed, F.when(has_job, 1).otherwise(0), given).alias("type"),
        F.when(known, F.col("sector")).otherwise("Other").alias("sector"),
        F.when(known, F.col("company_id")).alias("company_id"), "slug",
        opened.alias("opened"), closed.alias("closed"), (opened - closed).alias("net"),
        F.when(has_job, F.array(F.struct(
            F.col("entity_id").alias("id"), F.col("job_title").alias("title"), kind.alias("change_type"),
            "canonical_url", "source_url",
        ))).otherwise(F.array()).alias("jobs"),
        F.nullif(F.col("hiring_score"), F.lit(0).cast("long")).alias("hiring_score"),
        F.when(has_job, F.concat(F.lit("/job/"), F.col("entity_id").cast("string")))
        .when(known, F.concat(F.lit("/company/"), F.col("slug"))).otherwise(F.col("source_url")).alias("href"),
    )


def homepage_changes(
    companies: DataFrame, jobs: DataFrame, changes: DataFrame, since: str
) -> DataFrame:
    """Recent changes and all funding, each with its company found directly or through its job."""
    fresh = changes.filter((F.col("occurred_at") >= F.lit(since).cast("timestamp")) | (F.col("change_type") == FUNDED))
    job_side = jobs.select(
        F.col("job_id").alias("entity_id"), F.lit("job").alias("entity_type"), F.col("company_id").alias("_job_company")
    )
    keyed = fresh.join(job_side, ["entity_type", "entity_id"], "left").withColumn(
        "company_id", F.when(F.col("entity_type") == "company", F.col("entity_id")).otherwise(F.col("_job_company"))
    )
    names = companies.select("company_id", F.col("name").alias("company_name"))
    return keyed.drop("_job_company").join(names, ["company_id"], "left").orderBy(
        F.col("occurred_at").desc(), F.col("id").desc()
    )


def moved_jobs(jobs: DataFrame, changes: DataFrame, since: str) -> DataFrame:
    """Jobs that opened or closed since then."""
    moved = changes.filter(F.col("change_type").isin(*ROLE_MOVES)).filter(
        F.col("occurred_at") >= F.lit(since).cast("timestamp")
    )
    return jobs.join(moved.select(F.col("entity_id").alias("job_id")), "job_id", "left_semi").select(
        "job_id", "company_id", "title", "canonical_url"
    )


def latest_timestamp(companies: DataFrame, jobs: DataFrame, changes: DataFrame) -> DataFrame:
    parts = [
        companies.agg(F.max("last_verified_at").alias("at")), jobs.agg(F.max("last_verified_at").alias("at")),
        changes.agg(F.max("occurred_at").alias("at")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).agg(
        F.coalesce(F.max("at"), F.timestamp_seconds(F.lit(0))).alias("latest")
    )
