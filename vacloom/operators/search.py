"""Faceted job search: conjunctive predicates, twelve orders, pages and totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import role_family_name
from ..functions.text import employment_label
from ..plans.skew import rank_in_group, top_in_group

SORTS = [
    "signal", "title", "title_desc", "company", "company_desc", "sector", "dept", "loc",
    "comp_low", "comp_high", "recent", "oldest",
]
SEARCHED = ["title", "name", "role_family", "location", "employment_type", "sector", "industry"]


@dataclass(frozen=True)
class SearchSpec:
    q: str | None = None
    status: str = "verified_open"
    company: str | None = None
    sector: str | None = None
    role_family: str | None = None
    location: str | None = None
    remote_status: str | None = None
    employment_type: str | None = None
    provider: str | None = None
    investor: str | None = None
    new_since: str | None = None
    sort: str = "signal"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if self.status not in {"verified_open", "verified_closed", "all"}:
            raise ValueError("status must be verified_open, verified_closed, or all")
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit must be between 1 and 100 and offset not negative")


def same_text(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == value.lower()


def any_like(columns: list[str], needle: str) -> Column:
    """Case-insensitive substring over several columns; % and _ in the needle are wildcards."""
    pattern = f"%{needle.lower()}%"
    return reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(pattern) for c in columns])


def squashed(value: Column) -> Column:
    return F.lower(F.translate(value, "- _", ""))


def job_predicates(spec: SearchSpec) -> list[Column]:
    """Predicates that need only the jobs table, so they reach its scan."""
    found: list[Column] = []
    if spec.status != "all":
        found.append(F.col("status") == spec.status)
    if spec.role_family:
        found.append(same_text("role_family", spec.role_family))
    if spec.location:
        found.append(F.lower(F.col("location")).like(f"%{spec.location.lower()}%"))
    if spec.remote_status:
        found.append(same_text("remote_status", spec.remote_status))
    if spec.employment_type:
        found.append(squashed(F.col("employment_type")) == squashed(F.lit(spec.employment_type)))
    if spec.provider:
        found.append(F.lower(F.coalesce("provider", "source")) == spec.provider.lower())
    if spec.new_since:
        found.append(F.col("first_seen_at") >= F.lit(spec.new_since).cast("timestamp"))
    return found


def company_predicates(spec: SearchSpec) -> list[Column]:
    found: list[Column] = []
    if spec.company:
        wanted = spec.company.lower()
        found.append(
            (F.lower(F.col("company_id").cast("string")) == wanted)
            | same_text("slug", wanted) | same_text("name", wanted)
        )
    if spec.sector:
        found.append(same_text("sector", spec.sector))
    return found


def kept(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return reduce(lambda d, p: d.filter(p), predicates, df)


def held_by(companies: DataFrame, bridge: DataFrame, investors: DataFrame, name: str) -> DataFrame:
    """Companies with at least one relationship to the named investor."""
    wanted = investors.filter(same_text("name", name)).select("investor_id")
    owners = bridge.join(wanted, "investor_id", "left_semi").select("company_id")
    return companies.join(owners, "company_id", "left_semi")


def matching_jobs(
    jobs: DataFrame, companies: DataFrame, spec: SearchSpec,
    bridge: DataFrame | None = None, investors: DataFrame | None = None,
) -> DataFrame:
    """Jobs joined with their company that satisfy every given filter."""
    known = kept(companies, company_predicates(spec))
    if spec.investor:
        if bridge is None or investors is None:
            raise ValueError("investor filters need the bridge and investor tables")
        known = held_by(known, bridge, investors, spec.investor)
    columns = ["company_id", "slug", "name", "sector", "industry", "hiring_score"]
    joined = kept(jobs, job_predicates(spec)).join(known.select(*columns), ["company_id"])
    return joined.filter(any_like(SEARCHED, spec.q)) if spec.q else joined


def sort_columns(sort: str) -> list[Column]:
    """Order of every sort but the signal order, with the id as the last tie-break."""
    title, job = F.lower("title"), F.col("job_id").asc()
    paid = F.col("compensation").startswith("$")
    return {
        "title": [title.asc(), job],
        "title_desc": [title.desc(), job],
        "company": [F.lower("name").asc(), title.asc(), job],
        "company_desc": [F.lower("name").desc(), title.asc(), job],
        "sector": [F.lower("sector").asc(), title.asc(), job],
        "dept": [F.lower("role_family").asc(), title.asc(), job],
        "loc": [F.lower("location").asc(), title.asc(), job],
        "comp_low": [F.when(paid, F.col("compensation")).otherwise("~~~~").asc(), job],
        "comp_high": [F.when(paid, F.col("compensation")).otherwise("").desc(), job],
        "recent": [F.col("last_verified_at").desc(), job],
        "oldest": [F.col("last_verified_at").asc(), job],
    }[sort]


SIGNAL_ORDER = ["rn", "hiring_score", "name", "job_id"]


def signal_columns() -> list[Column]:
    return [
        F.col("rn").asc(), F.col("hiring_score").desc(), F.lower("name").asc(), F.col("job_id").asc(),
    ]


def in_company_order(by_title: bool = False) -> list[Column]:
    newest = [F.col("first_seen_at").desc()]
    return newest + ([F.col("title").asc()] if by_title else []) + [F.col("job_id").asc()]


ID_RANGE = 4096  # job ids of one instant that are ranked together


def signal_ranked(found: DataFrame, by_title: bool = False) -> DataFrame:
    """Rank of every job inside its company, in parts of one instant and a range of ids at most."""
    slices = [(F.to_date("first_seen_at"), True), (F.col("first_seen_at"), True)]
    if by_title:
        slices.append((F.col("title"), False))
    if dict(found.dtypes)["job_id"] in {"int", "bigint"}:
        slices.append((F.floor(F.col("job_id") / ID_RANGE), False))
    return rank_in_group(found, ["company_id"], in_company_order(by_title), slices)


def signal_page(found: DataFrame, need: int, by_title: bool = False) -> DataFrame:
    """Rows that can appear among the first ``need`` of the signal order, with their rank.

    A row on the page has at most ``need`` rows of its company in front of it.
    """
    first = top_in_group(found, ["company_id"], in_company_order(by_title), need)
    return first.withColumn("rn", F.col("_rank").cast("long")).drop("_rank")


def search_page(found: DataFrame, spec: SearchSpec, by_title: bool = False) -> DataFrame:
    """One page, numbered from the first match on."""
    need = spec.offset + spec.limit
    if spec.sort == "signal":
        ordered = signal_page(found, need, by_title).orderBy(*signal_columns())
    else:
        ordered = found.orderBy(*sort_columns(spec.sort))
    page = ordered.limit(need)
    order = signal_columns() if spec.sort == "signal" else sort_columns(spec.sort)
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return numbered.filter(F.col("position") > spec.offset)


def search_totals(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("company_id").alias("companies")
    )


def describe(jobs: DataFrame) -> DataFrame:
    """Description contract: trimmed text or null, availability and truncation flags."""
    text = F.nullif(F.trim("description"), F.lit(""))
    return jobs.withColumn("description", text).withColumns({
        "description_available": F.col("description").isNotNull(),
        "summary_truncated": F.col("description").isNull()
        | (F.length("summary") < F.length("description")),
    })


def facet_values(found: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """Distinct non-empty values per facet, one row each."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))
        for name, value in facets.items()
    ])
    flat = found.select(F.explode(pairs).alias("pair")).select("pair.facet", "pair.value")
    return flat.filter(F.coalesce("value", F.lit("")) != "").distinct()


def companies_with_lists(
    companies: DataFrame, bridge: DataFrame, investors: DataFrame, sources: DataFrame,
) -> DataFrame:
    """Companies with their investor names, enabled providers and first discovery.

    A company's lists hold distinct names of two small dimensions, so they stay bounded however
    many relationship rows there are: rows are made distinct before they are gathered.
    """
    names = (
        bridge.join(investors.select("investor_id", "name"), "investor_id")
        .select("company_id", "name").distinct()
        .groupBy("company_id").agg(F.sort_array(F.collect_list("name")).alias("investors"))
    )
    providers = (
        sources.filter("enabled").select("company_id", "provider").distinct()
        .groupBy("company_id").agg(F.sort_array(F.collect_list("provider")).alias("providers"))
    )
    first = sources.groupBy("company_id").agg(F.min("first_discovered_at").alias("first_discovered_at"))
    empty = F.array().cast("array<string>")
    return (
        companies.join(names, "company_id", "left").join(providers, "company_id", "left")
        .join(first, "company_id", "left")
        .withColumn("investors", F.coalesce("investors", empty))
        .withColumn("providers", F.coalesce("providers", empty))
    )


def company_view(
    companies: DataFrame, sector: str | None = None, min_score: int | None = None,
    min_confidence: int | None = None, investor: str | None = None, provider: str | None = None,
    q: str | None = None,
) -> DataFrame:
    """Companies filtered by sector, scores, list membership and text, best score first."""
    def has(column: str, value: str) -> Column:
        return F.exists(column, lambda item: F.lower(F.trim(item)) == value.strip().lower())

    found: list[Column] = []
    if sector:
        found.append(F.lower(F.trim("sector")) == sector.strip().lower())
    if min_score is not None:
        found.append(F.col("hiring_score") >= min_score)
    if min_confidence is not None:
        found.append(F.col("evidence_confidence") >= min_confidence)
    if investor:
        found.append(has("investors", investor))
    if provider:
        found.append(has("providers", provider))
    if q:
        wanted = q.strip().lower()
        found.append(reduce(lambda a, b: a | b, [
            F.lower(F.trim(c)).contains(wanted) for c in ("name", "sector", "industry", "stage")
        ]))
    return kept(companies, found).orderBy(F.col("hiring_score").desc(), F.col("company_id").asc())


def company_list(companies: DataFrame) -> DataFrame:
    return companies.orderBy(F.col("hiring_score").desc(), F.col("name").asc())


def company_table(companies: DataFrame, column: str, descending: bool = False) -> DataFrame:
    key = F.lower(column) if dict(companies.dtypes)[column] == "string" else F.col(column)
    return companies.orderBy(key.desc() if descending else key.asc(), F.col("company_id").asc())


def normalized_spec_columns(requests: DataFrame) -> DataFrame:
    """Published role family and employment type of requested filter values."""
    return requests.withColumns({
        "role_family": role_family_name(F.col("role_family")),
        "employment_type": employment_label(F.col("employment_type")),
    })
