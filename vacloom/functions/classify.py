"""Role, sector, eligibility and directory classification as ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, lookup
from .urls import host_suffixes

# Role families, the words that decide them in order, and accepted aliases.
ROLE_FAMILIES = [
    "People operations", "GTM", "Operations", "Data and research", "Engineering", "Product", "Other",
]
ROLE_RULES = [
    ("People operations", "people|talent|recruit|human resources|\\bhr\\b|workplace"),
    ("GTM", "sales|growth|gtm|marketing|capture|revenue"),
    ("Operations", "operations|chief of staff|strategy"),
    ("Data and research", "research|scient|eval|data|biostat"),
    ("Engineering", "engineer|developer|technical|software"),
    ("Product", "product|design"),
]
ROLE_ALIASES = {
    "people": "People operations",
    "people_operations": "People operations",
    "human_resources": "People operations",
    "hr": "People operations",
    "recruiter": "People operations",
    "recruiting": "People operations",
    "talent": "People operations",
    "workplace": "People operations",
    "gtm": "GTM",
    "sales": "GTM",
    "marketing": "GTM",
    "growth": "GTM",
    "revenue": "GTM",
    "operations": "Operations",
    "ops": "Operations",
    "chief_of_staff": "Operations",
    "data": "Data and research",
    "data_research": "Data and research",
    "data_and_research": "Data and research",
    "research": "Data and research",
    "scientist": "Data and research",
    "analytics": "Data and research",
    "analyst": "Data and research",
    "engineering": "Engineering",
    "engineer": "Engineering",
    "developer": "Engineering",
    "dev": "Engineering",
    "software": "Engineering",
    "product": "Product",
    "designer": "Product",
    "design": "Product",
    "other": "Other",
}

# Sectors and the words that decide them, specific before broad.
SECTOR_RULES = [
    ("Biotechnology & Life Sciences",
     "biotech(?:nology|nologies)?|bioscience[s]?|life science(?:s)?|genomic(?:s)?|genetic(?:s)?|"
     "drug discovery|synthetic biolog(?:y|ies)|bioinformatics|pharma(?:ceutical)?s?|therapeutics?|"
     "molecular biolog(?:y|ies)"),
    ("Healthcare",
     "health(?:care| tech|tech)?|digital health|medical|medicine|clinical|medtech|patient|hospital|"
     "diagnostic(?:s)?|telehealth|precision medicine|care delivery"),
    ("Financial Technology",
     "fintech|financial technology|financial|financial service(?:s)?|banking|payments?|"
     "payment processing|lending|credit|insur(?:ance|tech)|wealth(?:tech)?|invest(?:ment|ing)|trading|"
     "brokerage|securities|capital markets?|treasury|accounting|expense management|corporate cards?|"
     "business finance"),
    ("Education Technology",
     "education|edtech|learning|school|student|tutoring|university"),
    ("Cybersecurity",
     "cyber(?:security)?|information security|infosec|app(?:lication)? security|network security|"
     "identity(?: and access)?|iam|fraud detection|trust management|security"),
    ("Climate & Energy",
     "climate|climate tech|clean(?:tech| tech| technology| energy)|renewable(?: energy)?|carbon|"
     "emissions?|sustainab(?:ility|le)|decarbon(?:ization|isation)?|solar|wind energy|energy storage"),
    ("Logistics & Mobility",
     "logistics|mobility|transport(?:ation)?|supply chain|delivery|freight|fleet|warehouse|shipping|"
     "last mile|ev charging|autonomous vehicle(?:s)?"),
    ("Media & Entertainment",
     "media|entertainment|gaming|game studio|music|creator(?: economy)?|content|streaming|publishing|"
     "podcast(?:s)?|video"),
    ("Government & Defense",
     "government|defen[cs]e|public sector|civic|govtech|military"),
    ("Real Estate",
     "real estate|proptech|property tech|property management|construction|homebuilding|housing"),
    ("Human Resources",
     "human resources|hr tech|hrtech|people operations|people ops|recruit(?:ing|ment)?|"
     "talent management|workforce management|staffing|flexible workforce|background checks?|"
     "employee benefits?|people platform|payroll"),
    ("Legal Technology",
     "legal|law|law firm|legaltech|contract management|litigation|attorney|legal ops|compliance"),
    ("Developer Tools",
     "developer|devtools?|developer tools?|software engineering|programming|coding|code hosting|"
     "api platform|data (?:integration|pipeline|platform|warehouse|activation)|observability|"
     "documentation|cloud infrastructure|devops|secrets management|software development|design tools?|"
     "backend infrastructure|frontend"),
    ("Science & Research",
     "science|research|laborator(?:y|ies)|lab|discovery|quantum|materials science|scientific"),
    ("Hardware & Robotics",
     "hardware|robotics?|semiconductor(?:s)?|chips?|electronics|industrial tech|manufacturing|iot|"
     "internet of things|drones?|3d printing|aerospace|satellite|space technology"),
    ("Food & Commerce",
     "food|restaurant|grocery|retail|commerce|e commerce|ecommerce|marketplace|consumer goods|"
     "wholesale|shopping|hospitality"),
    ("Enterprise Software",
     "enterprise|saas|software as a service|b2b|business software|workflow|automation|crm|erp|"
     "vertical software|cloud software|operations software|infrastructure software|customer support|"
     "marketing automation|marketing software|sales software|collaboration software"),
    ("Artificial Intelligence",
     "artificial intelligence|machine learning|deep learning|generative ai|large language model|llm|"
     "foundation model|computer vision|natural language processing|ai agents?|autonomous software|"
     "ai native|machine intelligence|ai|ml"),
    ("Consumer",
     "consumer|social|travel|personal|lifestyle|wellness|dating|pets?|home services|sleep technology"),
]
PLACEHOLDER_INDUSTRY = (
    "(?i)^(?:other|unknown|not published|not specified|unspecified|n ?a|none|general)$"
)

# Wording that marks a posting as open to people in the United States.
US_SIGNAL = (
    "(?i)\\b(?:united states|usa|u\\.s\\.|us only|remote(?:\\s*[-/(]\\s*|\\s+)us|new york|"
    "san francisco|washington(?:,? dc)?|boston|seattle|austin|los angeles|chicago|denver|atlanta|"
    "miami|portland|philadelphia|palo alto|mountain view|brooklyn)\\b"
)
US_COUNTRY = "(?i)^(?:united states|us|usa)$"
GLOBAL_COUNTRY = "(?i)^(?:worldwide|global|anywhere)$"
GLOBAL_LOCATION = "(?i)^(?:remote|remote[- /](?:global|worldwide)|global|worldwide|anywhere)$"

# Titles and bodies of standing application pools, which are not openings.
POOL_TITLE = "(?i)(?:general|open|speculative|unsolicited)\\s+application|talent\\s+pool"
POOL_BODY = (
    "(?i)don't see an active job opening|do not see an active job opening|"
    "no active (?:role|opening|vacancy)"
)


def first_rule(value: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    chain = None
    for label, pattern in rules:
        hit = value.rlike(pattern)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(default)


def role_family(title: Column, department: Column | None = None) -> Column:
    """Role family from a title and department."""
    other = F.coalesce(department, F.lit("")) if department is not None else F.lit("")
    return first_rule(F.lower(F.concat(title, F.lit(" "), other)), ROLE_RULES, F.lit("Other"))


def role_family_name(value: Column) -> Column:
    """Published family for a name or alias, or null."""
    trimmed = F.lower(F.trim(value))
    return F.coalesce(
        lookup(trimmed, {family.lower(): family for family in ROLE_FAMILIES}),
        lookup(F.regexp_replace(trimmed, "[\\s-]+", "_"), ROLE_ALIASES),
    )


def sector_text(value: Column) -> Column:
    lowered = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, "[/_&+-]+", " "), "\\s+", " ")


def sector_label(value: Column) -> Column:
    """Sector of an already normalised label, or null."""
    rules = [(name, f"\\b(?:{words})\\b") for name, words in SECTOR_RULES]
    return first_rule(value, rules, F.lit(None).cast("string"))


def sector_or_null(
    industry: Column, name: Column | None = None, domain: Column | None = None,
    description: Column | None = None, override: Column | None = None,
) -> Column:
    """Sector the evidence supports; context counts only where the industry is a placeholder."""
    by_label = let(sector_text(industry), sector_label)
    context: list[Column] = [] if override is None else [override]
    named = [F.nullif(c, F.lit("")) for c in (name, domain) if c is not None]
    if named:
        context.append(let(sector_text(F.concat_ws(" ", *named)), sector_label))
    if description is not None:
        context.append(let(sector_text(description), sector_label))
    if not context:
        return by_label
    placeholder = let(sector_text(industry), lambda v: (v == "") | v.rlike(PLACEHOLDER_INDUSTRY))
    return F.coalesce(by_label, F.when(placeholder, F.coalesce(*context)))


def sector_of(industry: Column, *context: Column | None, **named: Column | None) -> Column:
    """Stable sector from the published industry, Other where nothing is known."""
    return F.coalesce(sector_or_null(industry, *context, **named), F.lit("Other"))


def kept_sector(supported: Column, stored: Column) -> Column:
    """A stored sector survives only where the evidence says nothing (null)."""
    return F.coalesce(supported, stored, F.lit("Other"))


def with_sector_override(df: DataFrame, domain: str, overrides: DataFrame, out: str = "override") -> DataFrame:
    """Attach the sector of the longest listed domain that equals or contains the row's domain.

    ``overrides`` has columns domain, sector. Host suffixes are exploded and equi-joined, so the
    list can be of any length.
    """
    clean = F.regexp_replace(
        F.split(F.regexp_replace(F.lower(F.trim(F.col(domain))), "^[a-z][a-z0-9+.-]*://", ""), "[/?#]")[0],
        "^www\\.", "",
    )
    keys = df.select(domain).distinct().select(domain, F.explode(host_suffixes(clean)).alias("_suffix"))
    listed = overrides.select(F.col("domain").alias("_suffix"), F.col("sector").alias("_sector"))
    best = keys.join(listed, ["_suffix"]).groupBy(domain).agg(
        F.max_by("_sector", F.struct(F.length("_suffix"), F.col("_suffix"))).alias(out)
    )
    return df.join(best, domain, "left")


def us_eligible(location: Column, remote: Column, country: Column | None = None) -> Column:
    place = F.trim(F.coalesce(location, F.lit("")))
    land = F.trim(F.coalesce(country, F.lit(""))) if country is not None else F.lit("")
    is_remote = F.coalesce(remote, F.lit(False))
    return (
        F.when(land.rlike(US_COUNTRY) | place.rlike(US_SIGNAL), F.lit(True))
        .when((land != "") & ~land.rlike(GLOBAL_COUNTRY), F.lit(False))
        .when(~is_remote, F.lit(False))
        .otherwise((place == "") | place.rlike(GLOBAL_LOCATION))
    )


def application_pool(title: Column, description: Column) -> Column:
    return title.rlike(POOL_TITLE) | description.rlike(POOL_BODY)


def directory_class(batch: Column) -> Column:
    """Recent directory batches are those of year 18 and later."""
    year = F.nullif(F.regexp_extract(F.coalesce(batch, F.lit("")), "([0-9]{2})$", 1), F.lit("")).cast("int")
    return F.when(year >= 18, F.lit("recent_yc_startup")).otherwise(F.lit("yc_startup"))


def failure_status(message: Column) -> Column:
    """Fetch status class of an error message."""
    return (
        F.when(message.rlike("(?i)\\b429\\b|rate.?limit"), F.lit("rate_limited"))
        .when(message.rlike("(?i)timeout|abort"), F.lit("timeout"))
        .when(message.rlike("(?i)incomplete payload|invalid|parse|non-(?:json|xml)"), F.lit("incomplete"))
        .when(message.rlike("(?i)\\bHTTP?\\s*[45]\\d\\d\\b|returned [45]\\d\\d"), F.lit("http_error"))
        .otherwise(F.lit("fetch_error"))
    )


def unsafe_reason(message: Column) -> Column:
    """Why a failure makes a snapshot unusable, or null for a plain failure."""
    return F.when(message.rlike("(?i)incomplete payload"), F.lit("incomplete_payload")).when(
        message.rlike("(?i)unexpected (?:end|token)|json parse|invalid json"), F.lit("parser_error")
    )


def transient_failure(message: Column, status: Column | None = None) -> Column:
    by_text = F.coalesce(message, F.lit("")).rlike(
        "(?i)timeout|timed out|abort|network|fetch failed|robots|429|5\\d\\d"
    )
    if status is None:
        return by_text
    by_code = status.isin(408, 425, 429) | (status >= 500)
    return F.when(status.isNotNull(), by_code).otherwise(by_text)


def probe_disposition(detected: Column, statuses: Column) -> Column:
    """What the set of page statuses of one probe says."""
    kinds = F.array_distinct(statuses)

    def only(kind: str) -> Column:
        return (F.size(kinds) == 1) & F.array_contains(kinds, kind)

    return (
        F.when(detected, F.lit("source_detected"))
        .when(F.array_contains(kinds, "fetched"), F.lit("no_source_on_reachable_pages"))
        .when(only("http_error"), F.lit("all_http_error"))
        .when(only("off_site_redirect"), F.lit("all_off_site_redirect"))
        .when(only("robots_or_network_error"), F.lit("all_robots_or_network_error"))
        .otherwise(F.lit("all_probe_pages_failed_mixed"))
    )
