"""URL parsing, canonical form, domains and hiring-board detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import let

URL_PATTERN = (
    "^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@\\s]*@)?([^/?#:\\s]+)(?::([0-9]*))?"
    "([^?#]*)(\\?[^#]*)?(#.*)?$"
)

# Query parameters that only record where a visitor came from.
TRACKING_PARAMETERS = ["gh_src", "lever-source", "source", "ref", "referrer", "trk"]

# An extract of the public suffix list, ICANN and private entries, for tests and as a
# list to start from. Operators take the rules as a table of any length (suffix_rules()).
PUBLIC_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp",
    "ne.jp", "or.jp", "co.kr", "co.in", "net.in", "org.in", "com.br", "com.mx", "com.ar",
    "com.cn", "com.hk", "com.sg", "com.tr", "com.tw", "co.za", "co.il", "com.ua",
    "github.io", "gitlab.io", "herokuapp.com", "vercel.app", "netlify.app", "pages.dev",
    "web.app", "firebaseapp.com", "blogspot.com", "workers.dev",
]


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), URL_PATTERN, group)


def is_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(URL_PATTERN), F.lit(False))


def is_https(url: Column) -> Column:
    return is_url(url) & (F.lower(_part(url, 1)) == "https")


def hostname(url: Column) -> Column:
    """Lower-case host, empty for anything that is not a URL."""
    return F.lower(_part(url, 2))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), "^www\\.", "")


def path_of(url: Column) -> Column:
    path = _part(url, 4)
    return F.when(is_url(url) & (path == ""), F.lit("/")).otherwise(path)


def _port(url: Column) -> Column:
    scheme, port = F.lower(_part(url, 1)), _part(url, 3)
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(default | (port == ""), F.lit("")).otherwise(F.concat(F.lit(":"), port))


def percent_encoded(value: Column) -> Column:
    """Blanks, quotes, brackets and non-ASCII characters of a URL as percent-encoded UTF-8."""
    unsafe = "[^\\x21\\x23-\\x3b\\x3d\\x3f-\\x5f\\x61-\\x7a\\x7c\\x7e]"
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    safe = F.transform(chars, lambda c: F.when(
        c.rlike(unsafe), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    ).otherwise(c))
    return F.when(value.rlike(unsafe), F.array_join(safe, "")).otherwise(value)


def normal_href(url: Column) -> Column:
    """What a browser shows for an absolute URL: lower host, default port and empty path fixed."""
    return F.concat(
        F.lower(_part(url, 1)), F.lit("://"), hostname(url), _port(url), path_of(url),
        _part(url, 5), _part(url, 6),
    )


def canonical_url(url: Column) -> Column:
    """Fragment, tracking parameters, default port and duplicate slashes removed; query sorted."""
    pairs = F.filter(F.split(F.regexp_replace(_part(url, 5), "^\\?", ""), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(
        F.substring_index(p, "=", 1).alias("key"), i.alias("at"),
        F.replace(
            F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))), F.lit("%20"), F.lit("+")
        ).alias("pair"),
    ))
    kept = F.filter(keyed, lambda s: ~(
        F.lower(s["key"]).startswith("utm_") | F.lower(s["key"]).isin(*TRACKING_PARAMETERS)
    ))
    query = F.array_join(F.transform(F.sort_array(kept), lambda s: s["pair"]), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/{2,}", "/"), "/$", "")
    tidy = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), hostname(url), _port(url),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(is_url(url), tidy).otherwise(F.trim(url))


def resolve_path(path: Column) -> Column:
    """Remove . and .. segments of an absolute path."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(parts, -1)
    stack = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(
            part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        ).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    joined = F.concat(F.lit("/"), F.array_join(stack, "/"))
    closes = last.isin(".", "..") & (F.size(stack) > 0)
    return F.when(closes, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link found on a page; null when it cannot be resolved."""
    link = F.trim(href)
    scheme = F.lower(_part(base, 1))
    origin = F.concat(scheme, F.lit("://"), hostname(base), _port(base))
    base_path = path_of(base)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    tail = F.regexp_extract(link, "^([^?#]*)(.*)$", 2)
    path = F.regexp_extract(link, "^([^?#]*)(.*)$", 1)
    dotted = path.rlike("(^|/)\\.\\.?(/|$)")

    def settled(full: Column) -> Column:
        return F.when(dotted, resolve_path(full)).otherwise(full)

    other_scheme = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return percent_encoded(
        F.when(link.rlike("(?i)^https?://"), F.when(is_url(link), normal_href(link)))
        .when(other_scheme | ~is_url(base), F.lit(None).cast("string"))
        .when(link.startswith("//"), normal_href(F.concat(scheme, F.lit(":"), link)))
        .when(link.startswith("/"), F.concat(origin, settled(path), tail))
        .when(link.startswith("?"), F.concat(origin, base_path, link))
        .otherwise(F.concat(origin, settled(F.concat(folder, path)), tail))
    )


def _host_of(value: Column) -> Column:
    text = F.lower(F.trim(value))
    host = F.when(text.contains("://"), hostname(text)).otherwise(
        F.regexp_extract(text, "^([^/?#:\\s]*)", 1)
    )
    return F.regexp_replace(host, "\\.$", "")


def host_suffixes(host: Column) -> Column:
    """Every suffix of a host, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, "\\.")
    return F.transform(
        labels, lambda label, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")
    )


VALID_HOST = "^(?=.{1,253}$)([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?\\.)+[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


def suffix_rules(lines: DataFrame, column: str = "value") -> DataFrame:
    """(suffix, kind) for the lines of a public suffix list: plain, wildcard (``*.ck``) or exception (``!www.ck``).

    Comments and blank lines give no rule; what follows white space on a line is no part of it.
    """
    rule = F.lower(F.regexp_extract(F.trim(F.col(column)), "^(\\S+)", 1))
    rows = lines.select(rule.alias("_rule")).filter((F.col("_rule") != "") & ~F.col("_rule").startswith("//"))
    kind = F.when(F.col("_rule").startswith("!"), "exception").when(F.col("_rule").startswith("*."), "wildcard").otherwise("plain")
    return rows.select(F.regexp_replace("_rule", "^(!|\\*\\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def registrable_domains(hosts: DataFrame, host: str, suffixes: DataFrame, out: str) -> DataFrame:
    """Public suffix plus one label for each host or URL, empty for addresses, bare names and suffixes.

    ``suffixes`` is a table of rules of any length, as suffix_rules() gives it (or a column ``suffix`` of a
    list's lines). Each distinct value is looked up once, by an equi-join of its ends with the rules; an
    exception wins over all others, then the longest rule; without a rule the last label is the suffix.
    """
    named = _domains_of(hosts.select(F.col(host)).distinct().withColumn("_clean", _host_of(F.col(host))), host, suffixes, out)
    return hosts.join(named, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")


def _domains_of(distinct: DataFrame, host: str, suffixes: DataFrame, out: str) -> DataFrame:
    """(_host, out) for distinct values of ``host`` with their bare host in ``_clean``."""
    rules = suffixes if "kind" in suffixes.columns else suffix_rules(suffixes, "suffix")

    def asked(end: Column, i: Column) -> Column:
        labels, tails = F.size(F.split(end, "\\.")), host_suffixes(F.col("_clean"))
        return F.array(
            F.struct(end.alias("suffix"), F.lit("plain").alias("kind"), labels.alias("n")),
            F.struct(end.alias("suffix"), F.lit("exception").alias("kind"), (labels - 1).alias("n")),
            # A wildcard stands for one label in front of its suffix.
            F.struct(F.get(tails, i + 1).alias("suffix"), F.lit("wildcard").alias("kind"), labels.alias("n")))

    ends = F.flatten(F.transform(host_suffixes(F.col("_clean")), asked))
    exploded = distinct.select(host, F.explode(ends).alias("_e")).select(host, "_e.*")
    chosen = exploded.join(rules.select("suffix", "kind").distinct(), ["suffix", "kind"]).groupBy(F.col(host).alias("_asked")).agg(
        F.max(F.struct((F.col("kind") == "exception").alias("exception"), "n")).alias("_rule"))
    labels = F.split("_clean", "\\.")
    n = F.coalesce(F.col("_rule.n"), F.lit(1))
    usable = (
        F.col("_clean").rlike(VALID_HOST)
        & ~F.col("_clean").rlike("^[0-9.]+$")
        & (F.size(labels) > n)
    )
    return distinct.join(chosen, F.col(host) == F.col("_asked"), "left").select(
        F.col(host).alias("_host"),
        F.when(usable, F.array_join(F.slice(labels, F.size(labels) - n, n + 1), ".")).otherwise("").alias(out),
    )


def with_domains(df: DataFrame, columns: dict[str, str], suffixes: DataFrame) -> DataFrame:
    """Add the registrable domain of each column under the name given, empty where there is none.

    ``suffixes`` is the public suffix list as a table. Hosts are looked up once each, however many addresses share one.
    """
    for column, out in columns.items():
        df = df.withColumn("_site", _host_of(F.col(column)))
        hosts = df.select(F.col("_site").alias("_asking")).distinct().withColumn("_clean", F.col("_asking"))
        named = _domains_of(hosts, "_asking", suffixes, "_found")
        df = df.join(named, F.col("_site").eqNullSafe(F.col("_host")), "left").withColumn(
            out, F.coalesce("_found", F.lit(""))).drop("_site", "_host", "_found")
    return df


def suffix_table(spark: SparkSession, more: list[str] | DataFrame | None = None) -> DataFrame:
    """The rules of the extract, and those of further lines of a list (a table has them in its column ``value``)."""
    own = [*PUBLIC_SUFFIXES, *(more if isinstance(more, list) else [])]
    lines = spark.createDataFrame([(s,) for s in own], "value string")
    return suffix_rules(lines.unionByName(more.select("value")) if isinstance(more, DataFrame) else lines)


def same_site(left: Column, right: Column) -> Column:
    a, b = bare_host(left), bare_host(right)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def career_fingerprint(provider: Column, board: Column, careers_url: Column) -> Column:
    left, middle = F.lower(F.trim(provider)), F.lower(F.trim(board))
    complete = (left != "") & (middle != "") & is_https(careers_url)
    return F.when(complete, F.concat_ws(":", left, middle, bare_host(careers_url))).otherwise("")


SAFE_BOARD = "^[A-Za-z0-9][A-Za-z0-9._-]{0,119}$"

# Public hiring boards keyed by the first path segment: host, provider, careers URL.
PATH_BOARDS = [
    (["jobs.ashbyhq.com"], "ashby", "https://jobs.ashbyhq.com/{}"),
    (["boards.greenhouse.io", "job-boards.greenhouse.io"], "greenhouse",
     "https://job-boards.greenhouse.io/{}"),
    (["jobs.lever.co"], "lever", "https://jobs.lever.co/{}"),
    (["apply.workable.com"], "workable", "https://apply.workable.com/{}/"),
    (["jobs.smartrecruiters.com", "careers.smartrecruiters.com"], "smartrecruiters",
     "https://careers.smartrecruiters.com/{}"),
]


def detect_board(url: Column) -> Column:
    """struct(provider, board_id, careers_url) for a link to a known hiring board, else null."""
    return let(F.struct(
        hostname(url).alias("host"), _part(url, 5).alias("query"),
        F.filter(F.split(_part(url, 4), "/"), lambda s: s != "").alias("segments"),
    ), _detected)


def _detected(parts: Column) -> Column:
    host, segments = parts["host"], parts["segments"]
    first = F.coalesce(F.try_url_decode(F.try_element_at(segments, F.lit(1))), F.lit(""))
    second = F.coalesce(F.try_element_at(segments, F.lit(2)), F.lit(""))
    embeds = F.regexp_extract_all(parts["query"], F.lit("[?&]for=([^&]*)"), F.lit(1))
    embedded = F.when(F.size(embeds) == 1, F.coalesce(F.try_url_decode(embeds[0]), F.lit(""))).otherwise("")
    is_embed = (F.try_element_at(segments, F.lit(1)) == "embed") & (second == "job_board")
    greenhouse = host.isin("boards.greenhouse.io", "job-boards.greenhouse.io")
    board = F.when(greenhouse & is_embed, embedded).otherwise(first)

    def found(provider: str, board_id: Column, careers: Column) -> Column:
        return F.struct(
            F.lit(provider).alias("provider"), board_id.alias("board_id"), careers.alias("careers_url")
        )

    result = F.lit(None).cast("struct<provider:string,board_id:string,careers_url:string>")
    recruitee = F.regexp_extract(host, "^([a-z0-9-]+)\\.recruitee\\.com$", 1)
    personio = host.rlike("^[a-z0-9-]+\\.jobs\\.personio\\.(de|com)$")
    chain = F.when(
        (recruitee != "") & ~recruitee.isin("www", "api", "app") & recruitee.rlike(SAFE_BOARD),
        found("recruitee", recruitee, F.concat(F.lit("https://"), recruitee, F.lit(".recruitee.com/"))),
    ).when(
        personio, found("personio", host, F.concat(F.lit("https://"), host, F.lit("/")))
    )
    for hosts, provider, template in PATH_BOARDS:
        before, after = template.split("{}")
        chain = chain.when(
            host.isin(*hosts) & board.rlike(SAFE_BOARD),
            found(provider, board, F.concat(F.lit(before), board, F.lit(after))),
        )
    return chain.otherwise(result)


def external_career_signals(url: Column) -> Column:
    """Sorted names of the career-like path parts a link carries."""
    path = F.lower(_part(url, 4))

    def when(pattern: str, name: str) -> Column:
        return F.when(path.rlike(f"(^|/){pattern}(/|$)"), F.lit(name))

    return F.sort_array(F.array_compact(F.array(
        when("careers?", "career_path"), when("jobs?", "jobs_path"),
        when("(?:openings?|vacancies)", "openings_path"), when("positions?", "positions_path"),
        when("(?:apply|application)", "apply_path"),
        when("(?:join-us|join-our-team|work-with-us)", "join_path"),
    )))


# Slugs too generic to identify one employer.
AMBIGUOUS_SLUGS = (
    "^(?:app|api|get|the|inc|team|labs|hq|io|ai|co|dev|web|new|now|one|go|up|my)$"
)


def slug_candidates(domain: Column, extra: Column | None = None) -> Column:
    label = F.lower(F.split(domain, "\\.")[0])
    values = F.concat(F.coalesce(extra, F.array().cast("array<string>")), F.array(label)) if extra is not None else F.array(label)
    clean = F.transform(values, lambda v: F.regexp_replace(F.lower(F.trim(v)), "[^a-z0-9-]+", ""))
    kept = F.filter(clean, lambda v: (F.length(v) >= 3) & ~v.rlike(AMBIGUOUS_SLUGS))
    return F.array_distinct(F.flatten(F.transform(
        kept,
        lambda v: F.when(v.contains("-"), F.array(v, F.replace(v, F.lit("-"), F.lit("")))).otherwise(F.array(v)),
    )))


def board_name_matches(board_name: Column, company_name: Column, board_slug: Column) -> Column:
    def simple(value: Column) -> Column:
        return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "")

    board, company, target = simple(board_name), simple(company_name), simple(board_slug)
    by_slug = board.startswith(target) | target.startswith(board)
    by_name = (company != "") & (board.startswith(company) | company.startswith(board))
    return (board != "") & (by_slug | by_name)


def identifier_suffix(identifier: Column) -> Column:
    """Part after the last colon of an identifier, null where there is none."""
    tail = F.element_at(F.split(identifier, ":"), -1)
    return F.when(identifier.contains(":") & (tail != ""), tail)


def url_variants(url: Column) -> Column:
    """A canonical URL and its form without an application suffix."""
    def variants(base: Column) -> Column:
        bare = F.regexp_replace(base, "(?i)/(?:apply|application)(\\?|$)", "$1")
        bare = F.regexp_replace(bare, "(?i)/c/new(\\?|$)", "$1")
        return F.array_distinct(F.array(base, F.regexp_replace(bare, "^([a-z]+://[^/?]+)(\\?|$)", "$1/$2")))

    return F.when(F.coalesce(url, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        let(canonical_url(url), variants)
    )
