"""Raw board payloads to postings: seven provider shapes, one normaliser, completeness of whole payloads.

Payloads are rows (source_id, provider, board_id, payload). JSON is read as variants, so a field of another
type than expected reads as absent; XML is read by the built-in reader. Nothing is collected: records are
exploded, grouped by their ids and checked per source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import application_pool, role_family, us_eligible
from ..functions.text import squeeze, summary

# Where each provider keeps its records.
RECORDS = {
    "ashby": ["$.jobs"], "greenhouse": ["$.jobs"], "lever": ["$"], "workable": ["$.jobs", "$.results"],
    "recruitee": ["$.offers"], "smartrecruiters": ["$"],
}
UNSTATED, NOWHERE = "See posting", "Location not specified"
# Titles and bodies that only invite applications.
OPEN_APPLICATION = "(?i)(?:general|open|speculative|unsolicited)\\s+application"
NO_OPENING = "(?i)don't see an active job opening|do not see an active job opening"
XML_OPEN_APPLICATION = "(?i)(?:general|open|speculative|unsolicited)\\s+application|\\binitiativbewerbung\\b"
XML_NO_OPENING = "(?i)\\bno active (?:role|opening|vacancy)\\b"
HTTPS = "^https://"
US_COUNTRY_CODE, US_COUNTRY_NAME = "(?i)^US$", "(?i)^(?:United States|US|USA)$"
US_LABEL = "(?i)\\b(?:United States|USA|U\\.S\\.|Remote[- /]US)\\b"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
UNPUBLISHED_STATES = ["draft", "closed", "archived", "internal", "confidential"]
POSITIONS = (
    "position array<struct<id: string, office: string, department: string, name: string, employmentType: string, schedule: string, "
    "createdAt: string, jobDescriptions: struct<jobDescription: array<struct<name: string, value: string>>>, "
    "salaryInformation: struct<min: string, max: string, currencyCode: string, currencySymbol: string, type: string>>>"
)


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, "^\\s+|\\s+$", "")


def node(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "variant")


def text(record: Column, path: str) -> Column:
    """A string field without outer space; empty for anything else."""
    leaf = node(record, path)
    return F.coalesce(F.when(F.schema_of_variant(leaf) == "STRING", _trimmed(F.try_variant_get(record, path, "string"))), F.lit(""))


def scalar(record: Column, path: str) -> Column:
    """A string or number field as text."""
    return F.coalesce(_trimmed(F.try_variant_get(record, path, "string")), F.lit(""))


def flag(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "boolean"), F.lit(False))


def first_of(*values: Column) -> Column:
    """The first value that is not empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def moment(record: Column, path: str) -> Column:
    """An instant given as text or as milliseconds."""
    number = F.when(F.schema_of_variant(node(record, path)) != "STRING", F.try_variant_get(record, path, "long"))
    return F.coalesce(F.try_to_timestamp(F.nullif(text(record, path), F.lit(""))), F.timestamp_millis(number))


def listed(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))


def joined(values: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v != "")), separator)


def span(currency: Column, low: Column, high: Column) -> Column:
    return _trimmed(F.concat(currency, F.lit(" "), low, F.lit("–"), high))


def once(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keys`` and ``columns``, each column computed once a row.

    They pass through a generator: a filter on them stays behind it, where it would otherwise repeat the reading
    of a field at each place that names it.
    """
    read = F.explode(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))).alias("_read")
    return rows.select(*keys, read).select(*keys, "_read.*")


def records(payloads: DataFrame, provider: str) -> DataFrame:
    """One row per record of a provider's payloads, in order; payloads that cannot be read give none."""
    body = F.try_parse_json("payload")
    found = F.coalesce(*[F.try_variant_get(body, path, "array<variant>") for path in RECORDS[provider]])
    own = payloads.filter(F.col("provider") == provider)
    return own.select("source_id", "board_id", F.posexplode(found).alias("position", "job"))


def _posting(record: str = "job") -> dict[str, dict[str, Column]]:
    """What each JSON shape says of a posting, column by column; ``kept`` is false for rows that are no postings."""
    job = F.col(record)
    metadata = F.filter(listed(job, "$.metadata"), lambda m: text(m, "$.name").rlike("(?i)employment.?type"))
    sections = F.array(*[text(job, f"$.jobAd.sections.{s}.text") for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")])
    place = F.transform(listed(job, "$.locations"), lambda p: F.array(*[text(p, f"$.{k}") for k in ("name", "city", "state", "country")]))
    own_place = F.array(*[text(job, f"$.{k}") for k in ("location", "city", "state_name", "country")])
    places = F.filter(F.flatten(place), lambda v: v != "")
    ad = squeeze(F.regexp_replace(F.concat(text(job, "$.description"), F.lit(" "), text(job, "$.requirements")), "<[^>]*>", " "))
    country = F.lower(text(job, "$.location.country"))
    address = F.when(text(job, "$.location.fullLocation") != "", F.array(text(job, "$.location.fullLocation"))).otherwise(
        F.array(text(job, "$.location.city"), text(job, "$.location.region")))
    named = F.exists(address, lambda v: v.rlike("(?i)united states|\\busa?\\b"))
    pay = {k: scalar(job, f"$.salary.{k}") for k in ("min", "max")}
    band = {k: scalar(job, f"$.compensation.{k}") for k in ("min", "max")}
    period = F.lower(text(job, "$.compensation.period"))
    always = F.lit(True)
    return {
        "ashby": {
            "external_id": scalar(job, "$.id"), "title": text(job, "$.title"), "department": text(job, "$.department"),
            "location": text(job, "$.location"), "remote": flag(job, "$.isRemote"), "workplace": text(job, "$.workplaceType"),
            "employment_type": text(job, "$.employmentType"), "compensation": text(job, "$.compensation.compensationTierSummary"),
            "url": text(job, "$.jobUrl"), "published_at": moment(job, "$.publishedAt"), "body": text(job, "$.descriptionPlain"),
            "kept": F.coalesce(F.try_variant_get(job, "$.isListed", "boolean"), always),
        },
        "greenhouse": {
            "external_id": scalar(job, "$.id"), "title": text(job, "$.title"),
            "department": F.array_join(F.filter(F.transform(listed(job, "$.departments"), lambda d: text(d, "$.name")), lambda v: v != ""), ", "),
            "location": text(job, "$.location.name"), "remote": text(job, "$.location.name").rlike("(?i)remote"), "workplace": F.lit(""),
            "employment_type": F.coalesce(text(F.get(metadata, F.lit(0)), "$.value"), F.lit("")),
            "compensation": text(job, "$.pay_input_ranges.formatted_pay_range"), "url": text(job, "$.absolute_url"),
            "published_at": moment(job, "$.updated_at"), "body": text(job, "$.content"), "kept": always,
        },
        "lever": {
            "external_id": scalar(job, "$.id"), "title": text(job, "$.text"),
            "department": first_of(text(job, "$.categories.department"), text(job, "$.categories.team")),
            "location": text(job, "$.categories.location"), "remote": F.lower(text(job, "$.workplaceType")) == "remote",
            "workplace": text(job, "$.workplaceType"), "employment_type": text(job, "$.categories.commitment"),
            "compensation": F.when(text(job, "$.salaryRange.min") != "", F.concat(
                scalar(job, "$.salaryRange.currency"), F.lit(" "), scalar(job, "$.salaryRange.min"), F.lit("–"), scalar(job, "$.salaryRange.max"))).otherwise(""),
            "url": first_of(text(job, "$.hostedUrl"), text(job, "$.applyUrl")), "published_at": moment(job, "$.createdAt"),
            "body": first_of(text(job, "$.descriptionPlain"), text(job, "$.description")), "kept": always,
        },
        "recruitee": {
            "external_id": first_of(scalar(job, "$.id"), scalar(job, "$.guid")), "title": text(job, "$.title"), "department": text(job, "$.department"),
            "location": joined(F.when(F.size(places) > 0, places).otherwise(own_place)), "remote": flag(job, "$.remote"),
            "workplace": F.when(flag(job, "$.hybrid"), "Hybrid").when(flag(job, "$.on_site"), "On-site").otherwise(""),
            "employment_type": text(job, "$.employment_type_code"),
            "compensation": F.when(first_of(*pay.values()) == "", "").otherwise(
                span(text(job, "$.salary.currency"), first_of(pay["min"], pay["max"]), first_of(pay["max"], pay["min"]))),
            "url": text(job, "$.careers_url"), "published_at": F.coalesce(moment(job, "$.published_at"), moment(job, "$.created_at")), "body": ad,
            "kept": (F.lower(text(job, "$.status")) == "published") & ~text(job, "$.title").rlike(OPEN_APPLICATION) & ~ad.rlike(NO_OPENING),
        },
        "smartrecruiters": {
            "external_id": scalar(job, "$.id"), "title": text(job, "$.name"), "department": text(job, "$.department.label"),
            "location": joined(F.when((country == "us") & ~named, F.concat(address, F.array(F.lit("United States")))).otherwise(address)),
            "remote": flag(job, "$.location.remote"),
            "workplace": F.when(flag(job, "$.location.hybrid"), "Hybrid").when(flag(job, "$.location.remote"), "Remote").otherwise("On-site"),
            "employment_type": text(job, "$.typeOfEmployment.label"),
            "compensation": F.when(first_of(*band.values()) == "", "").otherwise(F.concat(
                span(F.upper(text(job, "$.compensation.currency")), first_of(band["min"], band["max"]), first_of(band["max"], band["min"])),
                F.when(period != "", F.concat(F.lit(" per "), period)).otherwise(""))),
            "url": text(job, "$.postingUrl"), "published_at": moment(job, "$.releasedDate"),
            "body": F.array_join(F.filter(sections, lambda s: s != ""), " "),
            "kept": flag(job, "$.active") & (text(job, "$.visibility") == "PUBLIC")
            & ~application_pool(text(job, "$.name"), squeeze(F.regexp_replace(F.array_join(sections, " "), "<[^>]*>", " "))),
        },
    }


FIELDS = ["external_id", "title", "department", "location", "remote", "workplace", "employment_type", "compensation", "url", "published_at", "body"]


def _grouped_records(payloads: DataFrame) -> DataFrame:
    """Records that come once per location: the first of each id, with the locations of all (US ones if there are any)."""
    job = F.col("job")
    parts = ("location_str", "city", "region", "state", "country", "country_name", "countryCode", "country_code")
    stated = lambda p: F.struct(*[text(p, f"$.{k}").alias(k) for k in parts])
    own = F.col("own")

    def place(p: Column) -> Column:
        country = first_of(p["country"], p["country_name"], own["country"])
        code = first_of(p["countryCode"], p["country_code"], own["countryCode"], own["country_code"])
        label = first_of(p["location_str"], F.array_join(F.filter(F.array(
            first_of(p["city"], own["city"]), first_of(p["region"], p["state"], own["region"], own["state"]), country,
        ), lambda v: v != ""), ", "))
        return F.struct(label.alias("label"), country.alias("country"), code.alias("code"))

    def judged(p: Column) -> Column:
        us = p["code"].rlike(US_COUNTRY_CODE) | p["country"].rlike(US_COUNTRY_NAME) | p["label"].rlike(US_LABEL)
        return F.struct(p["label"].alias("label"), us.alias("us"))

    inner = F.when(node(job, "$.location").isNotNull(), F.array(node(job, "$.location"))).otherwise(F.array().cast("array<variant>"))
    remote = flag(job, "$.remote") | flag(job, "$.telecommuting") | flag(job, "$.location.telecommuting") | text(job, "$.location.location_str").rlike("(?i)remote")
    said = {
        "title": text(job, "$.title"), "department": text(job, "$.department"),
        "workplace": first_of(text(job, "$.location.workplace_type"), text(job, "$.workplace")), "employment_type": text(job, "$.employment_type"),
        "compensation": F.when(scalar(job, "$.salary.salary_from") != "", F.concat(
            F.upper(scalar(job, "$.salary.salary_currency")), F.lit(" "), scalar(job, "$.salary.salary_from"), F.lit("–"),
            first_of(scalar(job, "$.salary.salary_to"), scalar(job, "$.salary.salary_from")))).otherwise(""),
        "url": first_of(text(job, "$.url"), text(job, "$.shortlink")),
        "published_at": F.coalesce(moment(job, "$.published_on"), moment(job, "$.created_at")),
    }
    read, keys = records(payloads, "workable"), ["source_id", "board_id", "position"]
    external = first_of(scalar(job, "$.shortcode"), scalar(job, "$.id"))
    rows = once(read, keys, {
        "external_id": external, "said": F.struct(*[v.alias(k) for k, v in said.items()]), "remote": remote,
        "body": F.nullif(text(job, "$.description"), F.lit("")),
    }).filter("external_id <> ''")
    given = once(read, keys, {
        "external_id": external, "own": stated(job), "given": F.transform(F.concat(inner, listed(job, "$.locations")), stated),
    }).filter("external_id <> ''")
    known = lambda p: (p["label"] != "") | (p["country"] != "") | (p["code"] != "")
    given = once(given, [*keys, "external_id"], {
        "theirs": F.filter(F.transform("given", place), known), "its": F.filter(F.array(place(own)), known)})
    places = F.when(F.size("theirs") > 0, F.col("theirs")).otherwise(F.col("its"))
    given = given.select(*keys, "external_id", F.transform(places, judged).alias("places"))
    # A group is one posting's locations; only distinct labels are gathered, in the order they come.
    spots = given.select("source_id", "external_id", "position", F.posexplode("places").alias("i", "p")).groupBy("source_id", "external_id", "p.label", "p.us").agg(
        F.min(F.struct("position", "i")).alias("at")).filter("label <> ''")
    labels = spots.groupBy("source_id", "external_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "label", "us"))).alias("all"))
    some_us = F.filter("all", lambda p: p["us"])
    shown = F.transform(F.when(F.size(some_us) > 0, some_us).otherwise(F.col("all")), lambda p: p["label"])
    labels = labels.select("source_id", "external_id", F.array_join(F.array_distinct(shown), "; ").alias("location"))
    firsts = rows.groupBy("source_id", "board_id", "external_id").agg(
        F.min_by("said", "position").alias("said"), F.max("remote").alias("remote"),
        F.min_by("body", F.when(F.col("body").isNotNull(), F.col("position"))).alias("body"))
    out = firsts.join(labels, ["source_id", "external_id"], "left").select(
        "source_id", "board_id", "external_id", "said.*", "remote", F.coalesce("location", F.lit("")).alias("location"), F.coalesce("body", F.lit("")).alias("body"))
    plain = squeeze(F.regexp_replace("body", "<[^>]*>", " "))
    return out.filter(~application_pool(F.col("title"), plain)).select("source_id", "board_id", *FIELDS)


def _positions(payloads: DataFrame) -> DataFrame:
    own = payloads.filter(F.col("provider") == "personio").withColumn("doc", F.from_xml("payload", POSITIONS, {"mode": "PERMISSIVE"}))
    return own.select("source_id", "board_id", "payload", F.posexplode("doc.position").alias("position", "p"))


def _xml_postings(payloads: DataFrame) -> DataFrame:
    def said(name: str) -> Column:
        return F.coalesce(_trimmed(F.col(f"p.{name}")), F.lit(""))

    low, high = said("salaryInformation.min"), said("salaryInformation.max")
    currency = first_of(said("salaryInformation.currencyCode"), said("salaryInformation.currencySymbol"))
    period = F.regexp_replace(said("salaryInformation.type"), "(?i)ly$", "")
    body = F.array_join(F.transform("p.jobDescriptions.jobDescription", lambda d: _trimmed(d["value"])), " ")
    plain = squeeze(F.regexp_replace(body, "<[^>]*>", " "))
    pay = F.when(first_of(low, high) == "", "").otherwise(F.concat(
        span(currency, first_of(low, high), first_of(high, low)), F.when(period != "", F.concat(F.lit(" per "), period)).otherwise("")))
    rows = once(_positions(payloads), ["source_id", "board_id"], {
        "external_id": said("id"), "title": said("name"), "department": said("department"),
        "location": said("office"), "remote": said("office").rlike("(?i)\\bremote\\b|home.?office"), "workplace": F.lit(""),
        "employment_type": F.array_join(F.filter(F.array(said("schedule"), said("employmentType")), lambda v: v != ""), " "),
        "compensation": pay, "url": F.concat(F.lit("https://"), F.lower(F.trim("board_id")), F.lit("/job/"), said("id"), F.lit("?language=en")),
        "published_at": F.try_to_timestamp(F.nullif(said("createdAt"), F.lit(""))), "body": body,
        "kept": ~said("name").rlike(XML_OPEN_APPLICATION) & ~plain.rlike(XML_NO_OPENING),
    })
    return rows.filter("kept").drop("kept")


def stated_postings(payloads: DataFrame, provider: str) -> DataFrame:
    """What a provider's payloads say of each posting, before normalisation."""
    if provider == "personio":
        return _xml_postings(payloads)
    if provider == "workable":
        return _grouped_records(payloads)
    said = _posting()[provider]
    rows = once(records(payloads, provider), ["source_id", "board_id"], {c: said[c] for c in [*FIELDS, "kept"]})
    return rows.filter("kept").drop("kept")


def normalized(rows: DataFrame) -> DataFrame:
    """Postings with an id, a title and a secure link that may be filled from the US, with default labels."""
    usable = (F.col("title") != "") & (F.col("external_id") != "") & F.col("url").rlike(HTTPS)
    plain = squeeze(F.regexp_replace("body", "<[^>]*>", " "))
    found = rows.filter(usable).filter(us_eligible(F.when(F.col("location") == "", NOWHERE).otherwise(F.col("location")), F.col("remote")))
    return found.select(
        "source_id", "external_id", "title", role_family(F.col("title"), F.col("department")).alias("role_family"),
        first_of(F.col("location"), F.lit(NOWHERE)).alias("location"),
        F.when(F.col("remote"), "Remote").otherwise(first_of(F.col("workplace"), F.lit(UNSTATED))).alias("remote_status"),
        first_of(F.col("employment_type"), F.lit(UNSTATED)).alias("employment_type"), first_of(F.col("compensation"), F.lit(UNSTATED)).alias("compensation"),
        F.col("url").alias("canonical_url"), "published_at", plain.alias("description"), summary(F.col("title"), plain).alias("summary"))


def conflicting_sources(rows: DataFrame) -> DataFrame:
    """Sources in which one id stands for different postings."""
    hashed = rows.select("source_id", "external_id", F.xxhash64(*[c for c in rows.columns if c not in {"source_id", "external_id"}]).alias("h"))
    spread = hashed.groupBy("source_id", "external_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return spread.filter("low <> high").select("source_id").distinct()


def postings(payloads: DataFrame, provider: str) -> DataFrame:
    """Normalised postings of a provider; repeats once, none of a source whose ids conflict."""
    rows = normalized(stated_postings(payloads, provider))
    # Payloads are read once: a source's postings meet in one exchange, where its ids are compared as well.
    own, same = Window.partitionBy("source_id"), Window.partitionBy("source_id", "external_id")
    hashed = rows.withColumn("_h", F.xxhash64(*[c for c in rows.columns if c not in {"source_id", "external_id"}])).repartition("source_id")
    spread = hashed.withColumn("_twofold", F.min("_h").over(same) != F.max("_h").over(same))
    sound = F.col("source_id").isNull() | ~F.max("_twofold").over(own)
    return spread.withColumn("_sound", sound).filter("_sound").select(*rows.columns).distinct()


def _record_rules() -> dict[str, Column]:
    job = F.col("job")
    secure = lambda value: value.rlike(HTTPS)
    somewhere = reduce(lambda a, b: a | b, [text(job, p) != "" for p in ("$.city", "$.region", "$.state", "$.country", "$.countryCode", "$.country_code")])
    somewhere = somewhere | (node(job, "$.location").isNotNull()) | (F.size(listed(job, "$.locations")) > 0)
    return {
        "ashby": (text(job, "$.id") != "") & (text(job, "$.title") != "") & secure(text(job, "$.jobUrl")),
        "greenhouse": (scalar(job, "$.id") != "") & (text(job, "$.title") != "") & secure(text(job, "$.absolute_url")),
        "lever": (text(job, "$.id") != "") & (text(job, "$.text") != "") & secure(first_of(text(job, "$.hostedUrl"), text(job, "$.applyUrl"))),
        "recruitee": (first_of(scalar(job, "$.id"), scalar(job, "$.guid")) != "") & (text(job, "$.title") != "")
        & (F.lower(text(job, "$.status")) == "published") & secure(text(job, "$.careers_url")) & secure(text(job, "$.careers_apply_url")),
        "smartrecruiters": (text(job, "$.id") != "") & (text(job, "$.name") != "") & flag(job, "$.active") & (text(job, "$.visibility") == "PUBLIC")
        & secure(text(job, "$.postingUrl")) & secure(text(job, "$.applyUrl")) & (text(job, "$.jobAd.sections.jobDescription.text") != ""),
        "workable": (text(job, "$.title") != "") & ~F.lower(text(job, "$.state")).isin(UNPUBLISHED_STATES)
        & F.coalesce(moment(job, "$.published_on"), moment(job, "$.created_at")).isNotNull() & (text(job, "$.description") != "")
        & (somewhere | flag(job, "$.remote") | flag(job, "$.telecommuting")),
    }


def _grouped_faults(rows: DataFrame, rule: Column) -> DataFrame:
    """Sources of records that come once per location: a record breaks the rule, its links lead elsewhere, or ids conflict."""
    job = F.col("job")
    said = once(rows, ["source_id"], {
        "sound": rule, "external_id": first_of(scalar(job, "$.shortcode"), scalar(job, "$.id")), "t": text(job, "$.title"),
        "u": first_of(text(job, "$.url"), text(job, "$.shortlink")), "a": text(job, "$.application_url"),
    })
    site = "(?i)^https://(?:[a-z0-9-]+\\.)*workable\\.com(?::443)?/"

    def path(link: str) -> Column:
        return F.filter(F.split(F.lower(F.regexp_extract(link, "^https://[^/?#]+/([^?#]*)", 1)), "/"), lambda p: p != "")

    def after(parts: Column) -> Column:
        """Path parts from the job marker on, in lower case."""
        return F.slice(parts, F.greatest(F.array_position(parts, "j"), F.lit(1)), F.greatest(F.size(parts), F.lit(1)))

    links = once(said, said.columns, {"u_path": path("u"), "a_path": path("a")})
    links = once(links, said.columns, {"u_path": after(F.col("u_path")), "a_path": after(F.col("a_path"))})
    shortcode = F.lower("external_id")

    def leads(link: str) -> Column:
        parts = F.col(f"{link}_path")
        return F.col(link).rlike(site) & F.get(parts, F.lit(0)).eqNullSafe("j") & F.get(parts, F.lit(1)).eqNullSafe(shortcode)

    sound = F.col("sound") & (shortcode != "") & leads("u") & leads("a") & F.array_contains("a_path", "apply")
    judged = links.select("source_id", "external_id", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("t", "u", "a").alias("h"))
    ids = judged.groupBy("source_id", "external_id").agg(F.min("sound").alias("sound"), F.min("h").alias("low"), F.max("h").alias("high"))
    return ids.filter("NOT sound OR low <> high").select("source_id")


def completeness(payloads: DataFrame) -> DataFrame:
    """source_id, complete: whether every record of a payload can be relied on; an empty list can."""
    parts = []
    for provider, rule in _record_rules().items():
        body = F.try_parse_json("payload")
        readable = F.coalesce(*[F.try_variant_get(body, p, "array<variant>") for p in RECORDS[provider]]).isNotNull()
        own = payloads.filter(F.col("provider") == provider).select("source_id", readable.alias("readable"))
        rows = records(payloads, provider)
        if provider == "workable":
            bad = _grouped_faults(rows, rule)
        else:
            bad = once(rows, ["source_id"], {"sound": F.coalesce(rule, F.lit(False))}).filter("NOT sound").select("source_id")
        parts.append(own.join(bad.distinct().withColumn("bad", F.lit(True)), "source_id", "left").select(
            "source_id", (F.col("readable") & F.col("bad").isNull()).alias("complete")))
    p = F.col("p")
    told = lambda c: F.coalesce(_trimmed(c), F.lit("")) != ""
    described = F.coalesce(F.size("p.jobDescriptions.jobDescription") > 0, F.lit(False)) & F.coalesce(
        F.forall("p.jobDescriptions.jobDescription", lambda d: told(d["name"]) & told(d["value"])), F.lit(False))
    fair = F.coalesce(p["id"].rlike("^\\s*[0-9]+\\s*$"), F.lit(False)) & told(p["office"]) & told(p["name"]) & described
    positions = once(_positions(payloads), ["source_id"], {"id": _trimmed(p["id"]), "fair": fair})
    ids = positions.groupBy("source_id", "id").agg(F.min("fair").alias("fair"), F.count(F.lit(1)).alias("n"))
    wrong = ids.filter("NOT fair OR n > 1").select("source_id")
    own = payloads.filter(F.col("provider") == "personio")
    formed = F.regexp_replace("payload", "(?s)<!--.*?-->|<\\?.*?\\?>|<!\\[CDATA\\[.*?\\]\\]>", "")
    tags = lambda pattern: F.size(F.regexp_extract_all(formed, F.lit(pattern), F.lit(0)))
    rooted = _trimmed(formed).rlike("(?s)^<workzag-jobs>.*</workzag-jobs>$|^<workzag-jobs/>$") & (tags("<position>") == tags("</position>"))
    parts.append(own.join(wrong.distinct().withColumn("bad", F.lit(True)), "source_id", "left").select(
        "source_id", (F.coalesce(rooted, F.lit(False)) & F.col("bad").isNull()).alias("complete")))
    return reduce(DataFrame.unionAll, parts)


def assembled_pages(pages: DataFrame) -> DataFrame:
    """source_id, complete: offsets follow each other from 0, the total never changes and is reached.

    ``pages``: source_id, page_start, page_limit, total, items (their number).
    """
    order = Window.partitionBy("source_id").orderBy("page_start")
    due = F.coalesce(F.sum("items").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fair = (F.col("page_start") == due) & F.col("page_limit").between(1, 100) & (F.col("items") <= F.col("page_limit")) & (F.col("total") >= 0)
    more = (F.col("items") > 0) | (F.col("page_start") == 0)
    rows = pages.withColumn("fair", F.coalesce(fair & more, F.lit(False)))
    return rows.groupBy("source_id").agg(
        F.min("fair").alias("fair"), F.min("total").alias("low"), F.max("total").alias("high"), F.sum("items").alias("got")
    ).select("source_id", (F.col("fair") & F.col("low").eqNullSafe(F.col("high")) & F.col("got").eqNullSafe(F.col("high"))).alias("complete"))


def reconciled_details(items: DataFrame, details: DataFrame) -> DataFrame:
    """source_id, complete: every listed posting has the detail that belongs to it.

    ``items``: source_id, id, uuid, name. ``details`` has these and active, visibility, description.
    """
    given = details.select("source_id", "id", *[F.col(c).alias(f"d_{c}") for c in ("uuid", "name", "active", "visibility", "description")])
    fits = (
        (F.lower("uuid") == F.lower("d_uuid")) & (F.col("name") == F.col("d_name")) & F.col("uuid").rlike(UUID) & F.col("d_active")
        & (F.col("d_visibility") == "PUBLIC") & (_trimmed(F.col("d_description")) != "")
    )
    rows = items.join(given, ["source_id", "id"], "full").withColumn("fits", F.coalesce(fits, F.lit(False)))
    return rows.groupBy("source_id").agg(F.min("fits").alias("complete"))
