from pyspark.sql import functions as F

from vacloom.functions import scoring, text, urls
from vacloom.operators import audit, discovery, funding, snapshots
from vacloom.plans.skew import plan_text, rank_in_group, top_in_group


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_canonical_url(spark):
    link = F.lit("https://APPLY.example.com:443/jobs/42/?utm_source=x#apply")
    assert one(spark, urls.canonical_url(link)) == "https://apply.example.com/jobs/42"


def test_registrable_domain(spark):
    cases = {
        "jobs.example.co.uk": "example.co.uk", "careers.acme.github.io": "acme.github.io", "127.0.0.1": "", "localhost": "",
        "https://www.a.example.com/x": "example.com", "co.uk": "",
    }
    hosts = spark.createDataFrame([(value,) for value in cases], "host string")
    found = urls.registrable_domains(hosts, "host", urls.suffix_table(spark), "domain")
    assert {r["host"]: r["domain"] for r in found.collect()} == cases


def test_employment_labels(spark):
    for value, expected in {"FullTime": "Full time", "contractor": "Contract", "volunteer": None}.items():
        assert one(spark, text.employment_label(F.lit(value))) == expected


def test_growth_and_freshness_points(spark):
    for opened, closed, expected in [(3, 3, 15.0), (6, 0, 30.0), (0, 6, 0.0), (0, 0, 9.0)]:
        assert one(spark, scoring.growth_points(F.lit(opened), F.lit(closed))) == expected
    now = F.lit("2026-08-01").cast("timestamp")
    assert one(spark, scoring.freshness_points(now, now)) == 15.0
    assert one(spark, scoring.freshness_points(F.lit("2026-05-09").cast("timestamp"), now)) == 0.0


def test_guard_boundaries(spark):
    for existing, missing, held in [(100, 99, True), (10, 1, False), (20, 10, False), (100, 5, False), (20, 11, True)]:
        assert bool(one(spark, snapshots.guard(F.lit(existing), F.lit(missing)))) is held


def test_missing_and_empty_snapshots_differ(spark):
    stored = spark.createDataFrame([("a", "42"), ("b", "42")], "source_id string, external_id string")
    nothing = stored.filter("1 = 0")
    none = snapshots.diff_identities(stored, nothing, nothing.select("source_id"), ["source_id"])
    assert none.count() == 0
    only_a = snapshots.diff_identities(stored, nothing, stored.filter("source_id = 'a'"), ["source_id"])
    assert [(r.source_id, r.state) for r in only_a.collect()] == [("a", "missing")]


def test_fingerprint_ignores_order_and_repeats(spark):
    rows = [("x", v) for v in ("b", "a", "a")] + [("y", v) for v in ("a", "b")] + [("z", v) for v in ("a", "c")]
    members = spark.createDataFrame(rows, "source_id string, external_id string")
    prints = {r.source_id: r.fingerprint for r in snapshots.fingerprints(members, ["source_id"]).collect()}
    assert prints["x"] == prints["y"] != prints["z"]


def test_retry_clock(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    for attempt, hours in [(1, 6), (3, 24), (30, 168)]:
        waited = F.unix_seconds(discovery.retry_at(now, F.lit(attempt))) - F.unix_seconds(now)
        assert one(spark, waited) == hours * 3600


def test_funding_wording(spark):
    title = F.lit("Higharc raises $120M Series D to build homes")
    assert one(spark, funding.funding_label(title)) == "$120M Series D"
    assert one(spark, funding.stage(title)) == "Series D"
    assert one(spark, funding.headline_company(title)) == "Higharc"
    assert not one(spark, funding.is_announcement(F.lit("Acme in talks, raises Series B")))


def test_concentration(spark):
    rows = [("a", 476), ("b", 200), ("c", 150), ("d", 100), ("e", 50), ("e", 24)]
    counts = spark.createDataFrame(rows, "company_id string, jobs long")
    assert audit.concentration(counts).first()["share"] == 0.476
    assert not audit.within_share(counts, 0.2).first()["within_limit"]
    assert audit.within_share(counts.filter("1 = 0"), 0.2).first()["within_limit"]


def test_rank_in_group_equals_row_number_on_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 97).alias("v"), "id"
    )
    got = rank_in_group(rows, ["k"], [F.col("v").desc(), F.col("id")], [(F.col("v"), True)])
    from pyspark.sql import Window

    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc(), "id")).cast("long"))
    assert got.select("k", "v", "id", "rn").exceptAll(want.select("k", "v", "id", "rn")).count() == 0


def test_top_in_group_limits_before_the_shuffle(spark):
    plan = plan_text(top_in_group(spark.range(100).withColumn("k", F.col("id") % 3), ["k"], [F.col("id")], 2))
    assert "WindowGroupLimit" in plan


def test_domains_follow_the_suffix_table(spark):
    hosts = spark.createDataFrame([("https://www.shop.co.th/x",), ("a.b.co.uk",), (None,), ("co.th",)], "site string")
    found = urls.with_domains(hosts, {"site": "domain"}, urls.suffix_table(spark, ["co.th"]))
    assert {r.site: r.domain for r in found.collect()} == {"https://www.shop.co.th/x": "shop.co.th", "a.b.co.uk": "b.co.uk", None: "", "co.th": ""}
    plain = urls.with_domains(hosts, {"site": "domain"}, urls.suffix_table(spark))
    assert "co.th" in {r.domain for r in plain.collect()}
