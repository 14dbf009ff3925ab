"""Registrable domains by the rules of the whole public list."""

import glob
import os
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from vacloom.functions import urls
from vacloom.plans.career_queries import career_pages
from vacloom.plans.page_queries import portfolio_pages
from vacloom.sources.pages import external_links

HOSTS = [
    "shop.co.th", "a.shop.co.th", "co.th", "www.ck", "a.www.ck", "b.a.ck", "a.ck", "ck", "city.kawasaki.jp", "a.city.kawasaki.jp", "x.y.kawasaki.jp", "y.kawasaki.jp",
    "acme.github.io", "github.io", "example.com", "a.b.example.com", "unlisted.zzq", "a.unlisted.zzq", "localhost", "10.0.0.1", "", "https://jobs.example.co.uk/x",
    "a.b.c.d.kobe.jp", "www.google.com.", "UPPER.Example.COM",
]


@pytest.fixture(scope="module")
def lines():
    """The list that comes with Spark's own HTTP client."""
    found = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "httpclient-4*.jar"))
    if not found:
        pytest.skip("no public suffix list at hand")
    with zipfile.ZipFile(found[0]) as jar:
        return jar.read("mozilla/public-suffix-list.txt").decode().splitlines()


def brute(host, rules):
    host = host.split("//")[-1].split("/")[0].lower().rstrip(".")
    labels = host.split(".")
    if not host or all(p.isdigit() for p in labels) or len(labels) < 2:
        return ""
    n, exception = 1, None
    for i in range(len(labels)):
        end = ".".join(labels[i:])
        if "!" + end in rules:
            exception = len(labels) - i - 1
        if end in rules or "*." + ".".join(labels[i + 1 :]) in rules and i + 1 < len(labels):
            n = max(n, len(labels) - i)
    n = n if exception is None else exception
    return ".".join(labels[len(labels) - n - 1 :]) if len(labels) > n else ""


def test_domains_by_the_whole_list(spark, lines):
    rules = {x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")}
    assert len(rules) > 5000
    table = urls.suffix_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    hosts = spark.createDataFrame([(h,) for h in [*HOSTS, *HOSTS[:3], None]], "host string")
    got = urls.registrable_domains(hosts, "host", table, "domain").collect()
    assert len(got) == len(HOSTS) + 4
    assert {r["host"]: r["domain"] for r in got if r["host"] is not None} == {h: brute(h, rules) for h in HOSTS}
    assert brute("a.ck", rules) == "" and brute("a.www.ck", rules) == "www.ck" and brute("shop.co.th", rules) == "shop.co.th"


def test_lines_of_a_list(spark):
    given = spark.createDataFrame([("// comment",), ("",), ("*.ck  trailing",), ("!www.ck",), ("Co.UK",), (None,)], "value string")
    assert {tuple(r) for r in urls.suffix_rules(given).collect()} == {("ck", "wildcard"), ("www.ck", "exception"), ("co.uk", "plain")}


def test_career_links_are_picked_once_and_hosts_are_looked_up(spark):
    asked = spark.sparkContext.accumulator(0)

    def counted(value):
        asked.add(1)
        return value

    once = F.udf(counted, "string").asNondeterministic()
    rows = spark.range(12).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://www.site.co.uk/p"), "id").alias("url"),
        once(F.when(F.col("id") % 3 == 0, "https://careers.other.com/jobs/apply").otherwise("https://example.org/about")).alias("link"))
    got = external_links(rows, urls.suffix_table(spark)).select("page_id", "host", "domain").collect()
    assert sorted(map(tuple, got)) == [(i, "careers.other.com", "site.co.uk") for i in (0, 3, 6, 9)]
    assert asked.value == 12


def test_pages_made_of_a_small_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit(7).alias("p_size")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(50).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for made in (portfolio_pages(spark, str(tmp_path)), career_pages(spark, str(tmp_path))):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and made.count() == 50
