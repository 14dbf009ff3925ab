"""The audit's freshness: identity or address decides, and each posting's address is made canonical once."""

from vacloom.functions.urls import canonical_url
from vacloom.operators import audit as op

COLUMNS = "source_key string, external_id string, canonical_url string"
SAMPLE = [(1, "s", "a", "https://x.com/a"), (2, "s", "gone", "https://X.com//b/?utm_source=q"), (3, "s", "c", "https://x.com/c"),
          (4, "s", "d", "https://x.com/d"), (5, "t", "a", None), (6, "u", "a", "https://x.com/a"), (7, "v", "a", "https://x.com/a"), (8, None, "a", None)]
CURRENT = [("s", "a", None), ("s", "a", None), ("s", "b", "https://x.com/b"), ("v", "z", "https://x.com/z")]
OBSERVED = [("s", "c", "https://x.com/other"), ("s", "a", None), ("u", "y", None)]


def told(spark):
    sample = spark.createDataFrame(SAMPLE, f"job_id long, {COLUMNS}")
    return op.freshness(sample, spark.createDataFrame(CURRENT, COLUMNS), spark.createDataFrame(OBSERVED, COLUMNS),
                        spark.createDataFrame([("u", "timeout")], "source_key string, message string"))


def test_freshness(spark):
    found = {r["job_id"]: r["freshness"] for r in told(spark).collect()}
    assert found == {1: "fresh", 2: "fresh", 3: "ineligible", 4: "stale", 5: "inconclusive", 6: "inconclusive", 7: "inconclusive", 8: "inconclusive"}


def test_addresses_are_made_canonical_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(op, "canonical_url", lambda url: asked.append(url) or canonical_url(url))
    told(spark)
    assert len(asked) == 2  # the sample's and those of the postings of both collections
