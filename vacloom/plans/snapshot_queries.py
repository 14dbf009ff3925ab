"""Supplier catalogues by ship year seen as periodic board snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import role, with_roles
from ..functions import hashing
from ..operators import snapshots as op
from ..session import durable
from .catalog import query

SCOPE = ["run_id", "source_id"]


def diffed(spark, sf_dir):
    """Every ship year against the year before it, all runs in one plan, and the sources of each run, found once."""
    observed = role(spark, sf_dir, "snapshot")
    stored = observed.withColumn("run_id", F.col("run_id") + 1)
    fetched = durable(observed.select(*SCOPE).distinct())
    return op.diff_identities(stored, observed, fetched, SCOPE), fetched


def diffed_once(spark, sf_dir):
    """The same for queries that read the states twice, to assess them and to list some: both reads share one join."""
    diff, fetched = diffed(spark, sf_dir)
    return durable(diff), fetched


STATE = """
  SELECT coalesce(n.run_id, b.run_id + 1) AS run_id, coalesce(n.source_id, b.source_id) AS source_id,
    coalesce(n.external_id, b.external_id) AS external_id,
    CASE WHEN b.external_id IS NULL THEN 'new' WHEN n.external_id IS NULL THEN 'missing' ELSE 'retained' END AS state
  FROM snapshot_role n FULL JOIN snapshot_role b
    ON b.run_id + 1 = n.run_id AND b.source_id = n.source_id AND b.external_id = n.external_id
  WHERE EXISTS (SELECT 1 FROM snapshot_role f WHERE f.run_id = coalesce(n.run_id, b.run_id + 1)
    AND f.source_id = coalesce(n.source_id, b.source_id))"""
ASSESSED = f"""
  SELECT *, CAST(floor(CASE WHEN existing_open = 0 THEN 0 ELSE missing * 10000.0 / existing_open END + 0.5) AS BIGINT) AS missing_ratio_bps,
    CASE WHEN existing_open >= 20 AND missing >= 10 AND missing * 1.0 / existing_open > 0.5 THEN 'quarantined' ELSE 'accepted' END AS status
  FROM (SELECT run_id, source_id, count(*) FILTER (WHERE state <> 'new') AS existing_open,
    count(*) FILTER (WHERE state <> 'missing') AS observed_open, count(*) FILTER (WHERE state = 'missing') AS missing
    FROM ({STATE}) GROUP BY 1, 2)"""


@query("snapshot_diff", with_roles("snapshot", then=STATE))
def snapshot_diff(spark, sf_dir):
    return diffed(spark, sf_dir)[0]


@query("snapshot_guard", with_roles("snapshot", then=ASSESSED))
def snapshot_guard(spark, sf_dir):
    diff, fetched = diffed(spark, sf_dir)
    return op.assess(diff, fetched, SCOPE).drop("reason")


@query("snapshot_frozen_members", with_roles("snapshot", then=f"""
  SELECT s.run_id, s.source_id, s.external_id, k.kind FROM ({STATE}) s
  JOIN ({ASSESSED}) a ON a.run_id = s.run_id AND a.source_id = s.source_id AND a.status = 'quarantined'
  JOIN (VALUES ('new', 'observed'), ('retained', 'observed'), ('retained', 'existing'), ('missing', 'existing'),
    ('missing', 'missing')) k(state, kind) ON k.state = s.state"""))
def snapshot_frozen_members(spark, sf_dir):
    diff, fetched = diffed_once(spark, sf_dir)
    return op.frozen_members(diff, op.assess(diff, fetched, SCOPE), SCOPE)


@query("snapshot_closures", with_roles("snapshot", then=f"""
  SELECT s.run_id, s.source_id, s.external_id FROM ({STATE}) s
  JOIN ({ASSESSED}) a ON a.run_id = s.run_id AND a.source_id = s.source_id AND a.status = 'accepted'
  WHERE s.state = 'missing'"""))
def snapshot_closures(spark, sf_dir):
    diff, fetched = diffed_once(spark, sf_dir)
    return op.closing_identities(diff, op.assess(diff, fetched, SCOPE), SCOPE)


FNV_SQL = """list_reduce(list_prepend(CAST(2166136261 AS UBIGINT),
    list_transform(string_split({}, ''), lambda x: CAST(unicode(x) AS UBIGINT))),
    lambda a, b: (xor(a, b) * 16777619) % 4294967296)"""


@query("snapshot_fingerprints", with_roles("snapshot", then=f"""
  SELECT run_id, source_id, 'fnv1a32:' || lpad(lower(hex({FNV_SQL.format('ids')})), 8, '0') || ':' || n AS fingerprint
  FROM (SELECT run_id, source_id, count(*) AS n,
    string_agg(CAST(external_id AS STRING), chr(10) ORDER BY CAST(external_id AS STRING)) AS ids
    FROM snapshot_role GROUP BY 1, 2)"""))
def snapshot_fingerprints(spark, sf_dir):
    return op.fingerprints(role(spark, sf_dir, "snapshot"), SCOPE)


@query("snapshot_same_members", with_roles("snapshot", then=f"""
  SELECT run_id, source_id, count(*) FILTER (WHERE state <> 'retained') = 0 AS same FROM ({STATE}) GROUP BY 1, 2"""))
def snapshot_same_members(spark, sf_dir):
    observed = role(spark, sf_dir, "snapshot")
    stored = observed.withColumn("run_id", F.col("run_id") + 1)
    fetched = observed.select(*SCOPE).distinct()
    return op.same_sets(stored, observed, SCOPE).join(fetched, SCOPE, "left_semi")


@query("snapshot_digests", with_roles("snapshot", then="""
  SELECT run_id, source_id, count(*) AS members FROM snapshot_role GROUP BY 1, 2"""))
def snapshot_digests(spark, sf_dir):
    return op.set_digest(role(spark, sf_dir, "snapshot"), SCOPE).select("run_id", "source_id", "members")


@query("refresh_outcomes", with_roles("snapshot", then=f"""
  SELECT run_id, count(*) AS sources, count(*) FILTER (WHERE status = 'accepted') AS successes,
    count(*) FILTER (WHERE status <> 'accepted') AS failures, CAST(sum(observed_open) AS BIGINT) AS opened,
    CAST(sum(missing) AS BIGINT) AS closed,
    count(*) FILTER (WHERE status = 'accepted') BETWEEN 1 AND count(*) - 1 AS partial_success,
    count(*) FILTER (WHERE status = 'accepted') * 1.0 / count(*) >= 0.5 AS meets_threshold,
    CASE WHEN count(*) FILTER (WHERE status = 'accepted') * 1.0 / count(*) < 0.5 THEN 'failed'
      WHEN count(*) FILTER (WHERE status = 'accepted') < count(*) THEN 'partial_success' ELSE 'success' END AS overall_status
  FROM ({ASSESSED}) GROUP BY 1"""))
def refresh_outcomes(spark, sf_dir):
    diff, fetched = diffed(spark, sf_dir)
    results = op.assess(diff, fetched, SCOPE).select(
        "run_id", F.when(F.col("status") == "accepted", "success").otherwise("quarantined").alias("status"),
        F.col("observed_open").alias("opened"), F.col("missing").alias("closed"),
    )
    return op.refresh_outcome(results, ["run_id"]).drop("quarantined")


@query("identity_hashes", f"""
  SELECT l_suppkey, l_partkey, 'candidate_' || lower(to_base(CAST({FNV_SQL.format("domain")} AS BIGINT), 36)) AS candidate,
    lpad(lower(hex({FNV_SQL.format("domain")})), 8, '0') || lpad(lower(hex(list_reduce(list_prepend(CAST(2654435769 AS HUGEINT),
      list_transform(string_split(domain, ''), lambda x: CAST(unicode(x) AS HUGEINT))),
      lambda a, b: (xor(a, b) * 2246822507) % 4294967296))), 8, '0') AS identity
  FROM (SELECT DISTINCT l_suppkey, l_partkey, 'ashby:' || l_suppkey || ':' || l_partkey AS domain FROM lineitem)""")
def identity_hashes(spark, sf_dir):
    from ..bindings import table

    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    key = hashing.identity_key(F.lit("ashby"), F.col("l_suppkey"), F.col("l_partkey"))
    return pairs.select(
        "l_suppkey", "l_partkey", hashing.prefixed_id("candidate", key).alias("candidate"),
        hashing.identity_hash(key).alias("identity"),
    )


@query("rotating_supplier_window", """
  SELECT s_suppkey, rn - 1 AS position, CASE WHEN 95 >= n THEN 0 ELSE 95 END AS next_cursor
  FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) AS rn, count(*) OVER () AS n FROM supplier)
  WHERE rn > 75 AND rn <= 95""")
def rotating_supplier_window(spark, sf_dir):
    from ..bindings import table

    return op.rotating_window(table(spark, sf_dir, "supplier"), ["s_name"], 75, 20).select(
        "s_suppkey", "position", "next_cursor"
    )
