"""Hot groups are split: plans after a join, exact selection and global places."""

import math
import random
import re

from pyspark.sql import functions as F

from vacloom.operators import discovery, movements
from vacloom.operators.discovery import nearest_rank
from vacloom.operators.snapshots import rotating_window
from vacloom.plans import snapshot_queries
from vacloom.plans.skew import in_order, plan_text, rank_in_group, top_in_group


def joined(spark):
    left = spark.range(2000).select((F.col("id") % 3).alias("k"), "id").hint("merge")
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    return left.join(right, "k")


def dealt(df, column):
    """What the rows of each window with ``column`` among its keys were dealt by last."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = plan_text(df).splitlines()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    found = []
    for i, line in enumerate(lines):
        if "Window [row_number" in line and column in line:
            found.append(next(x for x in lines[i:] if "Exchange" in x))
    return found


def test_slices_are_dealt_after_a_join_on_the_key(spark):
    rows = joined(spark)
    ranked = rank_in_group(rows, ["k"], [F.col("id").desc()], [(F.col("id") % 7, False)])
    top = top_in_group(rows, ["k"], [F.col("id").desc()], 2)
    for df, column in ((ranked, "_slice0"), (top, "_part")):
        found = dealt(df, column)
        assert found and all(re.search(rf"hashpartitioning\(k#\d+L?, {column}#", x) for x in found)
    assert sorted((r.k, r.id) for r in top.collect()) == [(k, i) for k in range(3) for i in sorted(x for x in range(2000) if x % 3 == k)[-2:]]


def test_percentiles_equal_sorting(spark):
    rng = random.Random(3)
    rows = [("hot", int(rng.gauss(0, 1e6))) for _ in range(3000)] + [("one", 7)] + [("same", 5)] * 50 + [(None, -1), (None, 4), ("wide", -(2**61)), ("wide", 2**60), ("wide", 2**60 + 1), ("nil", None)]
    got = nearest_rank(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", {"low": 0.0, "median": 0.5, "p75": 0.75, "top": 1.0})
    want = {}
    for key in {k for k, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        at = [values[math.ceil((len(values) - 1) * f)] for f in (0, 0.5, 0.75, 1)]
        want[key] = (*at, values[0], values[-1])
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == want
    fractions = nearest_rank(spark.createDataFrame([(1, x / 7) for x in range(100)], "k int, v double"), ["k"], "v", {"m": 0.5}).first()
    assert fractions["m"] == 50 / 7
    assert nearest_rank(spark.createDataFrame([], "k int, v double"), ["k"], "v", {"m": 0.5}).count() == 0


def test_percentiles_deal_no_whole_key(spark, monkeypatch):
    plans, durable = [], discovery.durable
    monkeypatch.setattr(discovery, "durable", lambda df: plans.append(plan_text(df)) or durable(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"))
        got = nearest_rank(rows, ["k"], "v", {"m": 0.5})
        plans.append(plan_text(got))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    reading = [p for p in plans if "Range (" in p]
    # The rows are read once, to be counted by key and value; what is joined later is dealt by key and range.
    assert len(reading) == 1 and "Join" not in reading[0] and "rangepartitioning" in reading[0]
    values = sorted((r.k, r.v) for r in rows.collect())
    assert {r.k: r.m for r in got.collect()} == {k: [v for j, v in values if j == k][1250] for k in (0, 1)}
    odd = [("a", x) for x in (1.0, 2.0, float("inf"), float("nan"))]
    assert nearest_rank(spark.createDataFrame(odd, "k string, v double"), ["k"], "v", {"m": 0.5}).first()["m"] == float("inf")


def test_states_read_twice_are_joined_once(spark, tmp_path):
    boards = {10: (range(1, 31), [1]), 20: (range(1, 31), range(1, 31)), 30: (range(1, 6), range(1, 5))}
    rows = [(s, p, f"{year}-03-01") for s, both in boards.items() for year, parts in zip((1996, 1997), both) for p in parts]
    spark.createDataFrame([*rows, (10, None, "1997-03-01")], "l_suppkey long, l_partkey long, day string").select(
        "l_suppkey", "l_partkey", F.col("day").cast("timestamp").alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    frozen = snapshot_queries.snapshot_frozen_members(spark, str(tmp_path))
    closing = snapshot_queries.snapshot_closures(spark, str(tmp_path))
    assert not any(x in plan_text(df) for df in (frozen, closing) for x in ("FullOuter", "FileScan"))
    kinds = sorted((r.kind, r.external_id or 0) for r in frozen.filter("run_id = 1997 AND source_id = 10").collect())
    assert kinds == [*(("existing", i) for i in range(1, 31)), *(("missing", i) for i in range(2, 31)), ("observed", 0), ("observed", 1)]
    assert frozen.count() == len(kinds)
    assert [tuple(r) for r in closing.select("run_id", "source_id", "external_id").collect()] == [(1997, 30, 5)]


def test_movements_count_without_copies_of_their_events(spark):
    rows = [(1, 7, "S", "job_opened", j, t, u) for j, t, u in [(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "c", "y")]]
    rows += [(1, 7, "S", "job_closed", 1, "b", "z"), (1, 8, "S", "job_opened", 9, "d", "x"), (1, 9, None, "job_closed", 5, None, "x")]
    evidence = spark.createDataFrame(rows, "day int, company_id int, sector string, change_type string, job_id int, title string, source_url string")
    own, sectors = movements.day_movements(evidence, ["day", "company_id", "sector"]), movements.day_movements(evidence, ["day", "sector"])
    for df in (own, sectors):
        # No row is multiplied to count different values, and each task passes on a movement's first titles only.
        plan = plan_text(df)
        assert "Expand" not in plan and plan.count("WindowGroupLimit") == 2
    numbers = ["opened", "closed", "net", "evidence_count", "source_url_count", "company_count", "description"]
    assert {r.company_id: tuple(r[n] for n in numbers) for r in own.collect()} == {
        7: (4, 1, 3, 5, 3, 1, "4 opened and 1 closed: a, b +2 more."), 8: (1, 0, 1, 1, 1, 1, "1 opened: d."), 9: (0, 1, -1, 1, 1, 1, "1 closed: .")}
    assert {r.sector: tuple(r[n] for n in numbers) for r in sectors.collect()} == {
        "S": (5, 1, 4, 6, 3, 2, "5 opened and 1 closed: a, b +3 more."), None: (0, 1, -1, 1, 1, 1, "1 closed: .")}


def test_places_in_global_order(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    placed, size = in_order(rows, [F.col("h").asc(), F.col("id").asc()], "place")
    found = sorted((r.place, r.h) for r in placed.collect())
    assert size == 1000 and [p for p, _ in found] == list(range(1000)) and [h for _, h in found] == sorted(h for _, h in found)
    assert in_order(rows.limit(0), [F.col("h").asc()], "place")[1] == 0
    page = rotating_window(rows, ["id"], 990, 20).collect()
    assert sorted(r.id for r in page) == list(range(990, 1000)) and {r.next_cursor for r in page} == {0}
    assert sorted(r.id for r in rotating_window(rows, ["id"], 2000, 3).collect()) == [0, 1, 2]
    assert {r.next_cursor for r in rotating_window(rows, ["id"], 10, 5).collect()} == {15}
