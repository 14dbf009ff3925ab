"""Streams over several batches: replays, late repeats, misses, expiry, searches entered and left."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from vacloom.streaming import feed, stateful
from vacloom.streaming.seen import KeyedLog


def parts(spark, folder, schema, *batches):
    """A stream that reads one file per batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)


def test_repeats_are_dropped_however_late(spark, tmp_path):
    stream = parts(spark, tmp_path, "id int, ts timestamp", [(1, at(0)), (2, at(40))], [(2, at(41)), (3, at(1)), (3, at(2))], [(1, at(90)), (4, at(3))])
    assert sorted(r.id for r in feed.append_new(stream, "id", f"{tmp_path}/run").collect()) == [1, 2, 3, 4]


def test_a_run_is_taken_in_once(spark, tmp_path):
    stream = parts(spark, tmp_path, "run_id string, source_id int, job int", [("r1", 1, 1), ("r1", 1, 2), ("r1", 2, 3)], [("r1", 1, 1), ("r2", 1, 2)])
    got = sorted(tuple(r) for r in stateful.take_in_snapshots(stream, ["run_id", "source_id"], f"{tmp_path}/run").collect())
    assert got == [("r1", 1, 1), ("r1", 1, 2), ("r1", 2, 3), ("r2", 1, 2)]


def test_two_misses_close_within_their_hours(spark, tmp_path):
    rows = [
        (1, "a", at(0), False), (1, "b", at(0, 12), False), (1, "c", at(1, 6), False),  # closed at c
        (2, "a", at(0), False), (2, "b", at(1), True), (2, "c", at(1, 6), False),  # seen between
        (3, "a", at(0), False), (3, "b", at(3), False), (3, "c", at(4, 1), False),  # the clock starts again at b
        (4, "a", at(0), False), (4, "a", at(1, 6), False),  # the same run twice
    ]
    later = [(9, "z", at(60), True)]  # moves the clock past all others
    want = [(1, at(1, 6)), (3, at(4, 1))]
    for name, batches in (("a", [rows[:8], rows[8:], later]), ("b", [rows[::-2], rows[1::2][::-1] + rows[:1], later])):
        stream = parts(spark, tmp_path / name, "job int, run string, ts timestamp, seen boolean", *batches)
        got = feed.run_available(stateful.closed_after_misses(stream, ["job"], "ts", "run", "seen", delay="30 days"))
        assert sorted((r.job, r.closed_at) for r in got.collect()) == want


def test_state_of_misses_ends(spark, tmp_path):
    rows = [(i, "a", at(0), False) for i in range(50)]
    stream = parts(spark, tmp_path, "job int, run string, ts timestamp, seen boolean", rows, [(99, "b", at(20), True)], [(99, "c", at(40), True)])
    started = stateful.closed_after_misses(stream, ["job"], "ts", "run", "seen").writeStream.format("noop").option(
        "checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] < 10


def test_a_batch_opens_only_buckets_that_may_hold_its_keys(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path), ["id"], "id long, v string")
    for number in range(20):
        rows = spark.range(number * 100, number * 100 + 100).select("id", F.lit(f"b{number}").alias("v"))
        assert log.unseen(rows, number).count() == 100
        assert len(log.opened) == 0  # newer ids than any stored
        log.add(rows, number)
    assert log.generations(20) == [(0, 16), (0, 17), (0, 18), (0, 19), (1, 0), (1, 1)]
    again = spark.createDataFrame([(5, "x"), (1950, "x"), (5000, "x")], "id long, v string")
    assert sorted(r.id for r in log.unseen(again, 20).collect()) == [5000] and len(log.opened) == 2
    assert sorted(map(tuple, log.matching(again, 20).collect())) == [(5, "b0"), (1950, "b19")]
    assert len(log.generations(4096)) == 1 and len(log.generations(4095)) == 4 * 7


def test_signals_expire_by_the_clock_of_the_stream(spark, tmp_path):
    stream = parts(spark, tmp_path, "id int, ts timestamp, expires timestamp", [(1, at(0), at(3)), (2, at(1), at(30))], [(3, at(10), at(12))])
    got = feed.run_available(stateful.expired_signals(stream, "id", "ts", "expires"))
    assert sorted((r.id, r.expired_at) for r in got.collect()) == [(1, at(3))]


def test_searches_are_entered_and_left(spark, tmp_path):
    searches = spark.createDataFrame([("s1", "eng"), ("s2", "ops")], "search_id string, family string")
    stream = parts(
        spark, tmp_path, "job int, ts timestamp, family string, open boolean", [(1, at(0), "eng", True), (2, at(0), "ops", True)],
        [(1, at(1), "ops", True), (2, at(1), "ops", True)], [(1, at(2), "ops", False)])
    got = stateful.watch_searches(stream, searches, ["family"], "job", "ts", F.col("open"), f"{tmp_path}/run")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("s1", 1, "enter"), ("s1", 1, "leave"), ("s2", 1, "enter"), ("s2", 1, "leave"), ("s2", 2, "enter")]


def test_signals_that_wait_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "SIGNAL_GROUPS", 2)
    rows = [(i, at(0), at(3 + i)) for i in range(40)]
    # Signal 5 is told again and expires later; signal 90 comes when its expiry has passed.
    stream = parts(spark, tmp_path, "id int, ts timestamp, expires timestamp", rows, [(5, at(1), at(60)), (99, at(24), at(70))], [(90, at(24), at(2))])
    got = feed.run_available(stateful.expired_signals(stream, "id", "ts", "expires", delay="1 hour"))
    assert sorted((r.id, r.expired_at) for r in got.collect()) == sorted([(i, at(3 + i)) for i in range(21) if i != 5] + [(90, at(2))])
    started = stateful.expired_signals(stream, "id", "ts", "expires").writeStream.format("noop").option(
        "checkpointLocation", f"{tmp_path}/again").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in started.recentProgress if p["stateOperators"]) <= 2


def test_a_key_has_one_timer_however_many_outcomes_wait():
    class Kept:
        def __init__(self):
            self.timers, self.rows, self.value = [], [], None

        def getListState(self, name, schema):
            return self

        def getValueState(self, name, schema):
            return self

        def appendList(self, rows):
            self.rows += rows

        def registerTimer(self, at):
            self.timers.append(at)

    held, misses = Kept(), stateful._Misses(["job"], "ts", "run", "seen")
    misses.init(held)
    rows = pd.DataFrame({"ts": pd.to_datetime([3000, 1000, 2000], unit="ms"), "run": ["a", "b", "c"], "seen": [True, False, False]})
    assert list(misses.handleInputRows(("j",), iter([rows]), None)) == []
    assert len(held.rows) == 3 and held.timers == [1000]
