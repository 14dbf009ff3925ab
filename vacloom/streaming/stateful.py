"""Streams with memory: misses of fragile sources, expiry of signals, intake of snapshots, saved searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .seen import KeyedLog

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Misses(StatefulProcessor):
    """Outcomes of a key wait in a list until the watermark has passed them, and are then taken in order."""

    def __init__(self, keys: list[str], at: str, run: str, seen: str):
        self.keys, self.at, self.run, self.seen = keys, at, run, seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, run string, seen boolean")
        self.clock = handle.getValueState("clock", "first_miss long, last_run string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            told = list(zip(part[self.at].to_numpy("datetime64[ms]").astype(int).tolist(), part[self.run].astype(str), part[self.seen].astype(bool)))
            self.waiting.appendList([(at, run, seen) for at, run, seen in told])
            # One timer for what waits first; what comes after it gets its own when that has gone off.
            self.handle.registerTimer(min(t[0] for t in told))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        first, last_run = self.clock.get() if self.clock.exists() else (None, None)
        told = list(self.waiting.get()) if self.waiting.exists() else []
        due, closed = sorted(t for t in told if t[0] <= now), []
        for at, run, seen in due:
            if run == last_run:
                continue
            last_run = run
            if seen:
                first = None
            elif first is None or at - first > 2 * DAY_MS:
                first = at
            elif at - first >= DAY_MS:
                closed.append((*key, pd.Timestamp(at, unit="ms")))
                first = None
        later = [t for t in told if t[0] > now]
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self.handle.registerTimer(min(t[0] for t in later))
        # A clock that has run out starts anew with the next miss, as if there had been none.
        if first is not None and now - first <= 2 * DAY_MS:
            self.clock.update((first, last_run))
            self.handle.registerTimer(first + 2 * DAY_MS + 1)
        elif later:
            self.clock.update((None, last_run))
        else:
            self.clock.clear()
        if closed:
            yield pd.DataFrame(closed, columns=[*self.keys, "closed_at"])

    def close(self) -> None:
        pass


def closed_after_misses(outcomes: DataFrame, keys: list[str], at: str, run: str, seen: str, delay: str = "1 day") -> DataFrame:
    """Closures of postings that a fragile source misses twice, 24 to 48 hours apart.

    A miss starts a clock; a further one within a day only counts, one after two days starts the clock again,
    and one in between closes the posting. Being seen stops the clock. A run that is told again changes nothing.

    Outcomes may come in any order within ``delay``; each is decided once the stream's clock has passed it. A
    key holds the outcomes of the delay and a clock, and nothing once the clock has run out.
    """
    types = dict(outcomes.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    outcomes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = outcomes.withWatermark(at, delay).select(*keys, at, run, seen)
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Misses(keys, at, run, seen), f"{schema}, closed_at timestamp", "append", "eventTime")


SIGNAL_GROUPS = 4096  # of signals that share a state, by a hash of their key


def expired_signals(signals: DataFrame, key: str, at: str, expires: str, delay: str = "1 day") -> DataFrame:
    """Each signal once the stream's clock has passed its expiry.

    A group of signals waits in one state and has one timer, that of its first expiry; what a later batch says
    of a signal that waits replaces its expiry.
    """
    kind = dict(signals.dtypes)[key]
    names = [key, "expired_at"]

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: rows[key], "expired_at": pd.to_datetime(rows["due"].to_numpy("datetime64[ms]"))}, columns=names)

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        keys, dues = state.get if state.exists else ([], [])
        waiting = pd.DataFrame({key: pd.Series(list(keys), dtype=object), "due": np.array(dues, np.int64)})
        if state.hasTimedOut:
            ended = waiting["due"] < now
            yield told(waiting[ended])
        else:
            new = pd.concat([pd.DataFrame({
                key: rows[key].astype(object).where(rows[key].notna(), None),
                "due": rows[expires].to_numpy("datetime64[ns]").astype(np.int64) // 1_000_000}) for rows in batches])
            new = new.groupby(key, dropna=False, sort=False, as_index=False)["due"].max()
            waiting = pd.concat([waiting[~waiting[key].isin(new[key])], new])
            # No timer goes off for a group with new rows: what it would have ended ends here.
            ended = (waiting["due"] < now) | (waiting["due"] <= now) & waiting[key].isin(new[key])
            yield told(waiting[ended])
        waiting = waiting[~ended]
        if len(waiting):
            state.update((waiting[key].where(waiting[key].notna(), None).tolist(), waiting["due"].tolist()))
            state.setTimeoutTimestamp(max(int(waiting["due"].min()), now + 1))
        elif state.exists:
            state.remove()

    grouped = signals.withWatermark(at, delay).select(key, expires, at).withColumn("_group", F.pmod(F.xxhash64(key), F.lit(SIGNAL_GROUPS)))
    return grouped.groupBy("_group").applyInPandasWithState(
        step, f"{key} {kind}, expired_at timestamp", f"keys array<{kind}>, dues array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def _run(stream: DataFrame, folder: str, store) -> None:
    started = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()


def take_in_snapshots(rows: DataFrame, run_keys: list[str], folder: str) -> DataFrame:
    """Snapshots of runs, each run once: rows of a run that an earlier batch brought are left out.

    An index of the runs taken in is looked up by key. A batch run again after a failure replaces its own part,
    so rows and receipts agree at all times.
    """
    kinds = dict(rows.dtypes)

    def store(batch: DataFrame, number: int) -> None:
        taken = KeyedLog(batch.sparkSession, f"{folder}/receipts", run_keys, ", ".join(f"{k} {kinds[k]}" for k in run_keys))
        path = f"{folder}/rows/batch={number}"
        taken.unseen(batch, number).write.mode("overwrite").parquet(path)
        taken.add(batch.sparkSession.read.schema(rows.schema).parquet(path).select(*run_keys).distinct(), number)

    _run(rows, folder, store)
    return rows.sparkSession.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def watch_searches(jobs: DataFrame, searches: DataFrame, on: list[str], key: str, at: str, open_: Column, folder: str) -> DataFrame:
    """search_id, key, change for every job that enters or leaves a saved search.

    ``searches``: search_id and the columns ``on`` that a job has to equal. Only jobs that changed are looked
    up, in an index of what was told of them; the last change of a job within a batch counts. Each batch writes its changes; membership is their sum.
    """
    schema = searches.select("search_id").schema
    schema = f"search_id {schema[0].dataType.simpleString()}, {key} {dict(jobs.dtypes)[key]}, step int"

    def store(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), at).alias("s")).select(key, "s.*")
        member = newest.filter(open_).join(searches, on).select("search_id", key).distinct().withColumn("new", F.lit(1))
        log = KeyedLog(batch.sparkSession, f"{folder}/members", [key], schema)
        held = log.matching(newest, number).groupBy("search_id", key).agg(F.sum("step").alias("old"))
        both = member.join(held, ["search_id", key], "full")
        step = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
        changed = both.select("search_id", key, step.cast("int").alias("step")).filter("step <> 0")
        path = f"{folder}/changes/batch={number}"
        changed.write.mode("overwrite").parquet(path)
        log.add(batch.sparkSession.read.schema(schema).parquet(path), number)

    _run(jobs, folder, store)
    told = jobs.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    return told.select("search_id", key, F.when(F.col("step") > 0, "enter").otherwise("leave").alias("change"))
