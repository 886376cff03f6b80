"""Keyed state of streams that the built-in windows can't express: output held up to a limit, session goals, and the goal in force at a run.

Each equals its batch form (``route.bounded``, ``state.goal_revisions``, ``state.goal_as_of``) over any cut of the input into batches, and after a restart from the
checkpoint. State lives in RocksDB; ``started`` sets that for the query it starts.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3600 * 1000


def started(stream: DataFrame, checkpoint: str, sink: Any, available_now: bool = True) -> StreamingQuery:
    """Starts a stream with RocksDB state. ``sink`` gets the writer and returns it with its format, path or function set."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        writer = sink(stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append"))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def settled(query: StreamingQuery, seconds: float = 300) -> None:
    """Waits until a batch of a query had no rows, and stops it. A query with processing-time state has batches without end, so that its input is used up
    doesn't end it."""
    until = time.monotonic() + seconds
    while time.monotonic() < until and query.isActive:
        if (said := query.lastProgress) and said["batchId"] >= 0 and said["numInputRows"] == 0 and len(query.recentProgress) > 1:
            break
        time.sleep(0.1)
    failed = query.exception()
    query.stop()
    if failed:
        raise failed
    if time.monotonic() >= until:
        raise TimeoutError("the stream did not settle")


#: groups of runs that ``bounded_stream`` keeps state for; a stream that is started again keeps its number
GROUPS = 4096


class _Held(StatefulProcessor):
    """Chunks of a run are held while they fit. The one that doesn't makes the held ones ``flushed``; it and all after it are ``forwarded``. The run's last chunk
    makes what is still held ``kept``. A group of runs is served by one call, and only runs that go on beyond a batch are in the store, so that short runs cost no
    calls of it."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        # chunks: pairs of seq and n_bytes, eight bytes each
        self.open = handle.getMapState("open", "run_id string", "held long, over boolean, chunks binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        stored = {k[0] for k in self.open.keys()}
        runs, out = {}, []
        for run, seq, n_bytes, last in zip(*(new[c].tolist() for c in ("run_id", "seq", "n_bytes", "last"))):
            run = run if isinstance(run, str) else None
            if run not in runs:
                runs[run] = self._stored(run) if run in stored else [0, False, [], False]
            r = runs[run]
            r[0] += int(n_bytes)
            r[3] |= bool(last)
            if not r[1] and r[0] > self.limit:
                r[1] = True
                out += [(run, *c, "flushed") for c in r[2]]
                r[2] = []
            if r[1]:
                out.append((run, int(seq), int(n_bytes), "forwarded"))
            else:
                r[2].append((int(seq), int(n_bytes)))
        for run, (held, over, chunks, ended) in runs.items():
            if not ended:
                self.open.updateValue((run,), (held, over, np.array(chunks, np.int64).tobytes()))
                continue
            out += [(run, *c, "kept") for c in chunks]
            if run in stored:
                self.open.removeKey((run,))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "n_bytes", "fate"])

    def _stored(self, run: str | None) -> list:
        held, over, chunks = self.open.getValue((run,))
        return [held, over, [tuple(c) for c in np.frombuffer(bytes(chunks), np.int64).reshape(-1, 2).tolist()], False]

    def close(self) -> None:
        pass


def bounded_stream(chunks: DataFrame, limit: int, groups: int = GROUPS) -> DataFrame:
    """``route.bounded`` over a stream of ``chunks(run_id, seq, n_bytes, last)``. Chunks of a run come in order of ``seq`` from batch to batch, and in any order within
    one; ``last`` marks the end of a run, after which its state is gone. A forwarded chunk leaves with the batch it came in. Runs are dealt to ``groups`` by hash; a
    group's chunks of one batch meet in one call."""
    x = chunks.select(F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("part"), "run_id", "seq", "n_bytes", "last")
    return x.groupBy("part").transformWithStateInPandas(_Held(limit), "run_id string, seq long, n_bytes long, fate string", "Append", "None")


class _Goals(StatefulProcessor):
    def __init__(self, ttl: int, state_ms: int):
        self.ttl, self.state_ms = ttl, state_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, goal string, revision long", self.state_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            goal = None if r.goal is None or r.goal != r.goal else r.goal
            if state is None or r.at - state[0] > self.ttl:
                revision = 1
            else:
                revision = state[2] + (goal is not None and state[1] is not None and goal != state[1])
            state = (int(r.at), goal, int(revision))
            out.append((key[0], int(r.at), goal, int(revision)))
        self.last.update(state)
        yield pd.DataFrame(out, columns=["session_id", "at", "goal", "revision"])

    def close(self) -> None:
        pass


def goal_revision_stream(goals: DataFrame, ttl: int = 24 * 3600, state_ms: int = DAY_MS) -> DataFrame:
    """``state.goal_revisions`` over a stream of ``goals(session_id long, at, goal)``, in order of ``at`` from batch to batch. A session's state is its last goal. It
    expires by ``at`` after ``ttl``, as in batch, and leaves the store, whatever the clock of the rows, ``state_ms`` after its last update, from when on
    revisions begin at 1."""
    return goals.select("session_id", "at", "goal").groupBy("session_id").transformWithStateInPandas(_Goals(ttl, state_ms), "session_id long, at long, goal string, revision long", "Append", "ProcessingTime")


class _InForce(StatefulProcessor):
    """Runs wait until the watermark has passed them: then every goal that counts has come. Of goals that the watermark has passed only the last is kept."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.goals = handle.getListState("goals", "at long, goal string")
        self.runs = handle.getListState("runs", "at long, run_id long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        goals, runs = [], []
        for r in pd.concat(list(rows)).itertuples():
            if r.is_run:
                runs.append((int(r.at), int(r.run_id)))
                self.handle.registerTimer((int(r.at) + 1) * 1000 + 1)  # past its own second: goals of the same moment count
            else:
                goals.append((int(r.at), r.goal))
        if goals:
            self.goals.appendList(goals)
        if runs:
            self.runs.appendList(runs)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() - 1) // 1000 - 1
        goals, runs = sorted(self.goals.get(), key=lambda g: g[0]), list(self.runs.get())
        before = [g for g in goals if g[0] <= at]
        now = [r for r in runs if r[0] == at]
        goal = before[-1][1] if before and at - before[-1][0] <= self.ttl else None
        self._put(self.runs, [r for r in runs if r[0] != at])
        self._put(self.goals, before[-1:] + [g for g in goals if g[0] > at])
        if now:
            yield pd.DataFrame([(key[0], run, at, goal) for _, run in now], columns=["session_id", "run_id", "at", "goal"])

    @staticmethod
    def _put(state: Any, rows: list) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def goal_as_of_stream(runs: DataFrame, goals: DataFrame, delay: str, ttl: int = 24 * 3600) -> DataFrame:
    """``state.goal_as_of`` over streams of ``runs(session_id long, run_id, at)`` and ``goals(session_id long, at, goal)``, ``at`` in seconds from 0 on, in any order within ``delay``. A run is
    answered once the watermark has passed it. A goal or run that is later than the watermark is dropped: answers that are out are never changed."""
    g = goals.select("session_id", "at", F.lit(None).cast("long").alias("run_id"), "goal", F.lit(False).alias("is_run"))
    r = runs.select("session_id", "at", F.col("run_id").cast("long").alias("run_id"), F.lit(None).cast("string").alias("goal"), F.lit(True).alias("is_run"))
    # a second later than it is: the first watermark is 0, and what isn't after the watermark is late
    both = g.unionByName(r).withColumn("time", F.timestamp_seconds(F.col("at") + 1)).withWatermark("time", delay)
    return both.groupBy("session_id").transformWithStateInPandas(_InForce(ttl), "session_id long, run_id long, at long, goal string", "Append", "EventTime")
