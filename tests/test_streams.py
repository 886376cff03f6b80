"""Streams against their batch forms, over several batches, shuffled arrival and a restart from the checkpoint."""

from __future__ import annotations

import random
import time

import pytest

from siftspark.operators import route
from siftspark.streaming import keyed, state


class Feed:
    """Batches written one by one as files, and the stream that reads one file a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema, self.n = spark, str(folder / "in"), schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.02)  # files are taken in the order of their times

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def drained(stream, folder, timed=False):
    """Runs a stream until its input is used up; its checkpoint and output are in ``folder``."""
    q = keyed.started(stream, str(folder / "ck"), lambda w: w.format("parquet").option("path", str(folder / "out")), available_now=not timed)
    if timed:
        keyed.settled(q, 120)
    else:
        assert q.awaitTermination(180)
    return stream.sparkSession.read.schema(stream.schema).parquet(str(folder / "out"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bounded_output(spark, tmp_path):
    schema, rng = "run_id string, seq long, n_bytes long, last boolean", random.Random(4)
    runs = {f"r{i}": [rng.randint(0, 40) for _ in range(rng.randint(1, 12))] for i in range(12)} | {"edge": [50, 50], "over": [50, 51], "one": [200], "empty": [0]}
    rows = [(r, i, n, i == len(ns) - 1) for r, ns in runs.items() for i, n in enumerate(ns)]
    feed = Feed(spark, tmp_path, schema)
    parts = [[x for x in rows if x[1] < 2], [x for x in rows if 2 <= x[1] < 5], [x for x in rows if 5 <= x[1] < 7], [x for x in rows if x[1] >= 7]]
    for part in parts[:2]:
        rng.shuffle(part)
        feed.put(part)
    drained(keyed.bounded_stream(feed.stream(), 100), tmp_path)
    for part in parts[2:]:  # a restart: state comes back from the checkpoint
        feed.put(part)
    got = drained(keyed.bounded_stream(feed.stream(), 100), tmp_path)
    assert rows_of(got) == rows_of(route.bounded(spark.createDataFrame(rows, schema).drop("last"), 100))


def test_forwarded_chunks_do_not_wait_for_the_end(spark, tmp_path):
    feed = Feed(spark, tmp_path, "run_id string, seq long, n_bytes long, last boolean")
    feed.put([("a", 0, 60, False), ("a", 1, 60, False), ("b", 0, 10, False)])
    got = drained(keyed.bounded_stream(feed.stream(), 100), tmp_path)
    assert rows_of(got) == [("a", 0, 60, "flushed"), ("a", 1, 60, "forwarded")]


def test_goal_revisions(spark, tmp_path):
    schema = "session_id long, at long, goal string"
    rows = [(1, 0, "a"), (1, 3, "a"), (1, 5, "b"), (1, 40, "b"), (1, 41, "c"), (2, 2, "x"), (2, 12, "y"), (2, 23, "y"), (3, 7, None), (3, 8, "z")]
    feed = Feed(spark, tmp_path, schema)
    for upto in ((0, 5), (5, 20)):
        feed.put([r for r in rows if upto[0] <= r[1] < upto[1]])
    drained(keyed.goal_revision_stream(feed.stream(), ttl=10), tmp_path, timed=True)
    feed.put([r for r in rows if r[1] >= 20][::-1])
    got = drained(keyed.goal_revision_stream(feed.stream(), ttl=10), tmp_path, timed=True)
    want = state.goal_revisions(spark.createDataFrame(rows, schema), ttl=10)
    assert rows_of(got) == rows_of(want)
    assert {(r["session_id"], r["at"]): r["revision"] for r in want.collect()}[1, 40] == 1


def test_goals_leave_the_store(spark, tmp_path):
    """State that outlives its time is gone even if the rows' own clock says otherwise."""
    feed = Feed(spark, tmp_path, "session_id long, at long, goal string")
    feed.put([(1, 0, "a"), (1, 1, "b")])
    drained(keyed.goal_revision_stream(feed.stream(), state_ms=1), tmp_path, timed=True)
    time.sleep(0.1)
    feed.put([(1, 2, "c")])
    got = drained(keyed.goal_revision_stream(feed.stream(), state_ms=1), tmp_path, timed=True)
    assert rows_of(got) == [(1, 0, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1)]


def test_goal_in_force(spark, tmp_path):
    rng = random.Random(9)
    goals = [(s, at, f"g{s}-{at}") for s in range(6) for at in sorted(rng.sample(range(0, 400), 8))]
    runs = [(s, 1000 * s + i, rng.randint(0, 400)) for s in range(6) for i in range(15)] + [(9, 1, 50)] + [(s, 1000 * s + 500 + i, at) for i, (s, at, _) in enumerate(goals[::3])]
    rows = [(s, at, None, g, False) for s, at, g in goals] + [(s, at, run, None, True) for s, run, at in runs]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 90))  # within the delay of 100 seconds
    schema = "session_id long, at long, run_id long, goal string, is_run boolean"
    feed = Feed(spark, tmp_path, schema)

    def stream():
        x = feed.stream()
        return keyed.goal_as_of_stream(x.where("is_run").select("session_id", "run_id", "at"), x.where("not is_run").select("session_id", "at", "goal"), "100 seconds", ttl=60)

    for i in range(0, len(rows), 40):
        feed.put(rows[i : i + 40])
        if i == 80:
            drained(stream(), tmp_path)
    feed.put([(99, 10_000, None, "ends all", False)])
    drained(stream(), tmp_path)
    feed.put([(0, 5, None, "late", False), (0, 6, 77, None, True)])  # later than the watermark: dropped
    got = drained(stream(), tmp_path)
    want = state.goal_as_of(spark.createDataFrame(runs, "session_id long, run_id long, at long"), spark.createDataFrame(goals, "session_id long, at long, goal string"), ttl=60)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("before", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_the_setting_of_the_session_stays(spark, tmp_path, before):
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, before) if before else spark.conf.unset(name)
    now = spark.conf.get(name, None)
    feed = Feed(spark, tmp_path, "session_id long, at long, goal string")
    feed.put([(1, 0, "a")])
    drained(keyed.goal_revision_stream(feed.stream()), tmp_path, timed=True)
    assert spark.conf.get(name, None) == now
    spark.conf.set(name, held) if held else spark.conf.unset(name)


def test_short_runs_cost_no_calls_of_the_store():
    import pandas as pd

    class Open(dict):
        calls = 0

        def __getattr__(self, name):
            def call(key, value=None):
                self.calls += 1
                return {"getValue": self.get, "removeKey": self.pop}[name](key) if value is None else self.update({key: value})

            return call

    class Handle:
        def __init__(self):
            self.open = Open()

        def getMapState(self, *_):
            return self.open

    handle, held = Handle(), keyed._Held(100)
    held.init(handle)
    rows = [(f"r{i}", i * 10 + k, 40, k == i % 4) for i in range(500) for k in range(i % 4 + 1)]
    batch = lambda rows: pd.DataFrame(rows, columns=["run_id", "seq", "n_bytes", "last"])
    got = pd.concat(held.handleInputRows((0,), iter([batch(rows)]), None))
    assert handle.open.calls == 0 and len(got) == len(rows) and set(got["fate"]) == {"kept", "flushed", "forwarded"}
    assert not list(held.handleInputRows((0,), iter([batch([("a", 1, 60, False), (None, 1, 5, False)])]), None)) and handle.open.calls == 2
    got = pd.concat(held.handleInputRows((0,), iter([batch([(None, 2, 5, True), ("a", 2, 60, True)])]), None))
    assert set(got.itertuples(index=False, name=None)) == {("a", 1, 60, "flushed"), ("a", 2, 60, "forwarded"), (None, 1, 5, "kept"), (None, 2, 5, "kept")} and not handle.open
