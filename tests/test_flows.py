"""Hook events and remembered decisions, as streams against their batch forms, with replayed batches."""

from __future__ import annotations

import json
import shutil

from siftspark.operators import rank
from siftspark.streaming import flows
from test_streams import Feed, rows_of


def events():
    quiet = "".join(f"test t::case_{i} ... ok\n" for i in range(60))
    texts = [quiet, quiet + "test t::x ... FAILED\n", "short\n", "", "word " * 50, "output truncated\n", None, "retry the very same thing now\n" * 40]
    return [{"event_id": f"e{i}", "session_id": "bad id!" if i == 9 else f"s{i % 3}", "tool": "shell", "output": texts[i % len(texts)], "exit_code": i % 2} for i in range(16)]


def test_delivery_of_hook_events(spark):
    got = {r["event_id"]: r for r in flows.deliver(spark.createDataFrame([tuple(e.values()) for e in events()], flows.EVENTS)).collect()}
    assert len(got) == 16
    assert got["e0"]["replaced"] and got["e0"]["delivered_bytes"] == len(got["e0"]["output"].encode()) < got["e0"]["raw_bytes"]
    assert "FAILED" in got["e1"]["output"] and "exit=1" in got["e1"]["output"]
    assert [got[f"e{i}"]["bypass"] for i in (2, 3, 5, 6, 9)] == ["already_lean", "already_lean", "truncated", "no_output", "invalid_session"]
    assert all(got[k]["output"] is None and got[k]["delivered_bytes"] == got[k]["raw_bytes"] for k in ("e2", "e3", "e5", "e6", "e9"))
    assert flows.deliver(spark.createDataFrame([], flows.EVENTS)).collect() == []


def test_stream_equals_batch_and_a_replay_changes_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path, "value string")
    lines = [(json.dumps(e),) for e in events()]
    feed.put([*lines[:6], ("{broken",)])
    feed.put(lines[6:])
    path, ck = str(tmp_path / "out"), tmp_path / "ck"
    want = rows_of(flows.deliver(spark.createDataFrame([tuple(e.values()) for e in events()], flows.EVENTS)))

    def run():
        assert flows.deliver_stream(feed.stream(), path, str(ck)).awaitTermination(180)
        return rows_of(flows.read_batches(spark, path, flows.DELIVERED))

    assert run() == want
    (ck / "commits" / "1").unlink()  # as if the driver died after the sink, before the commit
    for crc in (ck / "commits").glob(".1.crc"):
        crc.unlink()
    assert run() == want


def decision(key, at, need=1.0):
    return (key, 2, "ranker-1", 0.9, need, ["a"], at)


def test_replays_within_and_outside_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 2) + timedelta(seconds=s)
    feed = Feed(spark, tmp_path, f"{flows.DECISIONS}, at timestamp")
    path, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: flows.remember_stream(feed.stream(), path, ck, "10 seconds").awaitTermination(180)
    feed.put([decision("k1", at(0)), decision("k2", at(1))])
    feed.put([decision("k1", at(5), 9.0), decision("k3", at(6))])  # within
    feed.put([decision("k4", at(500))])  # the watermark passes
    assert run()
    feed.put([decision("k1", at(600), 8.0), decision("k5", at(601)), decision("k5", at(601), 1.0)])  # outside: the store has it
    assert run()
    got = {r["cache_key"]: r["need"] for r in flows.read_batches(spark, path, flows.DECISIONS).collect()}
    assert got == {f"k{i}": 1.0 for i in range(1, 6)}
    assert flows.read_batches(spark, path, flows.DECISIONS).count() == 5


def test_remember_keeps_what_is_there(spark):
    new = spark.createDataFrame([decision("a", None, 3.0)[:6], decision("b", None, 2.0)[:6], decision("b", None, 1.0)[:6]], flows.DECISIONS)
    got = rank.remember(new, spark.createDataFrame([decision("a", None)[:6]], flows.DECISIONS)).collect()
    assert [(r["cache_key"], r["need"]) for r in got] == [("b", 1.0)]


def test_nothing_written_yet(spark, tmp_path):
    assert flows.read_batches(spark, str(tmp_path / "none"), flows.DECISIONS).collect() == []
    shutil.rmtree(tmp_path)
