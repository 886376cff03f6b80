from __future__ import annotations

from siftspark.streaming import state

ROWS = [(1, 0, 0, "a"), (1, 1, 0, "a"), (1, 2, 0, "b"), (1, 3, 1, "b"), (1, 4, 0, "a"), (2, 0, 5, "x"), (2, 1, 5, "y"), (2, 2, 6, "y")]
WANT = {(1, 0): "accepted", (1, 1): "same", (1, 2): "conflict", (1, 3): "accepted", (1, 4): "stale", (2, 0): "accepted", (2, 1): "conflict", (2, 2): "accepted"}
SCHEMA = "session_id long, seq long, revision long, content string"


def test_task_revisions_in_batch(spark):
    got = state.task_revisions(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert {(r["session_id"], r["seq"]): r["outcome"] for r in got} == WANT


def test_task_revisions_as_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(0, len(ROWS), 3):
        spark.createDataFrame(ROWS[i : i + 3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = state.task_revision_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["session_id"], r["seq"]): r["outcome"] for r in spark.table("judged").collect()}
    assert got == WANT


def test_goal_revisions_restart_after_expiry(spark):
    g = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, "b"), (1, 90, "b")], "session_id long, at long, goal string")
    got = state.goal_revisions(g, ttl=10).orderBy("at").collect()
    assert [r["revision"] for r in got] == [1, 1, 2, 1]


def test_goal_in_force_at_a_run(spark):
    g = spark.createDataFrame([(1, 0, "a"), (1, 5, "b")], "session_id long, at long, goal string")
    r = spark.createDataFrame([(1, 7, 4), (1, 8, 5), (1, 9, 40), (2, 1, 3)], "session_id long, run_id long, at long")
    got = {x["run_id"]: x["goal"] for x in state.goal_as_of(r, g, ttl=10).collect()}
    assert got == {7: "a", 8: "b", 9: None, 1: None}


def test_purge_keeps_packs_of_live_captures(spark):
    c = spark.createDataFrame([("a", 0), ("b", 100)], "capture_id string, at long")
    p = spark.createDataFrame([("a", 1), ("b", 2)], "capture_id string, pack long")
    live, packs = state.purge(c, p, now=60, ttl=50)
    assert [r["capture_id"] for r in live.collect()] == ["b"] and [r["pack"] for r in packs.collect()] == [2]
