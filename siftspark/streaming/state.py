"""Keyed state over time: session goals, task revisions and retention, in batch and as streams with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def goal_revisions(goals: DataFrame, ttl: int = 24 * 3600) -> DataFrame:
    """``goals(session_id, at, goal)`` (seconds) with the revision each makes: one more where the text differs from the goal before
    it, and from 1 again after an unheard day."""
    w = W.partitionBy("session_id").orderBy("at")
    fresh = F.lag("at").over(w).isNull() | (F.col("at") - F.lag("at").over(w) > ttl)
    x = goals.withColumn("fresh", F.when(fresh, 1).otherwise(0)).withColumn("new", F.when(fresh | (F.lag("goal").over(w) != F.col("goal")), 1).otherwise(0))
    x = x.withColumn("era", F.sum("fresh").over(w))
    return x.withColumn("revision", F.sum("new").over(W.partitionBy("session_id", "era").orderBy("at")).cast("long")).drop("fresh", "new", "era")


def goal_as_of(runs: DataFrame, goals: DataFrame, ttl: int = 24 * 3600) -> DataFrame:
    """The goal in force at each run (session_id, run_id, at): the last before it, unless it has expired. Both sides are sorted
    together by session, so the join is one shuffle."""
    g = goals.select("session_id", "at", F.lit(None).cast("long").alias("run_id"), F.struct(F.col("at").alias("since"), "goal").alias("g"))
    r = runs.select("session_id", "at", F.col("run_id").cast("long").alias("run_id"), F.lit(None).cast(g.schema["g"].dataType).alias("g"))
    w = W.partitionBy("session_id").orderBy("at", F.col("run_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    x = g.unionByName(r).withColumn("last", F.last("g", ignorenulls=True).over(w)).where("run_id is not null")
    return x.select("session_id", "run_id", "at", F.when(F.col("at") - F.col("last.since") <= ttl, F.col("last.goal")).alias("goal"))


_TASKS = "session_id long, seq long, revision long, content string, outcome string"


def _judge(rows: Iterator[tuple], state: tuple[int, str] | None = None) -> Iterator[tuple]:
    for session, seq, revision, content in rows:
        if state is None or revision > state[0]:
            state, outcome = (revision, content), "accepted"
        elif revision < state[0]:
            outcome = "stale"
        else:
            outcome = "same" if content == state[1] else "conflict"
        yield (session, seq, revision, content, outcome, state)


def task_revisions(tasks: DataFrame) -> DataFrame:
    """``tasks(session_id, seq, revision, content)`` judged in order: an older revision is stale, the same one with other content
    a conflict, and neither moves the state. A window suffices: the state after any row is the greatest revision so far,
    with the content that first brought it."""
    w = W.partitionBy("session_id").orderBy("seq")
    top = F.max("revision").over(w.rowsBetween(W.unboundedPreceding, -1))
    first = F.first("content").over(W.partitionBy("session_id", "revision").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    x = tasks.withColumn("top", top).withColumn("first", first)
    out = F.when(F.col("top").isNull() | (F.col("revision") > F.col("top")), "accepted").when(F.col("revision") < F.col("top"), "stale").when(F.col("content") == F.col("first"), "same").otherwise("conflict")
    return x.withColumn("outcome", out).drop("top", "first")


def task_revision_stream(tasks: DataFrame) -> DataFrame:
    """``task_revisions`` over a stream; the state is the last accepted revision and content of a session, for a day."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values("seq")
        out = list(_judge(rows[["session_id", "seq", "revision", "content"]].itertuples(index=False, name=None), held))
        if out:
            state.update(out[-1][5])
            state.setTimeoutDuration(24 * 3600 * 1000)
            yield pd.DataFrame([r[:5] for r in out], columns=["session_id", "seq", "revision", "content", "outcome"])

    return tasks.groupBy("session_id").applyInPandasWithState(step, _TASKS, "revision long, content string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def superseded(results: DataFrame, accepted: DataFrame) -> DataFrame:
    """Results (session_id, run_id, revision, start, end) and whether a newer revision was accepted while they ran, after their start and not after
    their end. Acceptances and the starts and ends of runs are one stream of a session in order of time, with the greatest revision so far: a run that wasn't behind at its start
    is superseded if it is at its end. Only runs that were behind at their start already are held against the acceptances themselves."""
    keys = ["session_id", "run_id"]
    none = lambda name: F.lit(None).cast("long").alias(name)
    said = accepted.select("session_id", F.col("at").cast("long").alias("at"), F.col("revision").cast("long").alias("r"), none("run_id"), none("start"))
    edge = lambda name: results.select("session_id", F.col(name).cast("long").alias("at"), none("r"), F.col("run_id").cast("long").alias("run_id"), F.lit(int(name == "start")).cast("long").alias("start"))
    w = W.partitionBy("session_id").orderBy("at", F.col("run_id").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    seen = said.unionByName(edge("start")).unionByName(edge("end")).withColumn("top", F.max("r").over(w)).where("run_id is not null")
    tops = seen.groupBy(*keys).agg(F.max(F.when(F.col("start") == 1, F.col("top"))).alias("__first"), F.max(F.when(F.col("start") == 0, F.col("top"))).alias("__last"))
    x = results.join(tops, keys, "left")
    behind = F.coalesce(F.col("__first") > F.col("revision"), F.lit(False))
    a = accepted.select("session_id", F.col("revision").alias("__r"), F.col("at").alias("__t"))
    hit = x.where(behind).join(a, "session_id").where("__r > revision and __t > start and __t <= end").select(*keys).distinct().withColumn("__hit", F.lit(True))
    x = x.join(hit, keys, "left")
    later = F.coalesce(F.col("__last") > F.col("revision"), F.lit(False)) & (F.col("end") > F.col("start"))
    return x.withColumn("superseded", F.when(behind, F.coalesce("__hit", F.lit(False))).otherwise(later)).drop("__first", "__last", "__hit")


def retain(rows: DataFrame, at: str, now: int, ttl: int = 24 * 3600) -> DataFrame:
    """Rows that haven't expired by ``now``: expiry is strict."""
    return rows.where(F.col(at) + ttl >= now)


def purge(captures: DataFrame, packs: DataFrame, now: int, ttl: int = 24 * 3600) -> tuple[DataFrame, DataFrame]:
    """Captures that remain, and the packs of those."""
    gone = captures.where(F.col("at") + ttl < now).select("capture_id")
    return retain(captures, "at", now, ttl), packs.join(gone, "capture_id", "left_anti")
