"""Hook events end to end, and decisions remembered once: batch pipelines, and the streams that run them batch by batch.

A batch's rows are written to a folder named by its number, whole. A batch that is replayed after a failure writes the same folder again, so it changes
nothing, and readers see a batch's rows at once or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from siftspark.functions import text as X
from siftspark.operators import pack, rank, reduce, route
from siftspark.store import dealt, materialize, shared_dir
from siftspark.streaming.keyed import settled, started

EVENTS = "event_id string, session_id string, tool string, output string, exit_code int"
DELIVERED = "event_id string, session_id string, raw_bytes long, bypass string, replaced boolean, delivered_bytes long, output string"
DECISIONS = "cache_key string, schema_version int, model string, exists_p double, need double, kept_ids array<string>"


def deliver(events: DataFrame, budget: int = 64 << 10, kind: str = "auto") -> DataFrame:
    """What each hook event (``EVENTS``) delivers (``DELIVERED``): its output is captured, planned, packed and rendered; the rendered pack takes its place where it
    stands. ``output`` is null where nothing is replaced. An event whose output isn't to be replaced is answered with why. Ids name an event once."""
    judged = materialize(route.tool_output(events).withColumn("raw_bytes", F.octet_length("output").cast("long")), "judged")  # read by its lines, their count, views and the answer
    captured = judged.where("skip is null").select(F.col("event_id").alias("capture_id"), F.lit("stdout").alias("stream"), F.col("output").alias("text"))
    lines = X.explode_lines(captured)
    planned = reduce.tiny_gaps(reduce.plan(dealt(lines, lines), kind))
    planned = materialize(planned.select("capture_id", "stream", "line_no", "byte_start", "byte_end", "line", "reason", "plan_error"), "planned")  # read by blocks, omissions and errors
    planned = dealt(planned, planned)
    gone = pack.omissions(planned).groupBy("capture_id").agg(F.count("*").alias("n_omissions"))
    shown = pack.views(planned, judged.select(F.col("event_id").alias("capture_id"), "exit_code"))
    errors = pack.plan_errors(planned)
    x = judged.join(shown.select(F.col("capture_id").alias("event_id"), "view"), "event_id", "left")
    x = x.join(gone.withColumnRenamed("capture_id", "event_id"), "event_id", "left").join(errors.withColumnRenamed("capture_id", "event_id"), "event_id", "left")
    no, size = F.lit(False), F.octet_length("view").cast("long")
    why = pack.decision(no, no, F.lit(kind == "search"), F.col("exit_code"), F.col("plan_error"), F.lit("deterministic"), F.coalesce("n_omissions", F.lit(0)), size, F.col("raw_bytes"), F.lit(budget))
    x = x.withColumn("reason", F.coalesce("skip", F.when(F.col("raw_bytes") == 0, "already_lean"), why))
    x = x.withColumn("rendered_bytes", F.when(F.col("reason").isNull(), size)).withColumn("overflow", no).withColumn("store_error", F.lit(None).cast("string"))
    out = pack.delivery(x, budget)
    return out.select("event_id", "session_id", F.coalesce("raw_bytes", F.lit(0)).alias("raw_bytes"), "bypass", "replaced", F.coalesce("delivered_bytes", F.lit(0)).alias("delivered_bytes"), F.when(F.col("replaced"), F.col("view")).alias("output"))


def by_batch(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Runs ``step`` on each batch and writes its result to ``path``/batch=number, in place of what an earlier try of the batch left there."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return started(stream, checkpoint, lambda w: w.foreachBatch(write), available_now)


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """What ``by_batch`` wrote, of batches before a number if one is given; no rows where nothing was written yet."""
    try:
        found = spark.read.schema(f"{schema}, batch long").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return (found if before is None else found.where(F.col("batch") < before)).drop("batch")


def in_parts(parts: list[DataFrame], flow: Callable[[DataFrame], DataFrame], timed: bool = False) -> DataFrame:
    """What a stream makes of tables that arrive one after the other: each is appended to the stream's folder, and the stream is started again from its checkpoint until it
    has used it up. ``timed``: the stream's state goes by the clock."""
    spark, folder = parts[0].sparkSession, f"{shared_dir(parts[0].sparkSession)}/siftspark-stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out = flow(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        query = started(out, f"{folder}/checkpoint", lambda w: w.format("parquet").option("path", f"{folder}/out"), available_now=not timed)
        settled(query) if timed else query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def deliver_stream(lines: DataFrame, path: str, checkpoint: str, budget: int = 64 << 10) -> StreamingQuery:
    """``deliver`` over a stream of JSON lines (``value``); malformed ones are passed over. Answers are under ``path``."""
    from siftspark.sources.adapters import read_events

    return by_batch(read_events(lines, EVENTS).where("event_id is not null"), path, checkpoint, lambda batch, _: deliver(batch, budget))


def remember_stream(decisions: DataFrame, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Keeps each decision of a stream (``DECISIONS`` and a time ``at``) once. Replays within ``delay`` are dropped by the stream's state, older ones because the store under
    ``path`` has their key: what came first stays."""
    once = decisions.withWatermark("at", delay).dropDuplicatesWithinWatermark(["cache_key"]).drop("at")

    def step(batch: DataFrame, number: int) -> DataFrame:
        return rank.remember(batch, read_batches(batch.sparkSession, path, DECISIONS, before=number))

    return by_batch(once, path, checkpoint, step)
