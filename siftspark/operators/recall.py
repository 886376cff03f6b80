"""Recall: exact bytes of captures by section, byte range or line range, and lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions.text import canonical_hash


def status(now: Column, ttl_hours: int = 24) -> Column:
    """What a capture row is good for: missing, expired, corrupt or ok."""
    age = F.col("created_at") + F.expr(f"interval {ttl_hours} hours")
    sound = F.col("raw_sha256") == canonical_hash(F.col("stdout"), F.col("stderr"))
    return F.when(F.col("stdout").isNull(), "missing").when(age < now, "expired").when(~sound, "corrupt").otherwise("ok")


def resolve(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Full ids of requested prefixes of eight characters or more; ``error`` where none or several match. The join is an
    equality on eight characters."""
    short = captures.select(F.col("capture_id").alias("full"), F.substring("capture_id", 1, 8).alias("k"))
    x = requests.withColumn("k", F.substring("prefix", 1, 8)).join(short, "k", "left")
    g = x.groupBy("request_id", "prefix").agg(F.count_if(F.col("full").startswith(F.col("prefix"))).alias("n"), F.min(F.when(F.col("full").startswith(F.col("prefix")), F.col("full"))).alias("full"))
    error = F.when(F.length("prefix") < 8, "invalid_id").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "invalid_id")
    return g.select("request_id", F.when(error.isNull(), F.col("full")).alias("capture_id"), error.alias("error"))


def newest(captures: DataFrame) -> DataFrame:
    return captures.agg(F.max_by("capture_id", "created_at").alias("capture_id"))


def by_section(requests: DataFrame, captures: DataFrame, omissions: DataFrame) -> DataFrame:
    """The bytes of requested sections; ``error`` for unknown ones."""
    one = omissions.withColumn("nth", F.row_number().over(W.partitionBy("capture_id", "section_id").orderBy("byte_start"))).where("nth = 1").drop("nth")
    x = requests.join(one.select("capture_id", "section_id", "byte_start", "byte_end"), ["capture_id", "section_id"], "left").join(captures.select("capture_id", "stdout", "stderr"), "capture_id", "left")
    raw = F.when(F.col("section_id").startswith("stderr-"), F.col("stderr")).otherwise(F.col("stdout")).cast("binary")
    part = F.substring(raw, (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    return x.select("capture_id", "section_id", part.alias("bytes"), F.when(F.col("byte_start").isNull(), "invalid_range").alias("error"))


def by_bytes(requests: DataFrame, captures: DataFrame) -> DataFrame:
    """Byte ranges [start, end) of stdout; a range that isn't inside fails."""
    x = requests.join(captures.select("capture_id", F.col("stdout").cast("binary").alias("raw")), "capture_id", "left")
    fine = (F.col("start") <= F.col("end")) & (F.col("start") >= 0) & (F.col("end") <= F.octet_length("raw"))
    return x.select("capture_id", "start", "end", F.when(fine, F.substring("raw", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("bytes"), F.when(F.col("raw").isNull(), "missing").when(~fine, "invalid_range").alias("error"))


def by_lines(requests: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines a to b, from 1 and inclusive; beyond the end is an error, not a shorter answer."""
    x = requests.join(lines.select("capture_id", "line_no", "line"), "capture_id", "left")
    n = F.max("line_no") + 1
    inside = (F.col("line_no") + 1).between(F.col("a"), F.col("b"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("line_no", "line")))), lambda s: s["line"]), "")
    g = x.groupBy("capture_id", "a", "b").agg(n.alias("n"), text.alias("text"))
    bad = F.coalesce((F.col("a") < 1) | (F.col("a") > F.col("b")) | (F.col("b") > F.col("n")), F.lit(True))
    return g.select("capture_id", "a", "b", F.when(~bad, F.col("text")).alias("text"), F.when(F.col("n").isNull(), "missing").when(bad, "invalid_range").alias("error"))


def captured_size(runs: DataFrame, limit: int) -> DataFrame:
    """Chunks (run_id, seq, data) with their running size and whether the limit was passed by then."""
    total = F.sum(F.octet_length("data").cast("long")).over(W.partitionBy("run_id").orderBy("seq"))
    return runs.withColumn("so_far", total).withColumn("bypassed", F.max(F.col("so_far") > limit).over(W.partitionBy("run_id")))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, sha256): missing, extra or changed."""
    x = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return x.withColumn("change", F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")).where("change is not null").select("path", "change")


def conflicts(new: DataFrame, old: DataFrame, keys: list[str], content: str) -> DataFrame:
    """New immutable rows: append where the key is free, same where the content is equal, conflict otherwise."""
    x = new.join(old.select(*keys, F.col(content).alias("__old")), keys, "left")
    return x.withColumn("outcome", F.when(F.col("__old").isNull(), "append").when(F.col("__old") == F.col(content), "same").otherwise("conflict")).drop("__old")


def store_bytes(captures: DataFrame, *columns: str) -> DataFrame:
    """(n, n_bytes): how many captures a store has and the bytes of their texts."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    return captures.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("n_bytes"))
