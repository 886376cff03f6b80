"""Packs: what a plan hides and shows, as byte ranges that recall can give back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.reduce import DUPLICATE, KEY, PROGRESS_OF_TESTS, SILENT, TESTS, by_line, islands, whole

LABELS = {"successful_test_inventory": "passing tests", "test_progress": "progress lines", "repeated_identical_lines": "identical lines", "similar_lines": "similar lines", "long_output_middle": "lines from the middle"}
PACK_VERSION = "siftspark-1"


def omissions(planned: DataFrame) -> DataFrame:
    """Maximal hidden runs of one reason (progress counts with tests): ``section_id`` ``stream-start-end``, the byte range, and
    how many tests, or else lines, it holds. ``planned`` has byte_start and byte_end."""
    key = F.when(F.col("reason") == PROGRESS_OF_TESTS, TESTS).otherwise(F.col("reason"))
    x = planned.withColumn("g", F.coalesce(key, F.lit("")))
    x = islands(x, F.col("g") != F.lag("g").over(by_line())).where("g <> ''")
    per = x.groupBy(*KEY, "island", "g").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.count("*").alias("lines"), F.count_if(F.col("reason") == TESTS).alias("tests"))
    reason = F.when((F.col("g") == TESTS) & (F.col("tests") == 0), PROGRESS_OF_TESTS).otherwise(F.col("g"))
    count = F.when((F.col("g") == TESTS) & (F.col("tests") > 0), F.col("tests")).otherwise(F.col("lines"))
    return per.select(*KEY, F.format_string("%s-%d-%d", "stream", "byte_start", "byte_end").alias("section_id"), "byte_start", "byte_end", count.cast("long").alias("factual_count"), reason.alias("reason"))


def blocks(planned: DataFrame) -> DataFrame:
    """Maximal visible byte ranges with their text and its hash."""
    x = islands(planned.withColumn("v", F.col("reason").isNull()), F.col("v") != F.lag("v").over(by_line())).where("v")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "")
    per = x.groupBy(*KEY, "island").agg(F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), text.alias("rendered_text"))
    return per.select(*KEY, "byte_start", "byte_end", F.sha2(F.col("rendered_text").cast("binary"), 256).alias("sha256"), "rendered_text")


def facts(planned: DataFrame) -> DataFrame:
    """Facts on visible lines, but for diffs."""
    return planned.where("reason is null and fact is not null and kind <> 'diff'").select(*KEY, F.col("fact").alias("kind"), F.col("t").alias("value"), F.lit("capture").alias("source"), "byte_start", "byte_end")


def protected(planned: DataFrame, captures: DataFrame) -> DataFrame:
    """What a pack must carry: the status and exit code of its process, the task's constraints, and facts on visible lines.
    ``captures(capture_id, status, exit_code, constraints)``; ``constraints`` is an array of texts or null."""
    none = F.lit(None).cast("long")
    said = lambda rows, kind, value, source: rows.select("capture_id", F.lit(None).cast("string").alias("stream"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(source).alias("source"), none.alias("byte_start"), none.alias("byte_end"))
    status = F.when(F.col("status").isin("completed", "interrupted", "tool_error"), F.col("status")).otherwise("unknown")
    return (
        said(captures, "process_status", status, "process")
        .unionByName(said(captures.where("exit_code is not null"), "exit_code", F.col("exit_code").cast("string"), "process"))
        .unionByName(said(captures.withColumn("one", F.explode("constraints")), "user_constraint", F.col("one"), "trusted_task_frame"))
        .unionByName(facts(planned))
    )


def delivery(packs: DataFrame, budget: int) -> DataFrame:
    """What a run delivers: its rendered pack, or its original bytes and why. ``packs(raw_bytes, rendered_bytes, reason, overflow,
    store_error)``; ``rendered_bytes`` is null where there is no pack, for ``reason``."""
    size = F.col("rendered_bytes")
    bypass = (
        F.when(size.isNull() | F.col("overflow"), F.col("reason"))
        .when(size > budget, "rendered_pack_exceeds_budget")
        .when(size >= F.col("raw_bytes"), "rendered_pack_no_net_reduction")
        .when(F.col("store_error").isNotNull(), F.concat(F.lit("pack_store_failed: "), "store_error"))
        .otherwise(F.col("reason"))
    )
    stands = size.isNotNull() & ~F.col("overflow") & (size <= budget) & (size < F.col("raw_bytes")) & F.col("store_error").isNull()
    return packs.withColumn("bypass", bypass).withColumn("replaced", stands).withColumn("delivered_bytes", F.when(stands, size).otherwise(F.col("raw_bytes")))


def summary(planned: DataFrame) -> DataFrame:
    """Lines and bytes shown and hidden of each capture."""
    hid = F.col("reason").isNotNull()
    return planned.groupBy("capture_id").agg(F.count("*").alias("n_lines"), F.count_if(hid).alias("hidden_lines"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.when(hid, F.col("n_bytes")).otherwise(0)).alias("hidden_bytes"))


def decision(binary: Column, partial: Column, search: Column, exit_code: Column, plan_error: Column, mode: Column, n_omissions: Column, view_bytes: Column, raw_bytes: Column, budget: Column) -> Column:
    """Why a capture is delivered as it is; null where the pack stands. The first reason wins."""
    return (
        F.when(binary, "binary_or_invalid_utf8")
        .when(partial, "partial_host_output")
        .when(search & ~F.coalesce(exit_code == 0, F.lit(False)), "search_nonzero_status")
        .when(plan_error.isNotNull(), plan_error)
        .when(mode == "passthrough", "passthrough_mode")
        .when(n_omissions == 0, "already_lean")
        .when(view_bytes > budget, "protected_or_retained_material_exceeds_budget")
        .when(view_bytes >= raw_bytes, "no_net_reduction")
    )


def plan_errors(planned: DataFrame) -> DataFrame:
    """(capture_id, plan_error): why a capture can't be planned, for ``decision``; null where it can."""
    return planned.groupBy("capture_id").agg(F.max("plan_error").alias("plan_error"))


def views(planned: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, omitted, view): a header, blocks and markers by (stdout first, byte start), and how to recall.
    ``captures(capture_id, exit_code)``, and ``constraints``, an array, where the task has any: they come first."""
    gone = omissions(planned)
    label = F.col("reason")
    for k, v in LABELS.items():
        label = F.when(F.col("reason") == k, v).otherwise(label)
    marker = F.concat(F.lit("... "), F.col("factual_count").cast("string"), F.lit(" "), label, F.lit(" hidden ["), F.col("section_id"), F.lit("]\n"))
    parts = blocks(planned).select("capture_id", "stream", "byte_start", F.lit(0).cast("long").alias("n"), F.col("rendered_text").alias("part")).unionByName(gone.select("capture_id", "stream", "byte_start", F.col("factual_count").alias("n"), F.when(F.col("reason").isin(*SILENT), "").otherwise(marker).alias("part")))
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("stream") == "stdout", 0).otherwise(1).alias("s"), F.col("byte_start").alias("b"), F.col("part").alias("p"))))
    per = parts.groupBy("capture_id").agg(F.sum("n").alias("omitted"), F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("body"))
    head = F.format_string("siftspark exit=%s omitted=%d\n", F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown")), F.col("omitted"))
    head = F.concat(head, _constraints(captures, "constraint: "))
    foot = F.when(F.col("omitted") > 0, F.concat(F.lit("recall: siftspark recall "), F.substring("capture_id", 1, 8), F.lit(" --section ID\n"))).otherwise("")
    return per.join(captures, "capture_id").select("capture_id", "omitted", F.concat(head, "body", foot).alias("view"))


def _constraints(captures: DataFrame, before: str) -> Column:
    """A line for each constraint of a task."""
    if "constraints" not in captures.columns:
        return F.lit("")
    return F.array_join(F.transform(F.coalesce("constraints", F.array().cast("array<string>")), lambda c: F.concat(F.lit(before), c, F.lit("\n"))), "")


#: what the verbose view calls hidden lines; others are called as in the compact one
VERBOSE = {"repeated_search_match_content": "repeated search match lines", "adaptive_search_nonselected": "search lines ranked below retained evidence", "successful_cargo_progress": "successful build progress lines", "successful_test_inventory": "lines of successful test inventory"}


def verbose(planned: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, view): the pack spelled out. What ran and how it ended, the task's constraints, how many tests passed, each visible block with its stream and bytes, each
    hidden section with how to recall it. ``captures(capture_id, tool, command_display, exit_code, completeness, coverage)``, and ``constraints`` if the task has any."""
    label = F.col("reason")
    for k, v in {**LABELS, **VERBOSE}.items():
        label = F.when(F.col("reason") == k, v).otherwise(label)
    recall = F.concat(F.lit("recall with `siftspark recall "), F.col("capture_id"), F.lit(" --section "), F.col("section_id"), F.lit("`\n"))
    hidden = omissions(planned).withColumn("part", F.concat(F.lit("- "), F.col("section_id"), F.lit(": "), F.col("factual_count").cast("string"), F.lit(" "), label, F.lit("; "), recall))
    title = F.format_string("\n[%s bytes %d..%d]\n", "stream", "byte_start", "byte_end")
    seen = blocks(planned).withColumn("part", F.concat(title, "rendered_text", F.when(F.col("rendered_text").endswith("\n"), "").otherwise("\n")))
    joined = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("stream") == "stdout", 0).otherwise(1).alias("s"), F.col("byte_start").alias("b"), F.col("part").alias("p")))), lambda x: x["p"]), "")
    ok = F.sum(F.when(F.col("reason") == TESTS, F.col("factual_count")).otherwise(0))
    below = hidden.groupBy("capture_id").agg(joined().alias("sections"), ok.alias("deferred"))
    above = seen.groupBy("capture_id").agg(joined().alias("body"))
    passed = planned.where("reason is null").groupBy("capture_id").agg(F.count("passed").alias("shown"))
    x = captures.join(above, "capture_id", "left").join(below, "capture_id", "left").join(passed, "capture_id", "left").na.fill({"deferred": 0, "shown": 0, "body": ""})
    ended = F.when(F.col("exit_code").isNull(), "UNKNOWN").otherwise(F.concat(F.when(F.col("exit_code") == 0, "SUCCEEDED").otherwise("FAILED"), F.lit(" (exit "), F.col("exit_code").cast("string"), F.lit(")")))
    head = F.concat(F.lit("siftspark: "), F.coalesce("command_display", "tool"), F.lit("\nprocess: "), ended, F.lit("; capture: "), F.col("completeness"), F.lit("; selection: "), F.col("coverage"), F.lit("\ncapture_id: "), F.col("capture_id"), F.lit("\n"))
    tests = F.when(F.col("deferred") > 0, F.format_string("test inventory: %d explicit ok results (%d shown, %d deferred); see process status above\n", F.col("shown") + F.col("deferred"), "shown", "deferred")).otherwise("")
    sections = F.when(F.col("sections").isNotNull(), F.concat(F.lit("\nDeferred exact historical sections:\n"), "sections")).otherwise("")
    foot = F.concat(F.lit("Full historical recall: `siftspark recall "), F.col("capture_id"), F.lit(" --full`\n"))
    return x.select("capture_id", F.concat(head, _constraints(captures, "trusted task constraint: "), tests, "body", sections, foot).alias("view"))


def pack_ids(packs: DataFrame, columns: list[str]) -> DataFrame:
    """``pack_id``: a hash over the version and the columns, each with its length before it."""
    from siftspark.functions.text import length_prefixed

    return packs.withColumn("pack_id", F.sha2(F.concat(length_prefixed(F.lit(PACK_VERSION)), *(length_prefixed(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), 256))


def tiles(planned: DataFrame) -> DataFrame:
    """Per stream, the bytes that neither a block nor an omission covers, or that both do: 0 for a sound pack."""
    size = planned.groupBy(*KEY).agg(F.max("byte_end").alias("size"))
    held = omissions(planned).select(*KEY, "byte_start", "byte_end").unionByName(blocks(planned).select(*KEY, "byte_start", "byte_end"))
    return held.groupBy(*KEY).agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("held")).join(size, list(KEY)).select(*KEY, (F.col("size") - F.col("held")).alias("gap"))


def digest(sections: DataFrame) -> DataFrame:
    """(capture_id, digest): one line for each shape, the first of its kind, with how many more there are."""
    from siftspark.functions.text import shape, template

    x = sections.where(F.col("line").rlike(r"(?U)\S")).withColumn("k", F.when(shape(F.col("line")) == "", template(F.col("line"))).otherwise(shape(F.col("line"))))
    per = x.groupBy("capture_id", "k").agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("at"), F.count("*").alias("n"))
    line = F.concat(F.regexp_replace("line", "[\r\n]+$", ""), F.when(F.col("n") > 1, F.format_string("  [+%d similar]", F.col("n") - 1)).otherwise(""), F.lit("\n"))
    return per.withColumn("line", line).groupBy("capture_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "").alias("digest"))


def hit_sections(lines: DataFrame) -> DataFrame:
    """Search hits of one path with consecutive line numbers: first and last line, byte range and count."""
    from siftspark.functions.text import hit

    x = lines.withColumn("h", hit(F.col("line"))).where("h is not null")
    w = by_line()
    x = islands(x, (F.lag("h.path").over(w) != F.col("h.path")) | (F.lag("h.line").over(w) + 1 != F.col("h.line")))
    per = x.groupBy(*KEY, "island", "h.path").agg(F.min("h.line").alias("first_line"), F.max("h.line").alias("last_line"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.count("*").alias("n"))
    return per.select(*KEY, F.col("island").cast("long").alias("section"), "path", "first_line", "last_line", "byte_start", "byte_end", "n")


__all__ = ["DUPLICATE", "blocks", "decision", "digest", "facts", "hit_sections", "omissions", "pack_ids", "summary", "tiles", "views", "whole"]
