"""Reports over receipts and benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.store import materialize


def gain(receipts: DataFrame) -> DataFrame:
    """Savings in total (null command) and by command, in one pass over grouping sets. Saving and rounding are taken in each group."""
    per = receipts.select(F.coalesce("command", F.lit("unknown")).alias("command"), "raw_bytes", "delivered_bytes", F.exists("coverage", lambda c: c["replaced"]).cast("int").alias("reduced"))
    g = per.cube("command").agg(F.grouping("command").alias("total"), F.count("*").alias("runs"), F.sum("reduced").alias("reduced_runs"), F.sum("raw_bytes").alias("raw"), F.sum("delivered_bytes").alias("delivered"))
    g = g.withColumn("saved", F.greatest(F.lit(0), F.col("raw") - F.col("delivered")))
    return g.select("total", "command", "runs", "reduced_runs", "raw", "delivered", "saved", F.expr("(saved + 3) div 4").alias("saved_tokens"), F.expr("case when raw = 0 then 0 else (10000 * saved) div raw end").alias("saved_bp"))


def top_commands(receipts: DataFrame, n: int = 15) -> DataFrame:
    return gain(receipts).where("total = 0").orderBy(F.desc("saved"), "command").limit(n).drop("total")


def bypasses(receipts: DataFrame) -> DataFrame:
    return receipts.select(F.explode("coverage").alias("c")).where("c.bypass_reason is not null").groupBy(F.col("c.bypass_reason").alias("reason")).agg(F.count("*").alias("n"))


def accounting(receipts: DataFrame, by: str | None = None) -> DataFrame:
    """Requests attempted, succeeded, failed, cached and unknown, tokens and cost, by a column or over all."""
    no = lambda c: F.coalesce(c, F.lit(False))
    out, used = F.col("ranker_call_outcome"), F.col("tokens").isNotNull() | F.col("cost").isNotNull()
    x = receipts.withColumn("cache", no(out == "cache_hit") | no(F.col("ranker_cache_hit")))
    live = ~F.col("cache")
    x = x.withColumn("attempt", live & (no(out.isin("succeeded", "failed")) | no(F.col("ranker_call_attempted")) | used))
    x = x.withColumn("success", live & (no(out == "succeeded") | (out.isNull() & used))).withColumn("failure", live & no(out == "failed"))
    legacy = out.isNull() & (no(F.col("mode") == "adaptive") | F.col("requested_mode").isNotNull() | F.col("adaptive_fallback").isNotNull())
    x = x.withColumn("unknown", live & ~F.col("success") & ~F.col("failure") & (F.col("attempt") | legacy))
    priced = no((F.col("cost") >= 0) & (F.col("currency") == "USD") & ~F.isnan("cost") & (F.col("cost") < float("inf")))
    g = (x.groupBy(by) if by else x.groupBy()).agg(
        F.count_if("attempt").alias("attempted"), F.count_if("success").alias("succeeded"), F.count_if("failure").alias("failed"), F.count_if("cache").alias("cache_hits"), F.count_if("unknown").alias("unknown"),
        F.count_if(live & used).alias("calls"), F.coalesce(F.sum(F.when(live & used, F.coalesce("tokens", F.lit(0)))), F.lit(0)).alias("input_tokens"),
        F.count_if(F.col("attempt") & F.col("tokens").isNull()).alias("missing_tokens"), F.count_if(F.col("attempt") & ~priced).alias("unpriced"),
        F.coalesce(F.sum(F.when(F.col("attempt") & priced, F.round(F.col("cost") * 1_000_000).cast("long"))), F.lit(0)).alias("cost_micros"), F.count("adaptive_fallback").alias("fallbacks"),
    )
    return g.withColumn("input_tokens_complete", (F.col("missing_tokens") == 0) & (F.col("unknown") == 0)).withColumn("cost_complete", (F.col("unpriced") == 0) & (F.col("unknown") == 0))


def session_report(receipts: DataFrame) -> DataFrame:
    """Each session's runs, bytes, recalls and requests, and its cost as far as it is known."""
    sums = receipts.groupBy("session_id").agg(*(F.coalesce(F.sum(f), F.lit(0).cast("long")).alias(n) for n, f in (("raw", "raw_bytes"), ("delivered", "delivered_bytes"), ("recalls", "recalls"), ("recalled_bytes", "recalled_bytes"))), F.count("*").alias("runs"))
    cost = (
        F.when((F.col("attempted") == 0) & (F.col("unknown") == 0), "none (no ranker calls)")
        .when((F.col("unpriced") == F.col("attempted")) & (F.col("unknown") == 0), "unknown (no priced response)")
        .otherwise(F.format_string("$%.8f known; %d attempt(s) unpriced; %d outcome(s) unknown", F.col("cost_micros") / 1e6, "unpriced", "unknown"))
    )
    asked = accounting(receipts, "session_id").select("session_id", "attempted", "succeeded", "failed", "cache_hits", "unknown", "fallbacks", cost.alias("cost"))
    return sums.join(asked, "session_id")


def session_status(receipts: DataFrame) -> DataFrame:
    """Each session's mode (uniform, or mixed), runs by fate, and bytes; run ids only of at most eight runs."""
    any_ = lambda f: F.exists("coverage", f)
    g = receipts.groupBy("session_id").agg(
        F.count("*").alias("runs"), F.countDistinct("mode").alias("modes"), F.min("mode").alias("one"), F.count_if(any_(lambda c: c["captured"])).alias("captured"), F.count_if(any_(lambda c: c["replaced"])).alias("replaced"),
        F.count_if(any_(lambda c: c["bypass_reason"].isNotNull())).alias("bypassed"), F.sum("raw_bytes").alias("raw"), F.sum("delivered_bytes").alias("delivered"), F.sum("recalls").alias("recalls"),
    )
    few = receipts.join(g.where("runs <= 8").select("session_id"), "session_id").groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("run_ids"))
    return g.withColumn("mode", F.when(F.col("modes") == 1, F.col("one")).otherwise("mixed")).join(few, "session_id", "left").drop("modes", "one")


def with_recalls(receipts: DataFrame, recall_log: DataFrame) -> DataFrame:
    """Receipts with the recalls of a log (capture_id, bytes) added to the first receipt of each capture."""
    per = recall_log.groupBy("capture_id").agg(F.count("*").alias("more"), F.sum("bytes").alias("more_bytes"))
    x = receipts.withColumn("nth", F.row_number().over(W.partitionBy("capture_id").orderBy("run_id"))).join(per, "capture_id", "left")
    first = (F.col("nth") == 1) & F.col("capture_id").isNotNull()
    return x.withColumn("recalls", F.col("recalls") + F.when(first, F.coalesce("more", F.lit(0))).otherwise(0)).withColumn("recalled_bytes", F.coalesce("recalled_bytes", F.lit(0)) + F.when(first, F.coalesce("more_bytes", F.lit(0))).otherwise(0)).drop("nth", "more", "more_bytes")


def needles(views: DataFrame, needles_: DataFrame) -> DataFrame:
    """(scenario, arm): how many of the scenario's needles its view holds, and which are missing. An equi-join on the scenario."""
    x = views.join(needles_, "scenario").withColumn("found", F.contains("view", "needle"))
    return x.groupBy("scenario", "arm").agg(F.count_if("found").alias("needles_found"), F.count("*").alias("needles_total"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("found"), F.col("needle")))), ",").alias("missing"))


def effective_tokens(runs: DataFrame) -> DataFrame:
    """Tokens of a run, and those of the native run as well where a needle is missing."""
    native = runs.where("arm = 'native'").select("scenario", F.col("est_tokens").alias("native_tokens"))
    return runs.join(native, "scenario").withColumn("effective", F.col("est_tokens") + F.when(F.col("needles_found") < F.col("needles_total"), F.col("native_tokens")).otherwise(0))


def payload_runs(planned: DataFrame, views: DataFrame, suite: str) -> DataFrame:
    """Runs of two arms for each capture: its bytes as they are (``native``) and what a plan delivers of it (``rules``): the view, or the capture where the view isn't smaller.
    A token is four bytes, a last one fewer; needles are the lines that state a fact outside diffs, and one is found where it can be read without a recall."""
    fact = F.col("fact").isNotNull() & F.coalesce(F.col("kind") != "diff", F.lit(True))
    of = planned.groupBy("capture_id").agg(F.sum(F.col("n_bytes").cast("long")).alias("raw"), F.count_if(fact).alias("total"), F.count_if(fact & F.col("reason").isNull()).alias("shown"))
    x = of.join(views.select("capture_id", F.octet_length("view").cast("long").alias("size")), "capture_id")
    arm = lambda name, size, found: F.struct(F.lit(name).alias("arm"), F.expr(f"({size} + 3) div 4").alias("est_tokens"), F.expr(found).alias("needles_found"))
    arms = F.array(arm("native", "raw", "total"), arm("rules", "least(size, raw)", "if(size < raw, shown, total)"))
    return x.select(F.col("capture_id").alias("scenario"), F.lit(suite).alias("suite"), F.col("total").alias("needles_total"), F.explode(arms).alias("a")).select("scenario", "suite", "a.arm", "a.est_tokens", "needles_total", "a.needles_found")


def suite_totals(runs: DataFrame) -> DataFrame:
    """Tokens and needles by suite and arm, and over all suites (null suite), with the reduction against native in basis points."""
    g = runs.groupingSets([["suite", "arm"], ["arm"]], "suite", "arm").agg(F.sum("est_tokens").alias("tokens"), F.sum("needles_found").alias("found"), F.sum("needles_total").alias("total"))
    # a window over the few rows of totals, so that runs are read once
    x = g.withColumn("native", F.max(F.when(F.col("arm") == "native", F.col("tokens"))).over(W.partitionBy("suite"))).where("native is not null")
    return x.select("suite", "arm", "tokens", "found", "total", F.expr("((native - tokens) * 10000) div greatest(native, 1)").alias("reduction_bp"))


def medians(runs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The exact median of each column for each value of ``by``. Values are counted, and the counts put in order over the cluster by ranges of (by, value); running counts go
    from one range to the next by a total for each range. So a group may be as large as it likes: no task has it whole. Nulls don't count; a group without values has none."""
    out = runs.groupBy(by).agg(F.count("*").alias("n"))
    for c in columns:
        counts = runs.where(F.col(c).isNotNull()).groupBy(F.col(by), F.col(c).cast("double").alias("v")).agg(F.count("*").alias("k"))
        placed = materialize(counts.repartitionByRange(by, "v").withColumn("part", F.spark_partition_id()), "medians")
        ranges = placed.groupBy(by, "part").agg(F.sum("k").alias("all"))  # a row for each range and group
        of = W.partitionBy(by)
        ranges = ranges.withColumn("before", F.sum("all").over(of.orderBy("part")) - F.col("all")).withColumn("total", F.sum("all").over(of)).drop("all").withColumnRenamed(by, "__by")
        x = placed.join(ranges, placed[by].eqNullSafe(ranges["__by"]) & (placed["part"] == ranges["part"])).drop(ranges["part"])
        upto = F.col("before") + F.sum("k").over(W.partitionBy(by, "part").orderBy("v"))
        at = lambda rank: (F.col("upto") - F.col("k") <= rank) & (rank < F.col("upto"))  # noqa: B023, E731
        low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
        found = x.withColumn("upto", upto).groupBy(by).agg(F.round((F.max(F.when(at(low), F.col("v"))) + F.max(F.when(at(high), F.col("v")))) / 2, 6).alias(f"median_{c}")).withColumnRenamed(by, "__by")
        out = out.join(found, out[by].eqNullSafe(found["__by"]), "left").drop("__by")
    return out


def paired(runs: DataFrame, keys: list[str], value: str, base: str = "native") -> DataFrame:
    """Saving of each arm against the base of the same keys, where both are verified."""
    native = runs.where((F.col("arm") == base) & F.col("verified")).select(*keys, F.col(value).alias("base_value"))
    return runs.where((F.col("arm") != base) & F.col("verified")).join(native, keys).select(*keys, "arm", value, "base_value", F.expr(f"((base_value - {value}) * 10000) div greatest(base_value, 1)").alias("saving_bp"))


def consecutive_pairs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Runs 2k and 2k + 1 as a pair, if there is one of either arm: the difference of their values."""
    g = runs.groupBy(F.expr("idx div 2").alias("pair")).agg(F.count("*").alias("n"), F.count_if(F.col("arm") == a).alias("na"), F.count_if(F.col("arm") == b).alias("nb"), F.sum(F.when(F.col("arm") == a, F.col("value"))).alias("a"), F.sum(F.when(F.col("arm") == b, F.col("value"))).alias("b"))
    return g.where("n = 2 and na = 1 and nb = 1").select("pair", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def trace_sums(traces: DataFrame) -> DataFrame:
    """Tokens and tool-result bytes by session from JSON event lines; lines that don't parse are passed over. A result counts if its session has a
    use with its id, once, however often that is used."""
    schema = "type string, id string, tool string, input_tokens long, output_tokens long, content string"
    x = traces.select("session", F.from_json("value", schema).alias("e")).where("e.type is not null").select("session", "e.*")
    uses, results = x.where("type = 'tool_use'").select("session", "id").distinct(), x.where("type = 'tool_result'").select("session", "id", F.octet_length("content").alias("bytes"))
    tools = uses.join(results, ["session", "id"]).groupBy("session").agg(F.sum("bytes").alias("tool_bytes"), F.count("*").alias("tool_calls"))
    sums = x.groupBy("session").agg(F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"))
    return sums.join(tools, "session", "left").na.fill(0, ["tool_bytes", "tool_calls"])
