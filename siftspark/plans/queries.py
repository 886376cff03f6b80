"""The registered queries of the reduction engine; each has its SQL in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.functions import classify as C
from siftspark.functions import text as X
from siftspark.operators import pack, rank, recall, reduce, report, review, route
from siftspark.sources import adapters as A
from siftspark.sources import capture_store
from siftspark.sources.capture_store import CaptureStore
from siftspark.store import materialize, shared_dir
from siftspark.streaming import flows, keyed, state

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}

#: lines of every format that classifiers know, for the tables' own keys: ``@`` is the key of a part
LITERALS = [
    "test tests::alpha_@ ... ok", "test tests::beta_@ ... FAILED", "test with space here ... ok", "test_one_@ (pkg.mod.Case) ... ok", "bad name (x y) ... ok", "--- PASS: TestGo@ (0.@s)", "    --- PASS: TestSub (0.01s)",
    "tests/test_a.py::test_x@ PASSED [ 10%]", "tests/a b.py::t PASSED", "✔ adds @ numbers (1.2ms)", "✓ renders (3 ms)", "√ plain", "ok @ - name of it", "ok 3 - later # SKIP soon", "ok x - no", "running @ tests", "running tests",
    "collected @ items", "===== test session starts =====", "==================================", "------------------------------", "ℹ skipped 0", "ℹ skipped 1", "=== RUN   TestGo", "tests/test_a.py ..s..  [ 40%]", "tests/test_a.py ..F..  [ 40%]",
    "    at node:internal/main:1:1", "    at foo (node:vm:3)", "    at Object.<anonymous> (/app/node_modules/x.js:1)", "    at app.js:1", '  File "/usr/lib/python3/x.py", line 3', '  File "/srv/app.py", line 3', "    at java.base/x",
    "pub fn a@() {", "export default class B {", "let fn = @", "#define X 1", "async def c():", "   Compiling serde-@ v1.0.1", "    Checking a_b v0.1.0 (/tmp/x)", "   Compiling x vX", "error: it failed @ times", "warn: low disk", "Expected 3", "  --> src/a.rs:@",
    "plain text @", "", "   ", "api_key = 1", "token=abc@", "token = abc", "Bearer xyz", "src/a@.rs:12:let x = @;", "C:\\a\\b@.rs:7:code", "a:1:2:x", "x:0:zero", ":5:y", "12:only content @", "deadbeef01 took 15ms in 0x1f", "2024-01-02T03:04:05Z INFO start: user=5 ok", "@% done\r60% done",
]


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def _of_parts(spark: SparkSession, d: str, forms: list, kind: str) -> DataFrame:
    """(id, i, x): for each part one of the forms in turn, the part's key in it where the form has ``@``."""
    key = F.col("p_partkey")
    table = spark.createDataFrame([(i, x) for i, x in enumerate(forms)], f"i long, form {kind}")
    x = A.table(spark, d, "part").select(key.cast("long").alias("id"), (key % len(forms)).cast("long").alias("i")).join(F.broadcast(table), "i")
    put = lambda c: F.replace(c, F.lit("@"), F.col("id").cast("string"))
    return x.select("id", "i", (F.transform("form", put) if kind.startswith("array") else put(F.col("form"))).alias("x"))


def literals(spark: SparkSession, d: str) -> DataFrame:
    return _of_parts(spark, d, LITERALS, "string").withColumnRenamed("x", "line")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@query
def flagship_log_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Service logs, long middle hidden: what is shown and hidden of each capture."""
    x = reduce.prepare(A.log_lines(spark, d))
    return pack.summary(reduce.long_output(x))


@query
def log_plan_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of the logs: lines by reason."""
    x = reduce.tiny_gaps(reduce.plan(A.log_lines(spark, d)))
    return x.groupBy("capture_id", F.coalesce("reason", F.lit("visible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))


def _by_reason(x: DataFrame) -> DataFrame:
    """Planned lines of each capture by reason."""
    return reduce.tiny_gaps(x).groupBy("capture_id", F.coalesce("reason", F.lit("visible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"), F.sum("line_no").alias("line_sum"))


@query
def run_plan_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of test runs with chrome, frames, recaps, headers and redraws."""
    return _by_reason(reduce.plan(A.run_lines(spark, d)))


@query
def goal_plan_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The same, with a goal that names a test, a step and a shard."""
    return _by_reason(reduce.plan(A.run_lines(spark, d).withColumn("goal", F.lit(A.GOAL)), goal="goal"))


@query
def goal_search_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The plan of search hits, with a goal that names a file."""
    return _by_reason(reduce.plan(A.hit_lines(spark, d).withColumn("goal", F.lit(A.GOAL)), "search", "goal"))


@query
def goal_diff_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The plan of diffs, with a goal that names the lockfile: its body stays."""
    return _by_reason(reduce.plan(A.diff_lines(spark, d).withColumn("goal", F.lit(A.GOAL)), "auto", "goal"))


@query
def generated_diff_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The plan of diffs without a goal."""
    return _by_reason(reduce.plan(A.diff_lines(spark, d), "diff"))


@query
def explode_lines(spark: SparkSession, d: str) -> DataFrame:
    return X.explode_lines(A.doc_captures(spark, d)).select("capture_id", "line_no", "byte_start", "byte_end", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query
def trimmed_lines(spark: SparkSession, d: str) -> DataFrame:
    x = X.explode_lines(A.doc_captures(spark, d))
    return x.groupBy("capture_id").agg(F.sum(F.length(X.trim_end(F.col("line")))).alias("chars"), F.count_if(X.trim_end(F.col("line")) == "").alias("blanks"))


@query
def classify_literals(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return literals(spark, d).select("id", C.fact_kind(line).alias("fact"), C.passing_test_name(line).alias("passed"), _yes(C.is_boilerplate(line)).alias("boilerplate"), _yes(C.is_test_progress(line)).alias("progress"), _yes(C.is_runtime_frame(line)).alias("frame"), _yes(C.is_definition(line)).alias("definition"), C.progress_name(line).alias("build"), _yes(C.contains_secret(line)).alias("secret"), _yes(C.has_redraw(line)).alias("redraw"))


@query
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts on lines of web pages."""
    x = X.explode_lines(A.table(spark, d, "pages").selectExpr("page_id", "html text"))
    return x.groupBy("page_id", C.fact_kind(F.col("line")).alias("fact")).agg(F.count("*").alias("n"))


@query
def secret_documents(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", _yes(C.contains_secret(F.col("text"))).alias("secret"))


@query
def line_templates(spark: SparkSession, d: str) -> DataFrame:
    return A.log_lines(spark, d).groupBy("capture_id", X.template(F.col("line")).alias("template")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))


@query
def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    return A.log_lines(spark, d).groupBy("capture_id", X.shape(F.col("line")).alias("shape")).agg(F.count("*").alias("n"))


@query
def parsed_hits(spark: SparkSession, d: str) -> DataFrame:
    return A.hit_lines(spark, d).withColumn("h", X.hit(F.col("line"))).select("capture_id", "line_no", "h.path", "h.line", "h.content")


@query
def parsed_literal_hits(spark: SparkSession, d: str) -> DataFrame:
    return literals(spark, d).withColumn("h", X.hit(F.col("line"), "one.rs")).withColumn("rest", X.hit_content(F.col("line"))).select("id", "h.path", "h.line", "h.content", "rest")


@query
def goal_tokens(spark: SparkSession, d: str) -> DataFrame:
    g = A.goals(spark, d)
    return g.select("session_id", "at", F.array_join(X.goal_tokens(F.col("goal")), "|").alias("tokens"), F.size(X.goal_tokens(F.col("goal"))).cast("long").alias("n"))


@query
def prompt_goals(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.prompt_goal(F.col("text")).alias("goal"))


@query
def canonical_hashes(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", X.canonical_hash(F.col("text"), F.col("source")).alias("raw_sha256"))


@query
def clipped_texts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.md5(X.clip(F.col("text"), 320).cast("binary")).alias("clip_md5"))


@query
def identical_runs(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.identical_runs(reduce.prepare(X.explode_lines(A.doc_captures(spark, d))))
    return x.where("reason is not null").select("capture_id", "line_no", "reason")


@query
def similar_runs(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.similar_runs(reduce.prepare(A.log_lines(spark, d, by_type=True)))
    return x.groupBy("capture_id", F.coalesce("reason", F.lit("visible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


@query
def passing_tests(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.passing_tests(reduce.prepare(A.test_lines(spark, d)))
    return x.groupBy("capture_id").agg(F.count_if(F.col("reason") == reduce.TESTS).alias("hidden"), F.count_if(F.col("reason").isNull()).alias("visible"))


@query
def test_omissions(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(A.test_lines(spark, d))))
    return pack.omissions(x)


@query
def test_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(A.test_lines(spark, d))))
    return pack.blocks(x)


@query
def test_facts(spark: SparkSession, d: str) -> DataFrame:
    return pack.facts(reduce.passing_tests(reduce.prepare(A.test_lines(spark, d)))).drop("source")


@query
def pack_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Blocks and omissions cover every byte once: the gap is 0."""
    return pack.tiles(reduce.tiny_gaps(reduce.plan(A.test_lines(spark, d))))


@query
def pack_views(spark: SparkSession, d: str) -> DataFrame:
    lines = A.test_lines(spark, d)
    x = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(lines)))
    captures = lines.groupBy("capture_id").agg(F.max(F.when(F.col("line").contains("FAILED"), 101).otherwise(0)).alias("exit_code"))
    return pack.views(x, captures).select("capture_id", "omitted", F.md5(F.col("view").cast("binary")).alias("view_md5"), F.octet_length("view").cast("long").alias("view_bytes"))


@query
def verbose_views(spark: SparkSession, d: str) -> DataFrame:
    """Test captures spelled out, every third with constraints, every fifth without an exit code."""
    lines = A.test_lines(spark, d)
    x = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(lines)))
    n = F.substring_index("capture_id", "-", -1).cast("int")
    code = F.max(F.when(F.col("line").contains("FAILED"), 101).otherwise(0))
    c = lines.groupBy("capture_id").agg(code.alias("code")).withColumn("exit_code", F.when(n % 5 != 4, F.col("code"))).withColumn("constraints", F.when(n % 3 == 0, F.array(F.lit("keep the API"), F.lit("no new files"))))
    c = c.select("capture_id", "exit_code", "constraints", F.lit("shell").alias("tool"), F.when(n % 2 == 0, F.lit("cargo [1 arguments redacted]")).alias("command_display"), F.lit("complete").alias("completeness"), F.lit("selected").alias("coverage"))
    long_ = pack.verbose(x, c).select("capture_id", F.md5(F.col("view").cast("binary")).alias("verbose_md5"), F.octet_length("view").cast("long").alias("verbose_bytes"))
    short = pack.views(x, c.withColumn("exit_code", F.lit(0))).select("capture_id", F.md5(F.col("view").cast("binary")).alias("view_md5"))
    return long_.join(short, "capture_id")


@query
def level_answers(spark: SparkSession, d: str) -> DataFrame:
    """The lines of orders as answers of four levels: their quantities as probabilities, which are sound for some."""
    x = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, y: a + y["l_quantity"])
    whole = F.when(F.col("l_orderkey") % 5 == 0, total * 2).otherwise(total)
    x = x.withColumn("levels", F.transform("q", lambda y: F.struct((y["l_linenumber"] + F.col("l_orderkey") % 3 + F.when((F.col("l_orderkey") % 7 == 0) & (y["l_linenumber"] == 4), 1).otherwise(0)).alias("level"), (y["l_quantity"] / whole).alias("probability"))))
    return x.select("l_orderkey", rank.level_error(F.col("levels"), 4).alias("error"), F.round(rank.score_level(F.col("levels"), 4), 6).alias("level"))


@query
def binary_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Diffs of customers as bytes, a section for each, with bytes that are no UTF-8 in some."""
    c = A.table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    head = F.concat(F.lit("diff --git a/f"), F.col("k").cast("string"), F.lit(" b/f"), F.col("k").cast("string"), F.lit("\n"))
    part = F.concat(head.cast("binary"), F.when(F.col("k") % 3 == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.lit("+x").cast("binary")), F.lit("\n").cast("binary"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("k", part.alias("p")))), F.lit("before\n").cast("binary"), lambda a, y: F.concat(a, y["p"]))
    diffs = c.groupBy(F.expr("concat('diff-', k div 50)").alias("capture_id")).agg(whole.alias("diff"))
    return review.binary_sections(diffs).select("capture_id", "section", F.col("header").cast("string").alias("header"), "sha256", "n_bytes")


@query
def pack_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What happens to each test capture's pack at a budget of 2 KiB."""
    lines = A.test_lines(spark, d)
    x = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(lines)))
    captures = lines.groupBy("capture_id").agg(F.lit(0).alias("exit_code"), F.max("byte_end").alias("raw"))
    n = pack.omissions(x).groupBy("capture_id").agg(F.count("*").alias("n"))
    v = pack.views(x, captures.select("capture_id", "exit_code")).join(captures, "capture_id").join(n, "capture_id", "left")
    no = F.lit(False)
    return v.select("capture_id", pack.decision(no, no, no, F.col("exit_code"), F.lit(None).cast("string"), F.lit("deterministic"), F.coalesce("n", F.lit(0)), F.octet_length("view"), F.col("raw"), F.lit(2048)).alias("reason"))


@query
def search_head(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.search_head(reduce.prepare(A.hit_lines(spark, d), kind="search"))
    return x.groupBy("capture_id", F.coalesce("reason", F.lit("visible")).alias("reason")).agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


@query
def repeated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of one file for each capture, each on the line of its place. The path of some has a fact's word, that of others is named by the goal."""
    path = F.when(F.col("capture_id").startswith("hits-A"), "src/errors.rs:").otherwise("src/abcd.rs:")
    lines = A.hit_lines(spark, d).withColumn("line", F.concat(path, (F.col("line_no") + 1).cast("string"), F.lit(":"), F.substring_index("line", ":", -1))).withColumn("goal", F.lit("who calls src/abcd.rs"))
    x = reduce.repeated_hits(reduce.prepare(lines, "goal", kind="search"))
    return x.groupBy("capture_id").agg(F.count("reason").alias("hidden"), F.count("*").alias("n"))


@query
def search_plan_errors(spark: SparkSession, d: str) -> DataFrame:
    """The plan of searches: those of one file have no paths, and some have separators between their hits, which keeps them from being packed."""
    of_one = F.col("capture_id").startswith("hits-N")
    line = F.when(of_one, F.substring("line", F.instr("line", ":") + 1, 1 << 20)).when(F.col("capture_id").startswith("hits-R") & F.col("line").contains(":7:"), F.lit("--\n")).otherwise(F.col("line"))
    lines = A.hit_lines(spark, d).withColumn("line", line).withColumn("default_path", F.when(of_one, F.lit("src/one.rs")))
    x = reduce.tiny_gaps(reduce.plan(lines, "search"))
    return x.groupBy("capture_id").agg(F.max("plan_error").alias("plan_error"), F.count("reason").alias("hidden"), F.sum(F.when(F.col("reason").isNotNull(), F.col("line_no"))).alias("line_sum"), F.count("*").alias("n"))


def ranges(spark: SparkSession, d: str, prefix: str, captures: int, spread: int) -> DataFrame:
    """Byte ranges of captures, one for each customer; every fifth holds no whole line."""
    capture = f"concat('{prefix}', c_custkey % {captures})"
    return A.table(spark, d, "customer").selectExpr(f"{capture} capture_id", "'stdout' stream", f"c_custkey * 7919 % {spread} start", f"c_custkey * 7919 % {spread} + case when c_custkey % 5 = 0 then 3 else c_custkey % 900 end as end")


@query
def adaptive_log_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The plan of logs with what a ranker selected: chosen lines of the long middle are shown."""
    return _by_reason(reduce.plan(A.log_lines(spark, d), ranges=ranges(spark, d, "log-", 3, 90_000)))


@query
def adaptive_diff_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The plan of diffs with what a ranker selected: files without a selected line lose their bodies where the capture has a range at all."""
    few = ranges(spark, d, "diff-", 2, 9_000).where("start % 17 = 0")
    return _by_reason(reduce.plan(A.diff_lines(spark, d), "diff", ranges=few))


@query
def hit_sections(spark: SparkSession, d: str) -> DataFrame:
    return pack.hit_sections(A.hit_lines(spark, d)).drop("stream")


@query
def log_digest(spark: SparkSession, d: str) -> DataFrame:
    return pack.digest(A.log_lines(spark, d))


@query
def rankable_chunks(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.long_output(reduce.prepare(A.log_lines(spark, d)))
    return rank.chunks(x).drop("stream", "byte_start", "byte_end")


@query
def rank_sections(spark: SparkSession, d: str) -> DataFrame:
    """Of searches, diffs and logs in one table, each capture by its kind."""
    hits = reduce.prepare(A.hit_lines(spark, d), kind="search")
    diffs = reduce.prepare(A.diff_lines(spark, d), kind="auto")
    logs = reduce.long_output(reduce.prepare(A.log_lines(spark, d)))
    cols = ["capture_id", "stream", "kind", "line_no", "byte_start", "byte_end", "line", "reason"]
    return rank.rank_sections(hits.select(cols).unionByName(diffs.select(cols)).unionByName(logs.select(cols)))


@query
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return review.changed_files(A.diff_lines(spark, d)).drop("stream")


@query
def scope_findings(spark: SparkSession, d: str) -> DataFrame:
    files = review.scope_files(review.changed_files(A.diff_lines(spark, d)))
    return review.scope_findings(files.withColumn("probability", F.col("added") % 10 / F.lit(10.0)))


@query
def candidate_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Documents as untracked files, a hundred to a candidate."""
    tree = "concat('tree-', doc_id div 100) capture_id"
    files = A.table(spark, d, "documents").selectExpr(tree, "concat('docs/', doc_id, '.md') path", "doc_id % 17 <> 0 regular", "text content")
    bases = A.table(spark, d, "documents").selectExpr(tree).distinct().selectExpr("capture_id", "md5(cast(capture_id as binary)) base_commit", "concat('diff of ', capture_id) diff")
    return review.snapshots(bases, files)


@query
def diff_findings(spark: SparkSession, d: str) -> DataFrame:
    return review.diff_findings(A.diff_lines(spark, d))


@query
def generated_diffs(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.generated_diffs(reduce.prepare(A.diff_lines(spark, d), kind="diff"))
    return x.groupBy("capture_id").agg(F.count("reason").alias("hidden"), F.count("*").alias("n"))


@query
def edit_signatures(spark: SparkSession, d: str) -> DataFrame:
    x = reduce.edit_signatures(reduce.prepare(A.diff_lines(spark, d), kind="diff"))
    return x.select("capture_id", F.col("section").cast("long").alias("section"), F.array_join("gone", ",").alias("gone"), F.array_join("come", ",").alias("come"))


@query
def protected_facts(spark: SparkSession, d: str) -> DataFrame:
    """Status, exit code, a constraint for every third capture, and visible facts of the test captures."""
    lines = A.test_lines(spark, d)
    n = F.substring_index("capture_id", "-", -1).cast("int")
    c = lines.groupBy("capture_id").agg(F.max(F.when(F.col("line").contains("FAILED"), 101)).alias("exit_code")).withColumn("status", F.when(n % 2 == 0, "completed").otherwise("killed")).withColumn("constraints", F.when(n % 3 == 0, F.array(F.lit("keep the API"), F.lit("no new files"))))
    return pack.protected(reduce.passing_tests(reduce.prepare(lines)), c)


@query
def deliveries(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "events").selectExpr("event_id run_id", "event_id % 4000 + 1 raw_bytes", "case when event_id % 5 <> 0 then cast(round(value * 10) as bigint) end rendered_bytes", "case when event_id % 5 = 0 then 'already_lean' end reason", "event_id % 17 = 0 overflow", "case when event_id % 23 = 0 then 'quota' end store_error")
    return pack.delivery(x, 1500).select("run_id", "bypass", "replaced", "delivered_bytes")


@query
def verifier_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands that name a part as their package; some have a flag that isn't harmless, a second line or another program."""
    k = F.col("p_partkey")
    program = F.when(k % 11 == 0, "cargo run").when(k % 3 == 0, "cargo  check").when(k % 3 == 1, " cargo test").otherwise("cargo build")
    tail = F.when(k % 7 == 0, " --release").when(k % 5 == 0, "\n").when(k % 2 == 0, "  --locked -q ").otherwise("")
    command = F.concat(program, F.lit(" -p part_"), k.cast("string"), tail)
    return A.table(spark, d, "part").select("p_partkey", route.build_verifier(command).alias("verifier"))


@query
def bounded_output(spark: SparkSession, d: str) -> DataFrame:
    """Events as chunks of their users' runs of twenty; a run may hold 2000 bytes."""
    x = A.table(spark, d, "events").selectExpr("concat(user_id, '-', event_id div 2000) run_id", "event_id seq", "cast(round(value) as bigint) n_bytes")
    return route.bounded(x, 2000).groupBy("fate").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


def _thirds(x: DataFrame, order: str) -> list[DataFrame]:
    """A table in three parts of equal spans of a column."""
    low, high = x.select(F.min(order), F.max(order)).first()
    if low is None:
        return [x]
    part = F.least(F.floor((F.col(order) - low) * 3 / F.lit(max(1, high - low))), F.lit(2))
    return [x.where(part == i) for i in range(3)]


@query
def bounded_output_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks as a stream that comes in three parts and is started anew for each."""
    x = A.table(spark, d, "events").selectExpr("concat(user_id, '-', event_id div 2000) run_id", "event_id seq", "cast(round(value) as bigint) n_bytes")
    x = x.withColumn("last", F.col("seq") == F.max("seq").over(W.partitionBy("run_id")))
    out = flows.in_parts(_thirds(x, "seq"), lambda s: keyed.bounded_stream(s, 2000))
    return out.groupBy("fate").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


@query
def goals_at_runs_stream(spark: SparkSession, d: str) -> DataFrame:
    """``goals_at_runs`` over a stream of both, turns as seconds; a last row far ahead lets the watermark pass all runs."""
    c = A.table(spark, d, "conversations").where("conv_id is not null and role in ('user', 'assistant')")
    rows = c.selectExpr("conv_id session_id", "cast(turn as bigint) at", "case when role = 'assistant' then cast(conv_id * 100 + turn as bigint) end run_id", "case when role = 'user' then substring(text, 1, 600) end goal")
    end = spark.range(1).selectExpr("cast(-1 as bigint) session_id", "cast(1000000 as bigint) at", "cast(null as bigint) run_id", "'end' goal")

    def flow(s: DataFrame) -> DataFrame:
        return keyed.goal_as_of_stream(s.where("run_id is not null").select("session_id", "run_id", "at"), s.where("run_id is null").select("session_id", "at", "goal"), "1000 seconds", ttl=1)

    return flows.in_parts([*_thirds(rows, "at"), end], flow)


@query
def goal_revisions_stream(spark: SparkSession, d: str) -> DataFrame:
    """``goal_revisions`` over a stream, with a session's goal as state that expires."""
    g = A.goals(spark, d).selectExpr("cast(session_id as bigint) session_id", "cast(at as bigint) at", "goal")
    return flows.in_parts(_thirds(g, "at"), lambda s: keyed.goal_revision_stream(s, ttl=3), timed=True).select("session_id", "at", "revision")


@query
def hook_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of test runs as hook events, every seventh with more than may be delivered: what is put in their place."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "")
    runs = A.test_lines(spark, d).groupBy("capture_id").agg(text.alias("output"), F.max(F.when(F.col("line").contains("FAILED"), 101).otherwise(0)).alias("exit_code"))
    n = F.substring_index("capture_id", "-", -1).cast("int")
    events = runs.select(F.col("capture_id").alias("event_id"), F.when(n % 5 == 4, F.lit("no session")).otherwise(F.lit("s-1")).alias("session_id"), F.lit("shell").alias("tool"), "output", "exit_code")
    return flows.deliver(events, 4096).select("event_id", "raw_bytes", "bypass", "replaced", "delivered_bytes", F.md5(F.col("output").cast("binary")).alias("output_md5"))


@query
def remembered_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions about orders, replayed under a key for each customer: the first is kept, through two batches."""
    o = A.table(spark, d, "orders").selectExpr("cast(o_custkey as string) cache_key", "2 schema_version", "'ranker-2' model", "0.9D exists_p", "cast(o_orderkey as double) need", "array('a') kept_ids")
    cache = rank.remember(o.where("need % 2 = 0"), spark.createDataFrame([], flows.DECISIONS))
    return cache.unionByName(rank.remember(o.where("need % 2 = 1"), cache)).selectExpr("cache_key", "cast(need as bigint) first_order")


@query
def section_limits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests whose sections are their lines."""
    x = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("cast(l_quantity * 400 as bigint)")).alias("sizes"))
    return x.select("l_orderkey", rank.section_limit(F.col("sizes"), F.expr("51000 + l_orderkey % 15000")).alias("section_bytes"))


@query
def cached_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the customers against decisions of two thirds of them, some of which don't hold."""
    c = A.table(spark, d, "customer").withColumn("k", F.col("c_custkey")).withColumn("cache_key", rank.cache_key("v1", F.md5(F.col("c_name").cast("binary")), F.col("c_mktsegment")))
    requests = c.select("k", "cache_key", F.array(F.lit("a"), F.lit("b"), F.col("c_mktsegment")).alias("ids"))
    ids = F.when(F.col("k") % 7 == 0, F.array(F.lit("a"), F.lit("a"))).when(F.col("k") % 11 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("b"), F.col("c_mktsegment")))
    cache = c.where("k % 3 <> 0").select("cache_key", F.when(F.col("k") % 13 == 0, 1).otherwise(2).alias("schema_version"), F.when(F.col("k") % 5 == 0, "other-1").otherwise("ranker-2").alias("model"), (F.col("k") % 50 / 50 + 0.5).alias("exists_p"), (F.col("k") % 6).cast("double").alias("need"), ids.alias("kept_ids"))
    return rank.cached(requests, cache, "ranker-").select("k", "cache_key", "found", F.array_join("kept_ids", ",").alias("kept"))


@query
def store_size(spark: SparkSession, d: str) -> DataFrame:
    return recall.store_bytes(A.table(spark, d, "documents"), "text", "source")


@query
def session_reports(spark: SparkSession, d: str) -> DataFrame:
    return report.session_report(A.receipts(spark, d))


@query
def gain_report(spark: SparkSession, d: str) -> DataFrame:
    return report.gain(A.receipts(spark, d)).withColumn("total", F.col("total").cast("int"))


@query
def top_commands(spark: SparkSession, d: str) -> DataFrame:
    return report.top_commands(A.receipts(spark, d))


@query
def bypass_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.bypasses(A.receipts(spark, d))


@query
def request_accounting(spark: SparkSession, d: str) -> DataFrame:
    return report.accounting(A.receipts(spark, d), "command")


@query
def session_status(spark: SparkSession, d: str) -> DataFrame:
    return report.session_status(A.receipts(spark, d))


@query
def recorded_recalls(spark: SparkSession, d: str) -> DataFrame:
    log = A.table(spark, d, "events").selectExpr("concat('cap-', cast(event_id div 7 as string)) capture_id", "event_id % 97 bytes")
    return report.with_recalls(A.receipts(spark, d), log).select("run_id", "recalls", "recalled_bytes")


@query
def session_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Receipts written as JSON lines and read back: those of the busiest session. Lines that are broken on the way are dropped."""
    x = A.receipts(spark, d).select("session_id", "run_id", "raw_bytes", "delivered_bytes")
    path = f"{shared_dir(spark)}/siftspark-receipts-{uuid.uuid4().hex}"
    n = F.substring_index("run_id", "-", -1).cast("long")
    A.write_receipts(x.where(n % 50 != 0), path)
    x.where(n % 50 == 0).select(F.concat(F.lit("{broken "), "run_id").alias("value")).write.mode("append").text(path)
    busiest = x.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    return A.read_receipts(spark, path, "session_id string, run_id string, raw_bytes long, delivered_bytes long", session=busiest["session_id"] if busiest else "")


@query
def newest_capture(spark: SparkSession, d: str) -> DataFrame:
    return recall.newest(A.table(spark, d, "documents").selectExpr("cast(doc_id as string) capture_id", "doc_id * 7919 % 1000003 created_at"))


@query
def pack_identities(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents").selectExpr("doc_id", "case when doc_id % 9 <> 0 then source end source", "lang")
    return pack.pack_ids(x, ["doc_id", "source", "lang"]).select("doc_id", "pack_id")


@query
def suite_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.suite_totals(A.bench_runs(spark, d))


@query
def effective_tokens(spark: SparkSession, d: str) -> DataFrame:
    return report.effective_tokens(A.bench_runs(spark, d)).select("scenario", "arm", "effective")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of test and log captures, as they are and as packs, with the facts that each shows."""

    def runs(planned: DataFrame, suite: str) -> DataFrame:
        # its blocks, its omissions and its facts are read from a table of it
        planned = materialize(planned.select("capture_id", "stream", "line_no", "line", "byte_start", "byte_end", "n_bytes", "kind", "fact", "reason"), f"payloads-{suite}")
        exits = planned.groupBy("capture_id").agg(F.max(F.when(F.col("line").contains("FAILED"), 101).otherwise(0)).alias("exit_code"))
        return report.payload_runs(planned, pack.views(planned, exits), suite)

    tests = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(A.test_lines(spark, d))))
    logs = reduce.tiny_gaps(reduce.long_output(reduce.prepare(A.log_lines(spark, d))))
    return runs(tests, "tests").unionByName(runs(logs, "logs"))


@query
def payload_runs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and facts of each capture and arm, and tokens with a recall of the whole where a fact is missing."""
    return report.effective_tokens(_payloads(spark, d)).select("scenario", "suite", "arm", "est_tokens", "needles_total", "needles_found", "effective")


@query
def payload_scores(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and facts kept of each suite and arm: how far packs reduce payloads, and what they cost in facts."""
    return report.suite_totals(_payloads(spark, d))


@query
def median_by_arm(spark: SparkSession, d: str) -> DataFrame:
    return report.medians(A.bench_runs(spark, d), "arm", ["est_tokens"])


@query
def paired_savings(spark: SparkSession, d: str) -> DataFrame:
    return report.paired(A.bench_runs(spark, d), ["scenario"], "est_tokens")


@query
def kept_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rank.kept(A.choices(spark, d))


@query
def answer_errors(spark: SparkSession, d: str) -> DataFrame:
    x = A.choices(spark, d).withColumn("chosen", F.max_by("candidate_id", F.struct("probability", "candidate_id")).over(W.partitionBy("capture_id"))).withColumn("known", F.lit(True))
    return rank.answer_errors(x)


@query
def prefiltered_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents of each source in the order of how many words of a goal they hold, and whether they are among the 64 that go to a ranker."""
    x = A.table(spark, d, "documents").select(F.col("source").alias("capture_id"), F.col("doc_id").alias("idx"), "text").withColumn("tokens", X.ranker_tokens(F.lit("the thing that stands, Under the table with reason")))
    return rank.standings(x)


@query
def selected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of logs that lie whole in a range of a customer."""
    x = rank.in_ranges(A.log_lines(spark, d), ranges(spark, d, "log-", 3, 90_000))
    return x.groupBy("capture_id").agg(F.count("*").alias("n"), F.sum("line_no").alias("line_sum"))


@query
def goal_revisions(spark: SparkSession, d: str) -> DataFrame:
    return state.goal_revisions(A.goals(spark, d), ttl=3).select("session_id", "at", "revision")


@query
def task_revisions(spark: SparkSession, d: str) -> DataFrame:
    g = A.goals(spark, d).selectExpr("session_id", "seq", "revision", "goal content")
    return state.task_revisions(g).select("session_id", "seq", "revision", "outcome")


@query
def goals_at_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "conversations").where("role = 'assistant'").selectExpr("conv_id session_id", "conv_id * 100 + turn run_id", "turn at")
    return state.goal_as_of(runs, A.goals(spark, d).select("session_id", "at", "goal"), ttl=1)


@query
def recalled_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "documents").selectExpr("cast(doc_id as string) capture_id", "text stdout")
    r = A.table(spark, d, "documents").selectExpr("cast(doc_id as string) capture_id", "doc_id % 50 as start", "doc_id % 50 + doc_id % 400 as end")
    return recall.by_bytes(r, c).select("capture_id", "start", "end", F.hex("bytes").alias("hex"), "error")


@query
def stored_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Documents saved as captures, twice over and with other texts under some ids, and byte ranges recalled from the store, some beyond the end, some that cut a character."""
    docs = A.table(spark, d, "documents").selectExpr("cast(doc_id as string) capture_id", "doc_id created_at", "text stdout", "source stderr", "doc_id")
    store = CaptureStore(spark, f"{shared_dir(spark)}/siftspark-captures-{uuid.uuid4().hex}", chunk=512)
    store.save(docs.where("doc_id % 3 <> 0"))
    store.save(docs.withColumn("stdout", F.when(F.col("doc_id") % 6 == 1, "another text").otherwise(F.col("stdout"))))
    start = "doc_id % 700 as start"
    out = docs.selectExpr("capture_id", "'stdout' stream", start, "doc_id % 700 + doc_id % 1500 as end")
    err = docs.selectExpr("concat(capture_id, case when doc_id % 10 = 0 then '?' else '' end) capture_id", "'stderr' stream", "0 as start", "3 as end")
    got = store.recall(out.unionByName(err))
    return got.select("capture_id", "stream", "start", "end", F.hex("bytes").alias("hex"), capture_store.shown(F.col("bytes"))["encoding"].alias("encoding"), "error")


@query
def saved_captures(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of captures that are saved after most of them are there, with other texts under some ids, repeats and a limit of size."""
    docs = A.table(spark, d, "documents").selectExpr("cast(doc_id as string) capture_id", "doc_id created_at", "text stdout", "cast(null as string) stderr", "doc_id")
    store = CaptureStore(spark, f"{shared_dir(spark)}/siftspark-captures-{uuid.uuid4().hex}", largest=3000)
    store.save(docs.where("doc_id % 3 <> 0"))
    again = docs.withColumn("stdout", F.when(F.col("doc_id") % 5 == 0, "another text").otherwise(F.col("stdout")))
    return store.save(again.unionByName(again.where("doc_id % 7 = 0"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query
def recalled_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = X.explode_lines(A.doc_captures(spark, d))
    r = A.table(spark, d, "documents").selectExpr("concat('doc-', cast(doc_id as string)) capture_id", "1 + doc_id % 4 as a", "1 + doc_id % 4 + doc_id % 5 as b")
    return recall.by_lines(r, lines)


@query
def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("capture_id"))
    r = A.table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.expr("substring(md5(cast(cast(doc_id * 2 as string) as binary)), 1, cast(6 + doc_id % 5 as int))").alias("prefix"))
    return recall.resolve(r, c)


@query
def capture_limits(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents").selectExpr("concat(source, '-', doc_id div 100) run_id", "doc_id seq", "text data")
    return recall.captured_size(x, 40_000).select("run_id", "seq", "so_far", "bypassed")


@query
def manifest_changes(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents")
    a = x.where("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    b = x.where("doc_id % 10 <> 7").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("sha256"))
    return recall.manifest_diff(a, b)


@query
def retained_events(spark: SparkSession, d: str) -> DataFrame:
    return state.retain(A.table(spark, d, "events").selectExpr("event_id", "event_id * 10 at"), "at", 90_000, 24 * 3600).select("event_id")


COMMANDS = [
    "cargo test case_@", "cargo +nightly test", "cargo run", "go vet ./...", "python -m pytest -q", "python app_@.py", "C:\\tools\\RG.exe x", "npm run build", "npm run dev:web", "npx jest", "grep -rn x@ .", "grep --color x", "git log -@", "git push",
    "cmake --build out", "mvn -q verify", "bundle exec rspec", "docker build .", "kubectl get pods", "FOO=@ make", "cd a && make 'b @ c'", "ls | wc", "echo $(x@)", 'git show "a @" c\\ d', "a && ", "echo 'open", "",
]
SEARCHES = [
    ["rg", "-n", "-H", "needle @"], ["/usr/bin/rg", "-n", "-H", "needle", "src", "--sort=path"], ["rg", "-n", "-H", "-x"], ["rg", "-n", "-H", "my password @"], ["rg", "-n", "-H", "ok @", "../up"], ["rg", "-n", "-H", "ok", "/etc"],
    ["rg", "-n", "x"], ["grep", "-n", "-H", "x"], ["rg", "-n", "-H", "\u00e9"], ["rg", "-n", "-H", "q", "C:x"], ["rg", "-n", "-H", " "],
]


@query
def routed_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands as words, and whether their last segment's program is one to reduce."""
    x = route.with_segments(_of_parts(spark, d, COMMANDS, "string").withColumnRenamed("x", "command"))
    words = F.filter(F.element_at("segments", -1), lambda w: ~route.is_assignment(w))
    x = x.withColumn("words", words)
    yes = route.eligible(route.program_name(F.get("words", F.lit(0))), F.slice("words", 2, 1 << 20))
    return x.select("id", F.array_join(F.transform("segments", lambda s: F.array_join(s, "|")), "&").alias("parsed"), F.coalesce(yes, F.lit(False)).alias("eligible"))


@query
def search_privacy(spark: SparkSession, d: str) -> DataFrame:
    return _of_parts(spark, d, SEARCHES, "array<string>").select("id", route.query_privacy(F.col("x")).alias("denied"))


@query
def hook_events(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON hook events, every ninth malformed: what is replaced and what is passed over."""
    x = A.table(spark, d, "conversations").select(F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct(F.concat(F.lit("s-"), F.col("conv_id").cast("string")).alias("session_id"), F.col("role").alias("tool"), F.col("text").alias("output")))).alias("value"))
    e = A.read_events(x, "session_id string, tool string, output string").where("session_id is not null")
    return route.tool_output(e).groupBy("tool", "skip").agg(F.count("*").alias("n"), F.sum(F.octet_length("output")).alias("bytes"))


@query
def build_progress(spark: SparkSession, d: str) -> DataFrame:
    """Build progress of the parts, a capture for each brand of five thousand; a warning breaks the run of every hundredth."""
    line = F.when(F.col("p_partkey") % 100 == 0, F.lit("warning: unused\n")).otherwise(F.concat(F.lit("   Compiling part-"), F.col("p_partkey").cast("string"), F.lit(" v1."), F.col("p_size").cast("string"), F.lit(".0\n")))
    lines = A._numbered(A.table(spark, d, "part").select(F.expr("concat('build-', p_brand, '-', p_partkey div 5000)").alias("capture_id"), "p_partkey", line.alias("line")), "p_partkey")
    x = reduce.build_progress(reduce.prepare(lines))
    return x.groupBy("capture_id").agg(F.count("reason").alias("hidden"), F.count("*").alias("n"))


@query
def redrawn_lines(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("% done\rnext")).otherwise(F.lit(" plain")), F.lit("\n"))
    lines = A._numbered(A.table(spark, d, "orders").select(F.expr("concat('o-', o_orderstatus, '-', o_orderkey div 2000)").alias("capture_id"), "o_orderkey", line.alias("line")), "o_orderkey")
    return reduce.redraws(reduce.prepare(lines)).groupBy("capture_id").agg(F.count("reason").alias("hidden"))


@query
def recalled_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every omission of the test captures recalled, and a section that isn't there."""
    lines = A.test_lines(spark, d)
    gone = pack.omissions(reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(lines))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "")
    captures = lines.groupBy("capture_id").agg(text.alias("stdout")).withColumn("stderr", F.lit(""))
    requests = gone.select("capture_id", "section_id").unionByName(captures.select("capture_id", F.lit("stdout-5-6").alias("section_id")))
    got = recall.by_section(requests, captures, gone)
    return got.select("capture_id", "section_id", F.sha2("bytes", 256).alias("sha256"), "error")


@query
def capture_status(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("stdout"), F.lit("").alias("stderr"), F.expr("timestamp'2024-01-02 00:00:00' - make_interval(0, 0, 0, 0, cast(doc_id % 48 as int), 0, 0)").alias("created_at"))
    x = x.withColumn("raw_sha256", X.canonical_hash(F.when(F.col("doc_id") % 7 == 0, F.lit("tampered")).otherwise(F.col("stdout")), F.col("stderr")))
    return x.select("doc_id", recall.status(F.expr("timestamp'2024-01-02 00:00:00'")).alias("status"))


@query
def pack_conflicts(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents")
    new = x.select(F.col("doc_id").alias("pack_id"), F.md5(F.col("text").cast("binary")).alias("sha"))
    old = x.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("pack_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.md5(F.col("text").cast("binary"))).alias("sha"))
    return recall.conflicts(new, old, ["pack_id"], "sha").select("pack_id", "outcome")


@query
def superseded_results(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    runs = e.where("event_type = 'view'").selectExpr("session_id", "event_id run_id", "event_id div 100 revision", "event_id start", "event_id + 500 end")
    accepted = e.where("event_type = 'purchase'").selectExpr("session_id", "event_id div 100 revision", "event_id at")
    return state.superseded(runs, accepted).select("run_id", "superseded")


@query
def purged_packs(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").selectExpr("cast(event_id as string) capture_id", "event_id * 10 at")
    return state.purge(e, e.selectExpr("capture_id", "at pack_id"), 95_000, 3600 * 24)[1].select("capture_id", "pack_id")


@query
def traced_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Agent traces from events: clicks use a tool, views answer it, the rest count tokens; some lines are broken."""
    e = A.table(spark, d, "events").selectExpr("user_id session", "event_id", "event_type", "cast(event_id % 97 as bigint) n")
    kind = F.when(F.col("event_type") == "click", "tool_use").when(F.col("event_type") == "view", "tool_result").otherwise("usage")
    obj = F.to_json(F.struct(kind.alias("type"), F.expr("cast(event_id div 3 as string)").alias("id"), F.lit("shell").alias("tool"), F.when(kind == "usage", F.col("n")).alias("input_tokens"), F.repeat(F.lit("x"), F.col("n").cast("int")).alias("content")))
    return report.trace_sums(e.select("session", F.when(F.col("event_id") % 50 == 0, F.lit("oops {")).otherwise(obj).alias("value")))


@query
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "orders").selectExpr("o_orderkey idx", "case when o_orderstatus = 'F' then 'native' else 'rules' end arm", "cast(o_totalprice as bigint) value")
    return report.consecutive_pairs(x, "native", "rules")


@query
def found_needles(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "documents").select(F.expr("concat(source, '-', doc_id div 1000)").alias("scenario"), F.col("doc_id").cast("string").alias("arm"), F.col("text").alias("view"))
    needles = A.table(spark, d, "documents").groupBy(F.expr("concat(source, '-', doc_id div 1000)").alias("scenario")).agg(F.expr("array('the', 'qui', 'zz')").alias("n")).select("scenario", F.explode("n").alias("needle"))
    return report.needles(x, needles)


@query
def expected_levels(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "events").select(F.col("user_id"), (F.col("event_id") % 5).alias("level"), F.round("value").alias("probability")).groupBy("user_id", "level").agg(F.sum("probability").alias("probability"))
    g = x.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("level", "probability"))).alias("levels"))
    return g.select("user_id", F.round(rank.expected_level(F.col("levels")), 6).alias("expected"))


@query
def candidate_minimums(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "events").selectExpr("concat('u', cast(user_id as string)) capture_id", "case user_id % 3 when 0 then 'search' when 1 then 'diff' else 'output' end kind")
    return rank.enough(x)


@query
def evidence_gates(spark: SparkSession, d: str) -> DataFrame:
    return rank.gate(A.table(spark, d, "events").selectExpr("event_id", "event_id % 100 / 100.0D exists_p")).select("event_id", "fallback")


@query
def adaptive_search(spark: SparkSession, d: str) -> DataFrame:
    """Search hits against the ranges of customers; the goal names a file."""
    x = reduce.prepare(A.hit_lines(spark, d).withColumn("goal", F.lit(A.GOAL)), "goal", kind="search")
    x = reduce.adaptive_search(x, ranges(spark, d, "hits-A-", 4, 60_000), A.table(spark, d, "lineitem"))
    return x.groupBy("capture_id").agg(F.count("reason").alias("hidden"), F.count("*").alias("n"))


@query
def new_source_files(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "part").selectExpr("concat(replace(p_name, ' ', '_'), case p_size % 3 when 0 then '.rs' when 1 then '.md' else '.tsx' end) path")
    return review.new_file_findings(x)


@query
def stale_advice(spark: SparkSession, d: str) -> DataFrame:
    x = A.table(spark, d, "orders").selectExpr("cast(o_orderkey as string) capture_id", "o_orderkey % 4 revision", "cast(o_custkey as string) candidate_sha256")
    now = A.table(spark, d, "orders").where("o_orderkey % 10 <> 9").selectExpr("cast(o_orderkey as string) capture_id", "case when o_orderkey % 6 = 0 then 9 else o_orderkey % 4 end revision", "case when o_orderkey % 8 = 0 then 'x' else cast(o_custkey as string) end candidate_sha256")
    return review.stale(x, now).select("capture_id", "stale")


@query
def command_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = [["/usr/bin/Cargo", "test", "-q"], ["C:\\py\\python.exe", "-m", "pytest"], ["python", "-m", "a.@"], ["git@"], ["rg", "-n"], ["npm", "averyverylongword"], ["tool", "run@"]]
    return _of_parts(spark, d, rows, "array<string>").select("id", X.command_label(F.col("x")).alias("label"), X.command_display(F.col("x")).alias("display"))


def queries() -> dict[str, Query]:
    return dict(FOUND)
