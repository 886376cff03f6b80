from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators import pack, rank, recall, reduce, review


def captures(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "stdout", t) for i, t in enumerate(texts)], "capture_id string, stream string, text string")


def planned(spark, text, kind="output", goal=None):
    lines = X.explode_lines(captures(spark, text))
    if goal:
        from pyspark.sql import functions as F

        lines = lines.withColumn("goal", F.lit(goal))
    out = reduce.plan(lines, kind, "goal" if goal else None)
    return out


def reasons(df):
    return [r["reason"] for r in df.orderBy("line_no").select("reason").collect()]


def test_similar_and_identical_runs(spark):
    text = "".join(f"step {i} of work done\n" for i in range(40)) + "".join("retry the same thing\n" for _ in range(5))
    got = reasons(planned(spark, text))
    assert [i for i, r in enumerate(got) if r is None] == [0, 1, 39, 40]
    assert got[2] == reduce.SIMILAR and got[41:] == [reduce.IDENTICAL] * 4


def test_passing_tests_hide_and_failures_stay(spark):
    text = "running 4 tests\n" + "".join(f"test t::{n} ... ok\n" for n in "abc") + "test t::d ... FAILED\n\nfailures:\n"
    got = reasons(planned(spark, text))
    assert got == [reduce.BOILERPLATE, reduce.TESTS, reduce.TESTS, reduce.TESTS, None, None, None]


def test_goal_keeps_a_named_test(spark):
    text = "".join(f"test t::{n} ... ok\n" for n in ("alpha", "beta", "gamma", "delta"))
    assert reasons(planned(spark, text, goal="why is t::beta slow"))[1] is None


def test_python_frame_takes_its_source_line(spark):
    text = 'Traceback\n  File "/usr/lib/python3/a.py", line 1\n    call()\n  File "/srv/app.py", line 2\n    own()\n'
    assert reasons(planned(spark, text)) == [None, reduce.FRAMES, reduce.FRAMES, None, None]


def test_blank_lines_and_headers(spark):
    got = reasons(planned(spark, "\n\nfirst line here\n\n\nlast line here\n\n"))
    assert got == ["runner_boilerplate", "runner_boilerplate", None, "runner_boilerplate", "runner_boilerplate", None, "runner_boilerplate"]


def test_search_head_keeps_definitions(spark):
    text = "".join(f"src/a{i}.rs:{i + 1}:let x = value_{i};\n" for i in range(60)) + "src/z.rs:9:pub fn wanted() {\n"
    got = reasons(planned(spark, text, "search"))
    assert [i for i, r in enumerate(got) if r is None] == [*range(12), 60]


def test_same_edit_in_more_files(spark):
    body = "-use old_name\n-call old_name\n+use new_name\n+call new_name\n"
    text = "".join(f"diff --git a/src/f{i}.rs b/src/f{i}.rs\n{body}" for i in range(4)) + "diff --git a/src/odd.rs b/src/odd.rs\n-a\n-b\n+c\n+d\n"
    got = reasons(planned(spark, text, "diff"))
    assert got[:5] == [None] * 5 and got[5] is None and got[6:10] == [reduce.SAME_EDIT] * 4 and got[20:] == [None] * 5


def test_lockfile_body_is_hidden(spark):
    text = "diff --git a/Cargo.lock b/Cargo.lock\n" + "".join(f"+line {i}\n" for i in range(40)) + "diff --git a/src/a.rs b/src/a.rs\n+x\n"
    got = reasons(planned(spark, text, "diff"))
    assert got[0] is None and set(got[1:41]) == {reduce.GENERATED} and got[41:] == [None, None]


def test_findings_of_a_diff(spark):
    text = (
        "diff --git a/tests/a_test.py b/tests/a_test.py\n-    assert one\n-    assert two\n+    assert one\n+    @pytest.mark.skip\n"
        "diff --git a/tests/b_test.py b/tests/b_test.py\ndeleted file mode 100644\n"
        "diff --git a/Cargo.toml b/Cargo.toml\n+serde = \"1\"\n+version = \"2\"\n"
    )
    got = {(r["kind"], r["path"]) for r in review.diff_findings(X.explode_lines(captures(spark, text))).collect()}
    assert got == {("weakened_test", "tests/a_test.py"), ("skipped_test", "tests/a_test.py"), ("deleted_test", "tests/b_test.py"), ("dependency_change", "Cargo.toml")}


PARTS = ["a é\n", "x\r\n", "\n", "test m::n ... ok\n", "error: no\n", "same line\n", "same line\n", "tail"]


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30), min_size=10, max_size=20))
def test_blocks_and_omissions_tile_every_byte(spark, texts):
    texts = ["".join(t) for t in texts]
    df = reduce.tiny_gaps(reduce.plan(X.explode_lines(captures(spark, *texts)))).cache()
    assert all(r["gap"] == 0 for r in pack.tiles(df).collect())
    for b in pack.blocks(df).collect():
        raw = texts[int(b["capture_id"][1:])].encode()
        assert raw[b["byte_start"] : b["byte_end"]].decode() == b["rendered_text"]
    df.unpersist()


def test_recall_is_exact_or_fails(spark):
    c = spark.createDataFrame([("k", "a\r\nb\n")], "capture_id string, stdout string")
    r = spark.createDataFrame([("k", 1, 4), ("k", 2, 99), ("none", 0, 1)], "capture_id string, start long, end long")
    got = {(x["capture_id"], x["start"]): (x["bytes"] and bytes(x["bytes"]), x["error"]) for x in recall.by_bytes(r, c).collect()}
    assert got == {("k", 1): (b"\r\nb", None), ("k", 2): (None, "invalid_range"), ("none", 0): (None, "missing")}


def test_kept_candidates_by_need(spark):
    p = [0.5, 0.2, 0.1, 0.08, 0.05, 0.03, 0.02, 0.02]
    rows = [(f"n{need}", f"c{i}", v, float(need)) for need in (0, 1, 3, 4) for i, v in enumerate(p)]
    got = rank.kept(spark.createDataFrame(rows, "capture_id string, candidate_id string, probability double, need double")).groupBy("capture_id").count().collect()
    assert {r["capture_id"]: r["count"] for r in got} == {"n0": 1, "n1": 2, "n3": 4, "n4": 8}


def test_long_captures_take_the_window_path(spark):
    text = "".join(f"line {i}\n" for i in range(700))
    got = X.explode_lines(captures(spark, text, "a\nb")).orderBy("capture_id", "line_no").collect()
    assert len(got) == 702 and got[0]["byte_start"] == 0 and got[699]["byte_end"] == len(text) and got[701]["line"] == "b"


def test_offsets_of_long_captures_whose_rows_repeat(spark):
    texts = ["".join(f"line {i} {'é' * (i % 3)}\n" for i in range(n)) for n in (0, 1, 511, 512, 513, 1024, 1025, 1300)] + ["a\nb", "x\n" * 1100 + "end"]
    rows = [t for t in texts for _ in range(2)]
    ids = spark.createDataFrame([(None, t) for t in rows], "capture_id string, text string").coalesce(1)
    for df in (ids, ids.select("text")):
        got = sorted((r["line_no"], r["byte_start"], r["byte_end"], r["line"]) for r in X.explode_lines(df).collect())
        want, lines = [], [t.splitlines(keepends=True) for t in rows]
        for parts in lines:
            at = 0
            for i, p in enumerate(parts):
                want.append((i, at, at + len(p.encode()), p))
                at += len(p.encode())
        assert got == sorted(want)


def test_chunks_end_after_blank_lines(spark):
    import random

    rng = random.Random(3)
    rows, expected = [], []
    for c in range(6):
        n, share = rng.randint(1, 400), rng.choice([0, 0.02, 0.2, 1])
        gap = rng.randint(0, n)
        hidden = [i != gap for i in range(n)]
        blank = [rng.random() < share for _ in range(n)]
        rows += [(f"c{c}", "stdout", i, 2 * i, 2 * i + 2, " \n" if blank[i] else "x\n", "long_output_middle" if hidden[i] else None) for i in range(n)]
        size = max(30, -(-sum(hidden) // 60))
        for begin, end in ((0, min(gap, n)), (gap + 1, n)):
            at = begin
            while at < end:
                to = min(at + size, end)
                if to < end:
                    to = next((i + 1 for i in range(to - 1, at + size // 2 - 1, -1) if blank[i]), to)
                expected.append((f"c{c}", at, to - 1, 2 * at, 2 * to))
                at = to
    lines = spark.createDataFrame(rows, "capture_id string, stream string, line_no long, byte_start long, byte_end long, line string, reason string")
    got = rank.chunks(lines).select("capture_id", "first_line", "last_line", "byte_start", "byte_end").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert rank.chunks(lines.where("false")).count() == 0


def test_program_of_a_command_display(spark):
    from siftspark.functions.classify import is_program

    rows = [("rg [3 args]", True), ("RG.exe [1 args]", True), ("rg", False), ("rgx [1 args]", False), (None, False)]
    df = spark.createDataFrame(rows, "d string, want boolean")
    assert df.where(is_program(df.d, "rg") != df.want).count() == 0


def test_untracked_files_that_can_be_reviewed(spark):
    rows = [("text", True, b"fine"), ("none", True, None), ("link", False, b"fine"), ("null", True, b"a\x00b"), ("late", True, b"a" * 5000 + b"\x00"), ("bytes", True, b"\xff"), ("cut", True, b"a" * 4095 + "é".encode()), ("large", True, b"a" * ((2 << 20) + 1))]
    files = spark.createDataFrame([("c", *r) for r in rows], "capture_id string, path string, regular boolean, content binary")
    assert {r["path"] for r in review.reviewable(files).where("reviewed").collect()} == {"text", "none", "late"}
    bases = spark.createDataFrame([("c", "x", "d"), ("alone", "x", "d")], "capture_id string, base_commit string, diff string")
    first = {r["capture_id"]: r for r in review.snapshots(bases, files).collect()}
    again = {r["capture_id"]: r for r in review.snapshots(bases, files.repartition(5)).collect()}
    other = {r["capture_id"]: r for r in review.snapshots(bases, files.where("path <> 'link'")).collect()}
    assert first == again and first["c"]["candidate_sha256"] != other["c"]["candidate_sha256"] and (first["c"]["reviewed"], first["c"]["unreviewed"]) == (3, 5)
    assert first["alone"] == other["alone"] and first["alone"]["reviewed"] == 0


def test_scope_review_leaves_out_secrets_and_deleted_files(spark):
    rows = [("c", "stdout", i, f"p{i}", 1, 0, i == 3, "+ api_key = 'sk-" + "a1B2" * 12 + "'\n" if i == 5 else "+ x\n") for i in range(30)]
    changed = spark.createDataFrame(rows, "capture_id string, stream string, section long, path string, added long, removed long, deleted boolean, excerpt string")
    assert [r["path"] for r in review.scope_files(changed).orderBy("section").collect()] == [f"p{i}" for i in range(26) if i not in (3, 5)]


def many_hits(path, content="let total = sum_of_all_values(rows);", n=14):
    return "".join(f"{path}:{i + 1}:{content}\n" for i in range(n))


def test_repeated_hits_go_by_content_and_path(spark):
    hidden = lambda text, goal=None: [i for i, r in enumerate(reasons(planned(spark, text, "search", goal))) if r == reduce.REPEATED_HITS]
    assert hidden(many_hits("src/errors.rs")) == list(range(2, 12))  # a fact's word in the path is no fact
    assert hidden(many_hits("src/abcd.rs"), "look at src/abcd.rs") == []
    assert hidden(many_hits("src/abcd.rs"), "see LET total = sum_of_all_values(rows);") == []
    assert hidden(many_hits("src/abcd.rs", "return Err(failed_to_open_the_file);")) == []
    assert hidden(many_hits("src/abcd.rs", "short one")) == []


def test_search_with_other_lines_is_left_as_it_is(spark):
    for text in (many_hits("src/a.rs") + "--\n" + many_hits("src/b.rs"), many_hits("src/a.rs") + "src/a.rs-15-context\n"):
        rows = planned(spark, text, "search").select("reason", "plan_error").collect()
        assert {tuple(r) for r in rows} == {(None, "unsupported_search_format")}
    assert pack.plan_errors(planned(spark, many_hits("a.rs"), "search")).collect()[0]["plan_error"] is None


def test_search_of_one_file_has_its_path(spark):
    text = "".join(f"{i + 1}:let total = sum_of_all_values(rows);\n" for i in range(14))
    lines = X.explode_lines(captures(spark, text))
    assert reduce.plan(lines, "search").where("plan_error is null").count() == 0
    rows = reduce.plan(lines.selectExpr("*", "'src/one.rs' default_path"), "search").where("reason = 'repeated_search_match_content'").count()
    assert rows == 10


def diff_of(*files):
    return "".join(f"diff --git a/{f} b/{f}\n" + "".join(f"+added {i} in {f}\n" for i in range(8)) for f in files)


def spans(spark, *rows):
    return spark.createDataFrame([("c0", "stdout", *r) for r in rows], "capture_id string, stream string, start long, end long")


def test_ranges_that_hold_no_whole_line_still_ask(spark):
    lines = X.explode_lines(captures(spark, diff_of("one.rs", "two.rs")))
    got = reasons(reduce.plan(lines, "diff", ranges=spans(spark, (3, 9))))
    assert got == [None, *[reduce.ADAPTIVE] * 8] * 2
    got = reasons(reduce.plan(lines, "diff", ranges=spans(spark)))
    assert got == [None] * 18
    start = len("diff --git a/one.rs b/one.rs\n")
    got = reasons(reduce.plan(lines, "diff", ranges=spans(spark, (start, start + len("+added 0 in one.rs\n")), (0, 1))))
    assert got == [None] * 10 + [reduce.ADAPTIVE] * 8


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 30)), max_size=6), st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_selection_by_sweep_equals_all_pairs(spark, ranges, sizes):
    at, lines = 0, []
    for i, n in enumerate(sizes):
        lines.append(("c0", "stdout", i, at, at + n))
        at += n
    x = spark.createDataFrame(lines, "capture_id string, stream string, line_no long, byte_start long, byte_end long")
    got = {r["line_no"] for r in reduce.with_selection(x, spans(spark, *((a, a + n) for a, n in ranges))).where("chosen").collect()}
    assert got == {i for _, _, i, a, b in lines if any(a >= s and b <= s + n for s, n in ranges)}


def test_equal_edits_come_before_redraws(spark):
    body = "-let old_name = 1;\n-old_name()\n+let new_name = 1;\n+new_name()\n 10%\r20%\n"
    got = reasons(planned(spark, "".join(f"diff --git a/f{i}.rs b/f{i}.rs\n{body}" for i in range(3)), "auto"))
    assert got == [None] * 5 + [reduce.REDRAW] + [None, *[reduce.SAME_EDIT] * 5] * 2


def echo_brute(lines):
    """Lines of eight bytes or more without spaces that an earlier fact line holds."""
    return [len(t.encode()) >= 8 and " " not in t and any(t in f for f in lines[:i] if "error" in f) for i, t in enumerate(lines)]


def test_echoes_of_long_short_and_odd_words(spark):
    long_ = "".join(chr(97 + i * i % 26) for i in range(5000))
    lines = ["test a ... ok", f"error in {long_} here", long_, long_[700:2300], long_[1000:1040], long_[4000:] + "z", "error: 漢字仮名/x tests::name_of_it, more", "漢字仮名", "tests::name_of_it", "tests::name_of_it,x", "s::name_of"]
    got = reasons(reduce.plan(X.explode_lines(captures(spark, "".join(f"{t}\n" for t in lines)))))
    assert [r == reduce.DUPLICATE for r in got] == echo_brute(lines)


def test_plans_read_their_lines_once(spark):
    """Whatever the kind, a plan is a chain: the table it is cut by and the narrow looks at it, few shuffles."""
    lines = X.explode_lines(captures(spark, "a line\n", "diff --git a/x b/x\n+y\n")).withColumn("goal", reduce.F.lit("what about tests::one"))
    for kind, goal in (("output", None), ("output", "goal"), ("auto", "goal"), ("search", "goal"), ("diff", None)):
        text = reduce.plan(lines, kind, goal)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Scan parquet") <= 4 and text.count("Exchange hashpartitioning") <= 6, (kind, goal)


def test_lines_are_dealt_to_more_tasks_as_they_grow(spark):
    from siftspark.store import LINES, dealt

    few, many = spark.range(10).selectExpr("'a' capture_id", "id"), spark.range(3 * LINES + 1).selectExpr("cast(id div 1000 as string) capture_id", "id")
    assert dealt(few, few).rdd.getNumPartitions() == 1 and dealt(many, many).rdd.getNumPartitions() == 4
    held = dealt(many, many).groupBy(F.spark_partition_id().alias("p"), "capture_id").count()
    assert held.count() == 3 * LINES // 1000 + 1  # a capture is in one task


def test_only_the_farthest_of_ranges_with_one_start_counts(spark):
    lines = spark.createDataFrame([("a", "stdout", i, i * 10, i * 10 + 10) for i in range(6)] + [("b", "stdout", 0, 0, 10)], "capture_id string, stream string, line_no long, byte_start long, byte_end long")
    ranges = spark.createDataFrame([("a", 10, 15), ("a", 10, 30), ("a", 10, 12), ("a", 10, None), ("a", 40, 49)], "capture_id string, start long, end long").withColumn("stream", F.lit("stdout"))
    got = {(r["capture_id"], r["line_no"]): (r["chosen"], r["asked"]) for r in reduce.with_selection(lines, ranges).collect()}
    assert got == {("a", i): (i in (1, 2), True) for i in range(6)} | {("b", 0): (False, False)}


def test_boilerplate_and_hits_by_one_pattern(spark):
    from siftspark.functions import classify as C

    lines = {"platform -- Python \n": True, "collected items\n": True, "\u00a0 Finished `dev` x target(s) in 1s\n": True, " running 2 tests\n": False, "running 2 tests\r\n": True, "x rootdir: a": False, "Ran all test suites.!": False, "\u2139 todo 0\n": True, "=" * 19: False, "-" * 20: True}
    got = spark.createDataFrame([(k,) for k in lines], "line string").select("line", C.is_boilerplate(F.col("line")).alias("b")).collect()
    assert {r["line"]: r["b"] for r in got} == lines
    hits = {"a:1:b:2:c": None, "a:1:2:c": None, "a:1:b:2": "b:2", "a:1::": ":", ":5:y": None, "a:0:x": None, "C:\\b.rs:7:c\n": "c", "a:12\r:x:3:y": None}
    got = spark.createDataFrame([(k,) for k in hits], "line string").select("line", X.hit(F.col("line"))["content"].alias("c")).collect()
    assert {r["line"]: r["c"] for r in got} == hits


def test_templates_and_facts_are_compiled(spark):
    """Templates, facts and frames by patterns: no lambda, no lower-casing anew for each word. Runs over parts of a stream share the sort of their ordered window."""
    from siftspark.functions import classify as C

    lines = {"deadbeef01 took 15ms in 0x1f": "# took #ms in #x#f", "abcdefg 1234567z a1b2c3d.": "abcdefg #z #.", "é1234567é_7f\r\n": "é#é_#f", "zabc1234 ABCDEF0-ABCDEF": "zabc# #-ABCDEF", "": ""}
    x = spark.createDataFrame([(t,) for t in lines], "line string")
    one = x.select("line", X.template(F.col("line")).alias("t"), C.fact_kind(F.col("line")).alias("f"))
    assert {r["line"]: r["t"] for r in one.collect()} == lines
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in text and "translate" not in text
    said = {"a WARNING": "distinct_warning", "Warn: x": "distinct_warning", "no warn: here": None, "AssertionError": "assertion", "fatal": "failure_identity", "a --> b": "diagnostic_location", "warnıng ſatal": None}
    y = spark.createDataFrame([(t,) for t in said], "line string")
    assert {r["line"]: r["f"] for r in y.select("line", C.fact_kind(F.col("line")).alias("f")).collect()} == said
    frames = {"  at node:x": True, ' File "<frozen x"': True, "at home": False, "look at node:x": False, " at java.x": True}
    z = spark.createDataFrame([(t,) for t in frames], "line string")
    assert {r["line"]: r["f"] for r in z.select("line", C.is_runtime_frame(F.col("line")).alias("f")).collect()} == frames
    runs = reduce.identical_runs(reduce.prepare(X.explode_lines(captures(spark, "a\na\na\n"))))
    assert runs._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2


def test_only_the_end_of_a_line_is_trimmed(spark):
    from siftspark.functions import classify as C

    x = spark.createDataFrame([("a\r\n",), ("running 3 tests\n\u2028",), ("a\rb\r\r\n",), ("\n",), ("t.py ..s [ 4%]\r\u0085",)], "line string")
    got = x.select(X.trim_end(F.col("line")), C.is_boilerplate(F.col("line")), C.is_test_progress(F.col("line")))
    assert [tuple(r) for r in got.collect()] == [("a", False, False), ("running 3 tests\n\u2028", False, False), ("a\rb", False, False), ("", False, False), ("t.py ..s [ 4%]\r\u0085", False, False)]


def test_no_line_carries_the_tokens_of_a_fixed_goal(spark):
    goal = "Why does ..orders::Case_35:: stall AT step_7, which step_7? -- src/p7.rs. About abc"
    x = spark.createDataFrame([(goal,), ("a.b ./x/- ab_ __",), (None,), ("",)], "goal string").select(X.goal_tokens(F.col("goal")))
    assert [r[0] for r in x.collect()] == [["orders::case_35", "stall", "step_7", "src/p7.rs"], [], [], []]
    lines = spark.range(3).select(F.lit("c").alias("capture_id"), F.lit("stdout").alias("stream"), F.col("id").alias("line_no"), F.concat(F.lit("test a::b"), "id", F.lit(" ... ok\n")).alias("line"), F.lit(goal).alias("goal"))
    chain = reduce.tiny_gaps(reduce.passing_tests(reduce.prepare(lines, "goal"))).select("line", "reason", "tokens", "goal_text")
    sorted_ = chain._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1]
    assert "tokens" not in sorted_ and "goal_text" not in sorted_
    lines = spark.createDataFrame([("c", "stdout", 0, "say STEP_7 now\n", ["step_7"]), ("c", "stdout", 1, "say\n", ["step_7"]), ("d", "stdout", 0, "step_7\n", None)], "capture_id string, stream string, line_no long, line string, telling array<string>")
    assert [(r["capture_id"], r["line_no"], r["told"]) for r in reduce.with_told(lines).orderBy("capture_id", "line_no").collect()] == [("c", 0, True), ("c", 1, False), ("d", 0, False)]


def test_a_search_is_looked_at_in_the_order_of_its_lines(spark):
    """runs and counts share passes in line order, and a goal needs no written table. Code of a line is short enough for the JVM to compile: the formats of passing tests are no part of it."""
    lines = X.explode_lines(captures(spark, many_hits("src/a.rs"))).withColumn("goal", F.lit("what about src/a.rs"))
    for goal, sorts in ((None, 3), ("goal", 5)):
        text = reduce.tiny_gaps(reduce.plan(lines, "search", goal)).select("capture_id", "line_no", "reason")._jdf.queryExecution().executedPlan().toString()
        assert text.count("Sort [") <= sorts and "Scan parquet" not in text and text.count("test .*?") == text.count("lambdafunction(CASE WHEN RLIKE")


def test_runs_without_a_sort_by_run(spark):
    flags = [False, True, False, False, True, True, False, False, False]
    x = spark.createDataFrame([(c, "stdout", i, s, 2 * i) for c in ("a", "b") for i, s in enumerate(flags)], "capture_id string, stream string, line_no long, s boolean, n long")
    got = [tuple(r) for r in reduce.with_runs(reduce.with_runs(x, at=F.col("s")), F.col("n"), sums=F.col("s")).orderBy("capture_id", "line_no").select("at_r", "at_k", "sums_k").collect()]
    assert got == 2 * ([(1, 1, 0)] + [(r, 3, 12) for r in (1, 2, 3)] + [(1, 1, 8)] + [(r, 4, 52) for r in (1, 2, 3, 4)])


def test_tokens_told_in_place_are_those_of_a_second_look(spark):
    texts = ["".join(f"src/a.rs:{i + 1}:{'alpha' if i < 9 else 'beta_1' if i % 3 else 'Beta_1 alpha gamma' if i == 30 else 'x'} of it\n" for i in range(40)), "b.rs:1:ALPHA gamma\n", "c.rs:1:x\n"]
    x = reduce.prepare(X.explode_lines(captures(spark, *texts)).withColumn("goal", F.lit("alpha beta_1 gamma")), "goal", "search").withColumn("held", reduce.held_tokens(F.col("line")))
    place = reduce.told_in_place(x.withColumn("n_lines", F.count("*").over(reduce.whole())))
    second = reduce.with_told(x.join(reduce.telling_tokens(x), ["capture_id", "stream"], "left"))
    rows = lambda y: sorted((r["capture_id"], r["line_no"], r["told"]) for r in y.collect())
    assert rows(place) == rows(second) and {told for _, _, told in rows(place)} == {True, False}


def test_equal_hits_of_which_a_part_is_hidden_are_no_run(spark):
    text = "a.rs:3:let x = y;\n" * 4
    at = len("a.rs:3:let x = y;\n")
    assert reasons(planned(spark, text, "search")) == [None] + [reduce.IDENTICAL] * 3
    got = reasons(reduce.plan(X.explode_lines(captures(spark, text)), "search", ranges=spans(spark, (at, 4 * at))))
    assert got == [reduce.ADAPTIVE_SEARCH] + [None] * 3


def test_hits_are_cut_at_their_colons(spark):
    hits = {"C:\\a:12:x": "C:\\a", "C:\\a:0:x": None, "C:/a:b:7:x": None, "1:\\a:7:x": "one.rs", "a:7\u2028:x": None, "é:07:x:y": "é", "a:b:7:x": None, "7:let x": "one.rs", "7:": None, "07:x:8:y": "one.rs", "7:8:y": "7", "a:1234567890123456789:x": None, "a:1:\x1bx": None, "a": None, "": None}
    got = spark.createDataFrame([(k,) for k in hits], "line string").select("line", X.hit(F.col("line"), "one.rs")["path"].alias("p")).collect()
    assert {r["line"]: r["p"] for r in got} == hits


def test_every_section_has_its_standing(spark):
    """no section is left out, whatever the size of its capture, and those kept are the ones of the prefilter."""
    x = spark.range(3000).selectExpr("case when id < 2900 then 'a' when id < 2990 then 'b' end capture_id", "id idx", "concat('word', id % 7, ' of ', if(id % 5 = 0, 'ALPHA', 'x')) text", "array('word3', 'alpha') tokens")
    rows = rank.standings(x).collect()
    score = lambda i: (i % 7 == 3) + (i % 5 == 0)
    wanted = {}
    for of, ids in (("a", range(2900)), ("b", range(2900, 2990)), (None, range(2990, 3000))):
        wanted |= {(of, i): (score(i), r, r <= 64) for r, i in enumerate(sorted(ids, key=lambda i: (-score(i), i)), 1)}
    assert len(rows) == 3000 and {(r["capture_id"], r["idx"]): (r["score"], r["rank"], r["kept"]) for r in rows} == wanted
    assert {(r["capture_id"], r["idx"]) for r in rank.prefilter(x).collect()} == {k for k, v in wanted.items() if v[2]}
