"""Reports, views and sources against plain Python."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from siftspark.functions import text as X
from siftspark.operators import pack, rank, recall, reduce, report, review
from siftspark.sources import adapters
from siftspark.streaming import state


def test_medians_of_heavy_and_tied_groups(spark):
    rng = random.Random(5)
    groups = {"big": [rng.gauss(0, 100) for _ in range(5000)], "tied": [7] * 900 + [1] * 899, "odd": [3, 1, 2], "pair": [1, 4], "one": [5.5]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("none", None), (None, 2.0), (None, 8.0)]
    got = {r["arm"]: (r["median_v"], r["n"]) for r in report.medians(spark.createDataFrame(rows, "arm string, v double"), "arm", ["v"]).collect()}
    assert got == {g: (round(statistics.median(vs), 6), len(vs) + (g == "one")) for g, vs in groups.items()} | {"none": (None, 1), None: (5.0, 2)}


def test_superseded_runs_equal_all_pairs(spark):
    rng = random.Random(8)
    runs = [(s, 100 * s + i, rng.randint(0, 6), at := rng.randint(0, 40), at + rng.randint(0, 15)) for s in range(5) for i in range(20)]
    accepted = [(s, rng.randint(0, 6), rng.randint(0, 50)) for s in range(4) for _ in range(8)]
    got = state.superseded(spark.createDataFrame(runs, "session_id long, run_id long, revision long, start long, end long"), spark.createDataFrame(accepted, "session_id long, revision long, at long"))
    want = {(s, i): any(t == s and r > rev and a < at <= b for t, r, at in accepted) for s, i, rev, a, b in runs}
    assert {(r["session_id"], r["run_id"]): r["superseded"] for r in got.collect()} == want


def test_a_result_counts_once_however_often_its_id_was_used(spark):
    import json

    lines = [{"type": "tool_use", "id": "a", "tool": "t"}] * 3 + [{"type": "tool_result", "id": "a", "content": "xyz"}] * 4 + [{"type": "tool_result", "id": "b", "content": "no use"}, {"type": "usage", "input_tokens": 5}]
    x = spark.createDataFrame([("s", json.dumps(e)) for e in lines] + [("s", "{broken")], "session string, value string")
    assert [tuple(r) for r in report.trace_sums(x).collect()] == [("s", 5, 0, 12, 4)]


def test_traces_are_the_same_however_the_file_is_split(spark, tmp_path):
    import json

    lines = [json.dumps({"session": f"s{i % 3}", "type": "usage", "input_tokens": i, "content": "é" * (i % 50)}, ensure_ascii=False) if i % 11 else "{oops" for i in range(400)]
    (tmp_path / "t.jsonl").write_text("\n".join(lines), encoding="utf-8")
    before, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in (before, "1000b", "333b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        events, counts = adapters.read_traces(spark, str(tmp_path))
        seen.append((sorted((r["session"], r["input_tokens"]) for r in events.collect()), [(r["lines"], r["broken"]) for r in counts.collect()]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1] == seen[2] and seen[0][1] == [(400, 37)] and len(seen[0][0]) == 363


def test_null_lists_and_binary_sections(spark, tmp_path):
    names = [b"src/a.rs", b"caf\xe9/\xff.bin", b"line\nbreak.txt", "ü.md".encode()]
    (tmp_path / "list").write_bytes(b"\0".join(names) + b"\0\0")
    got = review.null_list(spark, str(tmp_path / "list")).collect()
    assert sorted(bytes(r["path"]) for r in got) == sorted(names)
    assert {r["name"] for r in got} == {n.decode("utf-8", "replace") for n in names}
    diff = b"junk\ndiff --git a/x b/x\n\xff\x00+\ndiff --git a/caf\xe9 b/y\nBinary diff --git no\n"
    rows = review.binary_sections(spark.createDataFrame([("c", diff), ("e", b""), ("n", None)], "capture_id string, diff binary")).orderBy("section").collect()
    assert [(bytes(r["header"]), r["n_bytes"]) for r in rows] == [(b"diff --git a/x b/x", 23), (b"diff --git a/caf\xe9 b/y", 43)]


def test_verbose_view_spells_a_pack_out(spark):
    text = "".join(f"test t::{n} ... ok\n" for n in ["one_that_is_long", "two_that_is_long", "three_that_is_long", "four_that_is_long"]) + "test t::x ... FAILED\nno newline"
    x = reduce.tiny_gaps(reduce.plan(X.explode_lines(spark.createDataFrame([("cap-1", "stdout", text)], "capture_id string, stream string, text string"))))
    c = spark.createDataFrame([("cap-1", "sh", None, 101, "complete", "selected", ["keep it"]), ("cap-2", "sh", "ls [0 arguments redacted]", None, "partial", "all", None)], "capture_id string, tool string, command_display string, exit_code int, completeness string, coverage string, constraints array<string>")
    got = {r["capture_id"]: r["view"] for r in pack.verbose(x, c).collect()}
    at = text.index("test t::x")
    assert got["cap-1"] == (
        "siftspark: sh\nprocess: FAILED (exit 101); capture: complete; selection: selected\ncapture_id: cap-1\ntrusted task constraint: keep it\n"
        "test inventory: 4 explicit ok results (0 shown, 4 deferred); see process status above\n"
        f"\n[stdout bytes {at}..{len(text)}]\ntest t::x ... FAILED\nno newline\n\nDeferred exact historical sections:\n"
        f"- stdout-0-{at}: 4 lines of successful test inventory; recall with `siftspark recall cap-1 --section stdout-0-{at}`\nFull historical recall: `siftspark recall cap-1 --full`\n"
    )
    assert got["cap-2"].startswith("siftspark: ls [0 arguments redacted]\nprocess: UNKNOWN; capture: partial; selection: all\n")
    assert pack.views(x, c).collect()[0]["view"].split("\n")[1] == "constraint: keep it"


def test_level_answers(spark):
    rows = [[(0, 0.5), (1, 0.5)], [(3, 0.25), (4, 0.75)], [(0, 0.5)], [(0, 0.5), (2, 0.5)], [(1, 0.5), (1, 0.5)], [(0, 0.6), (1, 0.6)], [(0, 1.2), (1, -0.2)], [(0, float("nan")), (1, 1.0)], [(0, None), (1, 1.0)], None, []]
    x = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, levels array<struct<level: int, probability: double>>")
    got = [(r["e"], r["s"]) for r in x.select("i", rank.level_error(F.col("levels"), 2).alias("e"), rank.score_level(F.col("levels"), 2).alias("s")).orderBy("i").collect()]
    assert got == [(None, 0.5), (None, 0.75), *[("shape", None)] * 7, ("missing", None), ("shape", None)]


def test_newest_capture_and_pack_ids(spark):
    c = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "capture_id string, created_at long")
    assert recall.newest(c).first()[0] == "b"
    p = pack.pack_ids(spark.createDataFrame([("ab", "c"), ("a", "bc"), ("ab", "c"), (None, "abc")], "x string, y string"), ["x", "y"])
    assert [len({r["pack_id"] for r in p.collect()}), p.where("pack_id is null").count()] == [3, 0]


def test_manifests_of_files(spark, tmp_path):
    import hashlib

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        for i in range(3):
            (tmp_path / name / f"f{i}").write_bytes(bytes([i, 0, 255]) * (1 + (name == "b" and i == 2)))
    (tmp_path / "b" / "new").write_bytes(b"")
    (tmp_path / "b" / "f0").unlink()
    base = lambda d: adapters.read_files(spark, str(tmp_path / d)).withColumn("path", F.substring_index("path", "/", -1))
    assert {(r["path"], r["sha256"], r["length"]) for r in base("a").collect()} == {(f"f{i}", hashlib.sha256(bytes([i, 0, 255])).hexdigest(), 3) for i in range(3)}
    assert {tuple(r) for r in recall.manifest_diff(base("a"), base("b")).collect()} == {("f0", "missing"), ("f2", "changed"), ("new", "extra")}


def test_empty_files_are_in_a_manifest_by_the_names_of_others(spark, tmp_path):
    import hashlib

    for name in ("a b+c", "é%20", "plain"):
        (tmp_path / f"{name}.full").write_bytes(b"x")
        (tmp_path / f"{name}.none").write_bytes(b"")
    got = {r["path"]: (r["sha256"], r["length"]) for r in adapters.read_files(spark, str(tmp_path)).collect()}
    want = {b"x": (hashlib.sha256(b"x").hexdigest(), 1), b"": (hashlib.sha256(b"").hexdigest(), 0)}
    full = [p for p in got if p.endswith(".full")]
    assert len(full) == 3 and got == {p: want[b"x"] for p in full} | {p.replace(".full", ".none"): want[b""] for p in full}
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "e").write_bytes(b"")
    assert [r["length"] for r in adapters.read_files(spark, str(tmp_path / "only")).collect()] == [0]


def test_receipts_by_session_and_strictly(spark, tmp_path):
    import pytest

    schema = "session_id string, run_id string, raw_bytes long"
    adapters.write_receipts(spark.createDataFrame([("s", "1", 5), ("t", "2", 6)], schema), str(tmp_path / "r"))
    assert [r["run_id"] for r in adapters.read_receipts(spark, str(tmp_path / "r"), schema, strict=True, session="t").collect()] == ["2"]
    spark.range(1).selectExpr("'{oops' value").write.mode("append").text(str(tmp_path / "r"))
    assert adapters.read_receipts(spark, str(tmp_path / "r"), schema).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        adapters.read_receipts(spark, str(tmp_path / "r"), schema, strict=True).collect()


def test_payloads_of_plans_count_shown_facts_and_fall_back_to_the_capture(spark):
    long_ = [("a", 0, "x" * 400, None, "other", "middle"), ("a", 1, "error: lost\n", "failure_identity", "other", "middle"), ("a", 2, "warning: kept\n", "distinct_warning", "other", None), ("a", 3, "-error\n", "failure_identity", "diff", None)]
    short = [("b", 0, "panic\n", "failure_identity", None, "middle"), ("b", 1, "ok\n", None, None, None)]
    planned = spark.createDataFrame([(*r, len(r[2])) for r in long_ + short], "capture_id string, line_no long, line string, fact string, kind string, reason string, n_bytes int")
    views = spark.createDataFrame([("a", "v" * 101), ("b", "v" * 9)], "capture_id string, view string")  # b's view is as long as b
    runs = report.payload_runs(planned, views, "s")
    got = {(r["scenario"], r["arm"]): (r["est_tokens"], r["needles_found"], r["needles_total"]) for r in runs.collect()}
    assert got == {("a", "native"): (-(-433 // 4), 2, 2), ("a", "rules"): (26, 1, 2), ("b", "native"): (3, 1, 1), ("b", "rules"): (3, 1, 1)}
    assert {(r["scenario"], r["arm"]): r["effective"] for r in report.effective_tokens(runs).collect()}[("a", "rules")] == 26 + 109
    totals = {(r["suite"], r["arm"]): (r["tokens"], r["found"], r["reduction_bp"]) for r in report.suite_totals(runs).collect()}
    assert totals[("s", "rules")] == totals[(None, "rules")] == (29, 2, (112 - 29) * 10000 // 112)
    assert report.payload_runs(planned.where("false"), views, "s").count() == 0
