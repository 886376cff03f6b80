"""Fill-in-middle against a plain loop over code points."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import infill


def brute(doc_id, text):
    s = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", s, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not s or any(m in s for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, s
    p, m, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{z}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{z}<M>{m}"


def told(spark, rows, schema="doc_id long, text string"):
    x = infill.infill(spark.createDataFrame(rows, schema))
    return x.withColumn("back", infill.rebuilt(x["output"], x["form"])).collect()


def test_equals_a_plain_loop_and_gives_the_text_back(spark):
    odd = [None, "", "a", "<", "<P", "<P>", "x<S>y", "<M>", "é漢字\U0001f600 z", "a\r\nb\n\n\x0b", "<S<S", "P>S>M>", "word " * 3, "MM<<PP", "\x00 nul", "ab́c"]
    rows = [(i, odd[i % len(odd)] and odd[i % len(odd)] * (1 + i // 40)) for i in range(400)] + [(None, "no id"), (-3, "negative"), (7, "same id, other text"), (7, odd[7])]
    got = told(spark, rows)
    want = sorted(((i, *brute(i, t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == want
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_text(spark):
    text = "lorem ipsum, " * 150_000
    for r in told(spark, [(i, text) for i in range(3)]):
        assert (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (r["doc_id"], *brute(r["doc_id"], text))
        assert r["back"] == text


def test_empty_table_and_clashing_columns(spark):
    assert told(spark, []) == []
    rows = [(i, "some text here", "kept", 5, "mine") for i in range(20)]
    x = infill.infill(spark.createDataFrame(rows, "doc_id long, text string, Extra string, N long, __row string"))
    assert {"doc_id", "text", "Extra", "__row", "n", "form", "prefix_chars", "middle_chars", "output"} == set(x.columns)
    assert all(r["__row"] == "mine" and r["Extra"] == "kept" and r["n"] == 5 for r in x.collect())


def test_texts_move_once(spark):
    """Units keep the place that the row's number gave them: every shuffle is the one of the texts."""
    x = infill.digests(spark.range(10).selectExpr("id doc_id", "'a b c' text"))
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", final)) <= 1 + final.count("ReusedExchange")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSMa ", max_size=12), st.text(alphabet="<>PSMa ", max_size=12), st.text(alphabet="<>PSMa ", max_size=12), st.booleans())
def test_marks_are_found_whatever_stands_beside_them(p, m, z, spm):
    """What ``rebuilt`` relies on: in a text without a mark, the first mark of a kind in its output is the one that was put there."""
    if any(k in p + m + z for k in ("<P>", "<S>", "<M>")):
        return
    out = f"<S>{z}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{z}<M>{m}"
    at = {k: out.index(f"<{k}>") for k in "PSM"}
    got = (out[at["P"] + 3 : at["M"] if spm else at["S"]], out[at["M"] + 3 :], out[at["S"] + 3 : at["P"] if spm else at["M"]])
    assert got == (p, m, z)


@pytest.mark.parametrize("cut,spm,forms", [(0, 20, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(spark, cut, spm, forms):
    x = infill.infill(spark.range(50).selectExpr("id doc_id", "'two words' text"), p=infill.Params(cut=cut, spm=spm))
    assert {r["form"] for r in x.select("form").collect()} == forms
