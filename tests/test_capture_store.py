"""The capture store: what is visible after failures and races, and ranges of bytes against slices of the texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftspark.functions.text import canonical_hash
from siftspark.sources import capture_store
from siftspark.sources.capture_store import CaptureStore, StoreFull, StoreMoved

SCHEMA = "capture_id string, created_at long, stdout binary, stderr binary"


@pytest.fixture
def store(spark, tmp_path):
    return CaptureStore(spark, str(tmp_path / "store"), chunk=4)


def save(store, *rows):
    return {tuple(r) for r in store.save(store.spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_ranges_equal_slices(spark, store):
    texts = {"a": b"0123456789", "b": bytes(range(250, 256)) * 3, "c": "né漢\U0001f600".encode(), "d": None}
    save(store, *((k, 1, t, b"err " + k.encode()) for k, t in texts.items()))
    asked = [(k, "stdout", i, j) for k in texts for i in range(-1, 13) for j in range(i - 1, 14)] + [("a", "stderr", 0, 5), ("z", "stdout", 0, 1), ("a", "other", 0, 0), ("a", "stdout", 2, 3)]
    got = store.recall(spark.createDataFrame(asked, "capture_id string, stream string, start long, end long")).collect()
    assert len(got) == len(set(asked))
    for r in got:
        text = (texts.get(r["capture_id"]) or b"") if r["stream"] == "stdout" else b"err a"
        fine = r["stream"] != "other" and 0 <= r["start"] <= r["end"] <= len(text)
        want = "missing" if r["capture_id"] == "z" else None if fine else "invalid_range"
        assert r["error"] == want and r["bytes"] == (None if want else bytearray(text[r["start"] : r["end"]])), r


def test_what_is_saved_and_what_is_not(store):
    one = ("a", 1, b"text", None)
    assert save(store, one, one, ("b", 1, b"x", b"y")) == {("a", "append"), ("a", "same"), ("b", "append")}
    assert save(store, ("a", 5, b"text", b""), ("b", 5, b"other", None), ("c", 5, None, None)) == {("a", "same"), ("b", "conflict"), ("c", "append")}
    assert {r["capture_id"] for r in store.captures().collect()} == {"a", "b", "c"}
    assert save(store) == set() and len(store.commits()) == 2
    assert save(CaptureStore(store.spark, store.path, chunk=4, largest=3), ("big", 1, b"1234", None)) == {("big", "too_large")}


def test_quota(store):
    small = CaptureStore(store.spark, store.path, chunk=4, quota=2 * capture_store.OVERHEAD + 5)
    save(small, ("a", 1, b"123", None))
    with pytest.raises(StoreFull):
        save(small, ("b", 1, b"123", None))
    assert save(small, ("b", 1, b"12", None)) == {("b", "append")}


@pytest.mark.parametrize("at", ["texts", "captures", "commit"])
def test_a_failed_save_leaves_nothing_visible(store, tmp_path, monkeypatch, at):
    save(store, ("a", 1, b"123", None))

    def broken(self, rows, name):
        if name.startswith(at):
            rows = rows.withColumn("boom", F.raise_error(F.lit("lost")))
        rows.write.parquet(f"{self.path}/{name}")

    def no_commit(self, number, said):
        raise RuntimeError("lost")

    monkeypatch.setattr(CaptureStore, *(("_commit", no_commit) if at == "commit" else ("_write", broken)))
    with pytest.raises(Exception, match="lost"):
        save(store, ("b", 1, b"12345678", None))
    monkeypatch.undo()
    assert {r["capture_id"] for r in store.captures().collect()} == {"a"} and {r["capture_id"] for r in store.chunks().collect()} == {"a"}
    assert [len(list((tmp_path / "store" / d).iterdir())) for d in ("texts", "captures")] == [1, 1]
    assert save(store, ("b", 1, b"12345678", None)) == {("b", "append")}


def test_of_two_writers_one_wins(store, monkeypatch):
    save(store, ("a", 1, b"123", None))
    seen = store.commits()
    save(store, ("b", 1, b"123", None))
    monkeypatch.setattr(CaptureStore, "commits", lambda self: seen)
    with pytest.raises(StoreMoved):
        save(store, ("b", 1, b"456", None))
    monkeypatch.undo()
    assert [r["raw_sha256"] for r in store.captures().where("capture_id = 'b'").collect()] == [store.spark.range(1).select(canonical_hash(F.lit("123"), F.lit(""))).first()[0]]


def test_purge_forgets_old_saves(store):
    save(store, ("a", 10, b"1", None))
    save(store, ("b", 50, b"2", None))
    assert store.purge(now=40, ttl=20) == [1]
    assert {r["capture_id"] for r in store.captures().collect()} == {"b"} == {r["capture_id"] for r in store.chunks().collect()}
    assert store.purge(now=500, ttl=20) == [2] and store.captures().count() == 0
    assert save(store, ("a", 600, b"3", None)) == {("a", "append")} and [c["number"] for c in store.commits()] == [2, 3]


def test_the_range_reaches_the_scan(spark, store):
    save(store, *((f"c{i:03}", 1, bytes([65 + i % 26]) * 40, None) for i in range(50)))
    asked = spark.createDataFrame([("c007", "stdout", 3)], "capture_id string, stream string, chunk long")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = store.near(asked)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f in plan for f in ("GreaterThanOrEqual(capture_id,c007)", "LessThanOrEqual(capture_id,c007)", "GreaterThanOrEqual(chunk,3)", "LessThanOrEqual(chunk,3)"))
    assert store.near(asked).count() == 1


def test_sections_of_the_same_texts_only(spark, store):
    save(store, ("a", 1, b"0123456789", b"stderr here"))
    sha = store.captures().first()["raw_sha256"]
    packs = spark.createDataFrame(
        [("a", sha, "stdout-2-5", "stdout", 2, 5), ("a", sha, "stderr-0-6", "stderr", 0, 6), ("a", "other", "stdout-1-2", "stdout", 1, 2)],
        "capture_id string, raw_sha256 string, section_id string, stream string, byte_start long, byte_end long",
    )
    asked = spark.createDataFrame([("a", "stdout-2-5"), ("a", "stderr-0-6"), ("a", "stdout-1-2"), ("b", "stdout-2-5")], "capture_id string, section_id string")
    got = {(r["capture_id"], r["section_id"]): (r["bytes"] and bytes(r["bytes"]), r["error"]) for r in store.recall_sections(asked, packs).collect()}
    assert got == {("a", "stdout-2-5"): (b"234", None), ("a", "stderr-0-6"): (b"stderr", None), ("a", "stdout-1-2"): (None, "missing"), ("b", "stdout-2-5"): (None, "missing")}


def test_bytes_are_shown_as_text_or_base64(spark):
    got = spark.createDataFrame([(b"plain",), (b"\xff\xfe",), (None,), (b"",)], "b binary").select(capture_store.shown(F.col("b")).alias("s")).collect()
    assert [r["s"] and tuple(r["s"]) for r in got] == [("utf-8", "plain"), ("base64", "//4="), None, ("utf-8", "")]
