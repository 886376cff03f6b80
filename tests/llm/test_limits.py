"""Empty tables, very long texts and clashing columns of the operators, and sharding in tiers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftspark.llm import compression_rules, fingerprint, jaccard_join, kd_shards, mixing, piece_codec, preference, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "The quick brown fox, number {}, jumps over the lazy dog. "


def some(spark, n=60):
    return spark.createDataFrame([(i, LONG.format(i) * (1 + i % 5), "en", f"s{i % 3}", 0) for i in range(n)], DOCS)


@pytest.mark.parametrize("n,leaves", [(8, 8), (19, 5)])
def test_shards_in_tiers_are_of_equal_bytes(spark, n, leaves):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 400), "en" if i % 3 else None, f"s{i % 7}", 0) for i in range(800)], DOCS)
    rows = kd_shards.shards(docs, n=n, leaves=leaves).collect()
    assert len(rows) == 800 and {r["shard"] for r in rows} == set(range(n))
    held = [[r for r in rows if r["shard"] == k] for k in range(n)]
    sizes, mean = [sum(r["size"] for r in h) for h in held], sum(r["size"] for r in rows) / n
    assert max(abs(s - mean) for s in sizes) <= 2 * 401
    assert all(sorted(r["slot"] for r in h) == list(range(len(h))) for h in held)


def test_leaves_of_target_bytes(spark):
    docs = some(spark)
    total = docs.select(F.sum(F.octet_length("text") + 1)).first()[0]
    rows = kd_shards.shards(docs, target_bytes=total // 7).collect()
    assert {r["shard"] for r in rows} == set(range(-(-total // (total // 7))))
    assert {r["shard"] for r in kd_shards.shards(docs, target_bytes=10 * total).collect()} == {0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert piece_codec.encode(docs.select("doc_id", "text"), check=True).count() == 0
    assert compression_rules.measure(docs.select("doc_id", "text")).count() == 0
    assert fingerprint.compare_with_edits(docs).count() == 0
    assert preference.against_neighbour(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts(spark):
    words = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    docs = spark.createDataFrame([(1, words, "en", "s1", 0), (2, words + " tail", "en", "s1", 0), (3, words.replace("w1", "v2"), "en", "s2", 0), (4, "short one", "en", "s2", 0)], DOCS)
    found = {r["doc_id"]: r for r in jaccard_join.near_components(docs.select("doc_id", "text")).collect()}
    assert [found[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    w = words.split()
    assert found[1]["n_shingles"] == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert {r["doc_id"]: r["n_words"] for r in compression_rules.measure(docs.select("doc_id", "text")).collect()} == {1: 60_000, 2: 60_001, 3: 60_000, 4: 2}
    got = piece_codec.encode(docs.where("doc_id < 3").select("doc_id", "text"), check=True)
    assert [c for c in got.columns if c == "round_trip"] and got.where("not round_trip").count() == 0
    assert {r["n_tokens"] for r in mixing.mixed_ids(docs.select("doc_id", "text", "lang", "source")).collect()} <= {60_000, 60_001, 2}


def test_clashing_columns_of_the_first_and_last_stage(spark, tmp_path):
    docs = some(spark).withColumn("toxicity", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("n_tokens", F.lit("mine"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("toxicity <> 'mine' or score <> 'mine'").count() == 0
    last = corpus_pipeline.tokenize(spark, docs, str(tmp_path))
    assert last.count() == 60 and len(last.columns) == len({c.lower() for c in last.columns})
