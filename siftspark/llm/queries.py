"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.piece_codec import encode

    return encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True).drop("text")


def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.kd_shards import shards

    return shards(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.weak_quality import judge

    return judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.jaccard_join import near_components

    return near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold() != 0))
    scored = toxicity.score(docs, model).drop("text")
    return scored.withColumn("held_out", F.coalesce(toxicity.fold() == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select("doc_id", "held_out", "score", "predicted")


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.compression_rules import measure

    return measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.preference import against_neighbour

    return against_neighbour(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op8_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.mixing import mixed_ids

    return mixed_ids(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op9_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.fingerprint import compare_with_edits

    return compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm import pseudo_lm
    from siftspark.store import materialize

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = materialize(pseudo_lm.word_counts(docs), "lm-words")
    vocab = pseudo_lm.vocabulary(docs, counts=counts)
    total = counts.agg(F.sum("times")).first()[0] or 0
    return pseudo_lm.score(docs, vocab, pseudo_lm.train(docs, vocab, total=total), rare=pseudo_lm.rare_words(counts, vocab), keep_text=False)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.hard_negatives import of_embeddings

    return of_embeddings(_table(spark, sf_dir, "embeddings"))


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.prefix_forest import of_embeddings

    return of_embeddings(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftspark.llm.infill import digests

    return digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
