"""A training-corpus pipeline over ``documents``: toxicity, quality rules, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame. ``run`` writes each stage's
result to the folder the cluster shares and reads it back as the next one's input. All stages but the last return the columns of
``documents``; other columns pass through them, whatever their names.

Defined results: an empty table stays empty. Null and empty texts score as the toxicity model scores a text without words, and then
fail the base rule. Repeated rows are judged alike; of those that agree in doc_id and text one stays as a near copy. Rows without a
doc_id are no near copies of others. Rows without words have no tokens and are in no mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import compression_rules, jaccard_join, mixing, piece_codec, toxicity
from siftspark.llm.joins import unused
from siftspark.session import ship
from siftspark.store import discard, materialize

#: every stage needs Python on the executors or a fitted model, which SQL can't express; tests hold run() against brute force
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores 0.5 or more go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.fold() != 0))
    column = unused(docs.columns, "toxicity")
    return toxicity.score(docs, model, column=column).where(F.col(column) < 0.5).drop(column)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the compression bands go."""
    ship(spark)
    held = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"))
    return compression_rules.measure(held).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ship(spark)
    return mixing.select(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, and whether they decode to it."""
    ship(spark)
    return piece_codec.encode(docs.select("doc_id", "text", "lang", "source"), check=True).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("hierarchical_mix", mix),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # nothing reads a stage's input once its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
