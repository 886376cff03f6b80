"""Preference formatting: chosen and rejected conversations of a pair, the common beginning rendered once.

The longest common prefix of turns (same role and text) is the prompt. What follows on either side is its completion, with
spans of code points marked 1 where the assistant speaks (these count in the loss) and 0 elsewhere (role headers, other
roles). All of it is DataFrame functions: one shuffle by pair, and arrays of a pair's turns.

Defined results: turns are ordered by (turn, role, text), so ties and repeated rows have a place of their own; null text
is rendered empty, null role as ``unknown``, and nulls equal nulls. A pair with one side only has the whole of it as completion
and an empty prompt. Equal sides have empty completions. Rows with a null pair id are left out. Other columns aren't read.
An empty table gives an empty result. A conversation of any length is one row: its turns must fit into a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), _body(t))), "")


def spans(turns: Column) -> Column:
    """``start-end:mask`` for the header and the body of each turn, in code points of ``render(turns)``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def one(acc: Column, t: Column) -> Column:
        mid = acc["at"] + F.length(_head(t["role"]))
        end = mid + F.length(_body(t))
        mark = F.when(F.coalesce(t["role"], F.lit("")) == "assistant", "1").otherwise("0")
        said = F.array(F.concat(acc["at"].cast("string"), F.lit("-"), mid.cast("string"), F.lit(":0")), F.concat(mid.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), mark))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], said).alias("out"))

    return F.array_join(F.aggregate(turns, start, one, lambda acc: acc["out"]), ",")


def turns_of(conversations: DataFrame, key: str) -> DataFrame:
    """(key, turns): each conversation's turns in order."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conversations.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with arrays ``chosen`` and ``rejected`` of (turn, role, text) to prompt, completions and masks."""
    c, r = F.coalesce("chosen", F.array().cast("array<struct<turn:bigint,role:string,text:string>>")), F.coalesce("rejected", F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))
    x = pairs.withColumn("chosen", c).withColumn("rejected", r).withColumn("both", F.least(F.size("chosen"), F.size("rejected")))
    same = lambda i: F.get("chosen", i)["role"].eqNullSafe(F.get("rejected", i)["role"]) & F.get("chosen", i)["text"].eqNullSafe(F.get("rejected", i)["text"])
    differ = F.filter(F.sequence(F.lit(0), F.col("both")), lambda i: (i < F.col("both")) & ~same(i))
    x = x.withColumn("n_prompt", F.coalesce(F.get(differ, F.lit(0)), F.col("both")))
    rest = lambda side: F.slice(side, F.col("n_prompt") + 1, F.size(side))
    for side in ("chosen", "rejected"):
        x = x.withColumn(side, F.when(F.size(side) > F.col("n_prompt"), rest(side)).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string>>"))) if side == "rejected" else x.withColumn("prompt", F.when(F.col("n_prompt") > 0, render(F.slice("chosen", F.lit(1), F.greatest("n_prompt", F.lit(1))))).otherwise("")).withColumn(side, F.when(F.size(side) > F.col("n_prompt"), rest(side)).otherwise(F.array().cast("array<struct<turn:bigint,role:string,text:string>>")))
    kept = [k for k in pairs.columns if k not in ("chosen", "rejected")]
    return x.select(*kept, F.col("n_prompt").cast("long").alias("n_prompt"), "prompt", render(F.col("chosen")).alias("chosen"), render(F.col("rejected")).alias("rejected"), spans(F.col("chosen")).alias("chosen_mask"), spans(F.col("rejected")).alias("rejected_mask"))


def pair_up(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows (key, turn, role, text) of either side to formatted pairs."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sides = chosen.select(key, turn.alias("t"), F.lit(True).alias("c")).unionByName(rejected.select(key, turn.alias("t"), F.lit(False).alias("c"))).where(F.col(key).isNotNull())
    both = sides.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("c"), F.col("t")))).alias("chosen"), F.array_sort(F.collect_list(F.when(~F.col("c"), F.col("t")))).alias("rejected"))
    return format_pairs(both)


def against_neighbour(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """A pair of each conversation: as it is, and with its last answer taken from the conversation whose id differs in the
    last bit. Where that one has no answer the rejected side ends before the answer; a conversation without one keeps both
    sides equal."""
    all_ = turns_of(conversations, key)
    said = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.coalesce(F.element_at("turns", i)["role"] == "assistant", F.lit(False)))
    all_ = all_.withColumn("last", F.when(F.size(said) > 0, F.array_max(said)).otherwise(F.lit(0)))
    other = all_.where("last > 0").select(F.col(key).bitwiseXOR(F.lit(1)).alias(key), F.element_at("turns", F.col("last"))["text"].alias("other"), F.lit(True).alias("found"))
    x = all_.join(other, key, "left")
    answer = F.struct(F.element_at("turns", F.greatest("last", F.lit(1)))["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    before = F.filter("turns", lambda t, i: i < F.col("last") - 1)
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    rejected = F.when(F.col("last") == 0, F.col("turns")).otherwise(F.concat(before, F.when(F.coalesce("found", F.lit(False)), F.array(answer)).otherwise(none)))
    return format_pairs(x.select(key, F.col("turns").alias("chosen"), rejected.alias("rejected")))
