"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens flows down it: at every node it is dealt to the children by weight,
no child gets more than its subtree can give (its tokens times the epochs allowed), and what a child can't use goes to its
siblings in proportion to their weights. As a node's capacity is that of its subtree, a shortage is made up among siblings
first and reaches the ancestors only where the whole subtree is exhausted. A leaf takes whole epochs, then a prefix of the
next one in the order of md5(seed, epoch, doc_id), up to its budget.

Everything is DataFrame functions. Texts are scanned for their token counts and, in ``select``, once more; no text is shuffled.
Budgets are windows over the tree's nodes. A prefix is found through sums over 4096 slices of the order, so that only the slice
in which it ends is sorted: a leaf with a third of all rows is no heavier for one task than any other.

Defined results: null labels form nodes of their own, named ``unknown``; null or wordless texts have no tokens and are left
out. Rows with the same doc_id in a leaf are taken or left together. Nodes without a weight get the default; a weight of 0
gets nothing. In ``select`` other columns pass through, whatever their names. Amounts are rounded down, so up to one token for each child stays undealt. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.store import discard, materialize

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    share: float = 0.8
    max_epochs: int = 2
    seed: int = 17
    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 1


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(n == "", F.lit("unknown")).otherwise(F.concat(F.lit("d"), (n.cast("int") % 4).cast("string")))


def _weight(name: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, v in sorted(weights.items()):
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def labelled(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of the tree and its tokens, under names of two underscores, which no column of ``docs`` may have."""
    return docs.select("*", domain_of(F.col("source")).alias("__domain"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("__lang"), F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("__source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("__tokens"))


def deal(nodes: DataFrame, parents: list[str], child: str, into: str) -> DataFrame:
    """Deal each parent's ``budget`` among rows with ``cap`` and ``w``; the share of a row goes to ``into``.

    In the order of cap / w, a row is full if its capacity is within its weighted part of what the rows before it leave
    over; full rows come first, and the rest split what remains by weight."""
    by = W.partitionBy(*parents)
    order = by.orderBy((F.col("cap") / F.col("w")), child)
    x = nodes.where("w > 0").withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("rest", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)))
    x = x.withColumn("full", F.col("cap") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("w"))
    x = x.withColumn("given", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)).withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by))
    return x.withColumn(into, F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((budget - given) * w) div greatest(open, 1)"))).drop("before", "rest", "full", "given", "open")


def budgets(leaves: DataFrame, how: Mix) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens)."""
    caps = leaves.withColumn("cap", F.col("tokens") * how.max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * how.share).cast("long").alias("budget"))
    weight = {"domain": how.domains, "lang": how.langs, "source": how.sources}
    above = caps.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("top", F.lit(0)).join(total.withColumn("top", F.lit(0)), "top")
    given = deal(above.withColumn("w", _weight(F.col("domain"), weight["domain"], how.default)), ["top"], "domain", "given_domain")
    langs = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(given.select("domain", F.col("given_domain").alias("budget")), "domain")
    given = deal(langs.withColumn("w", _weight(F.col("lang"), weight["lang"], how.default)), ["domain"], "lang", "given_lang")
    sources = caps.join(given.select("domain", "lang", F.col("given_lang").alias("budget")), ["domain", "lang"])
    given = deal(sources.withColumn("w", _weight(F.col("source"), weight["source"], how.default)), ["domain", "lang"], "source", "given_source")
    return given.select(*LEVELS, "tokens", F.col("given_source").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan(narrow: DataFrame, how: Mix) -> DataFrame:
    """One row a leaf: its budget, the epochs taken whole, and the last key taken of the epoch after them (null: none).
    ``narrow(doc_id, domain, lang, source, n_tokens)``."""
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    dealt = materialize(budgets(leaves, how).withColumn("epochs", F.expr("budget div tokens")).withColumn("remain", F.expr("budget % tokens")), "mix-budgets")
    keyed = narrow.join(dealt.where("remain > 0").select(*LEVELS, "epochs", "remain"), list(LEVELS)).withColumn("key", order_key(how.seed, F.col("epochs"), F.col("doc_id"))).withColumn("slice", F.substring("key", 1, 3))
    slices = keyed.groupBy(*LEVELS, "remain", "slice").agg(F.sum("n_tokens").alias("held"), F.max("key").alias("top"))
    run = W.partitionBy(*LEVELS).orderBy("slice")
    reached = materialize(slices.withColumn("upto", F.sum("held").over(run)).withColumn("before", F.col("upto") - F.col("held")).where("before < remain"), "mix-slices")
    whole = reached.where("upto <= remain").groupBy(*LEVELS).agg(F.max("top").alias("key"))
    last = keyed.join(reached.where("upto > remain").select(*LEVELS, "slice", "before"), [*LEVELS, "slice"])
    inside = last.groupBy(*LEVELS, "remain", "before", "key").agg(F.sum("n_tokens").alias("n"))
    part = inside.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("key"))).where("upto <= remain").groupBy(*LEVELS).agg(F.max("key").alias("key"))
    cut = whole.unionByName(part).groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    out = materialize(dealt.join(cut, list(LEVELS), "left").select(*LEVELS, "tokens", "budget", "epochs", "cut"), "mix-plan")
    discard(dealt, reached)
    return out


def _narrow(docs: DataFrame) -> DataFrame:
    return materialize(labelled(docs.select("doc_id", "text", "lang", "source")).where("__tokens > 0").select("doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens")), "mix-docs")


def _taken(rows: DataFrame, leaves: DataFrame, names: list[str], doc_id: str, how: Mix) -> DataFrame:
    """Rows once for each epoch in which their leaf takes them."""
    x = rows.join(leaves.select(*(F.col(k).alias(n) for k, n in zip(LEVELS, names, strict=True)), F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut")), names)
    more = F.coalesce(order_key(how.seed, F.col("__epochs"), F.col(doc_id)) <= F.col("__cut"), F.lit(False))
    n = F.col("__epochs") + F.when(more, 1).otherwise(0)
    return x.where(n > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))


def mixed_ids(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): the rows of the mixture, without texts."""
    narrow = _narrow(docs)
    return _taken(narrow, plan(narrow, how), list(LEVELS), "doc_id", how).select("doc_id", *LEVELS, "n_tokens", F.col("__epoch").alias("epoch"))


def select(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` in the mixture, each as often as it is taken, with the columns of ``docs``."""
    narrow = _narrow(docs)
    leaves = plan(narrow, how)
    discard(narrow)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")  # columns of any name are safe inside
    return _taken(labelled(rows).where("__tokens > 0"), leaves, ["__domain", "__lang", "__source"], "doc_id", how).select("row.*")
