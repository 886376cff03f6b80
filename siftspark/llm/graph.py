"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.store import discard, materialize


def components(edges: DataFrame, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``, root the smallest node reached; nodes without an edge don't appear.

    Large-star and small-star rounds (Kiveris et al., 2014): each round hangs every node below its smallest neighbour, so
    the edge count never grows and the depth falls by a constant factor. A round is two hash aggregates and two joins over
    the edges; its result is written to the shared folder, and they end when every node hangs below one root. Only that answer reaches the driver.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("node"), F.lit(0), F.lit(1)) .toDF("node", "below", "above"))
        odd = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))
        if odd.isEmpty():  # each node hangs below one root, and no root below another
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
        after = materialize(small.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), name)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
    out._siftspark_path = now._siftspark_path
    return out
