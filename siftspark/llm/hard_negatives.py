"""Hard negatives: rows of another label whose inner product with an anchor lies within a window below that of a positive.

Rows are kept in inverted lists, one for each centroid of a k-means fit, with the largest distance of a member from the centroid. Of any
member x of a list with centroid c and radius r, q.x = q.c + q.(x - c), and by Cauchy-Schwarz the last term is within |q| r either way. An
anchor visits lists by the upper bound, passes over those whose bounds lie outside its window, and stops where the bound falls strictly below
the worst score it holds, once it holds enough. Nothing is approximate: k-means only decides how soon an anchor may stop.

On Spark: lists are cut into parts of bounded size and packed into a row each, so a heavy cluster (or a third of all rows being
copies) is many rows. Anchors visit in waves (4 lists, the next 28, the rest). In a wave, an anchor's requests go to the lists it may not pass over; the
requests of a block of anchors for a list are one row, joined to the list and scored by one matrix product; only scores that can still count
leave the task. The driver holds the centroids (1024 at most) and the lists' radii (``Params.most_lists`` at most, besides one for each centroid).

Defined results: rows with a null label or vector, an empty vector, or a null or non-finite component take no part, nor do rows of another length than the most
common one (of equally common ones the shortest). Of rows with the same id the least (label, vector) counts. Ties go to the smaller id. An
anchor without positives, a positive with a negative score, and an empty table give no rows. Other columns don't matter. Scores are exact while
products of components add up to less than 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.sampling import fitted, least_hashed
from siftspark.store import materialize

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Params:
    """``low`` and ``high``: hundredths of the positive's score between which a negative's lies. ``sample``: rows that k-means is fitted
    to, those of least hash. ``list_rows``: members of a list, more where there would be over ``most_lists`` lists otherwise."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    sample: int = 8192
    rounds: int = 12
    most_centroids: int = 1024
    list_rows: int = 2048
    most_lists: int = 65536
    block: int = 1024
    waves: tuple[int, ...] = (4, 32)


def sound(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    v = vector.cast("array<double>")
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def grid(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers of 1 / scale, rounded down."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))


def taking_part(rows: DataFrame) -> DataFrame:
    """(id long, label long, vec array<double>), each id once, all vectors of one length."""
    x = rows.where(F.col("label").isNotNull() & sound(F.col("vec"))).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null")
    sizes = x.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return x
    return x.where(F.size("vec") == sizes["d"]).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")


def k_means(rows: list[dict], k: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from seeded rows; a centroid that loses all its rows moves to the row that lies farthest from its own."""
    x = np.array([r["vec"] for r in sorted(rows, key=lambda r: r["id"])])
    at = x[np.random.default_rng(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = (at * at).sum(1) - 2 * x @ at.T
        own = far.argmin(1)
        sums, n = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, x)
        at = sums / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            at[lost] = x[np.argsort(-(far.min(1) + (x * x).sum(1)), kind="stable")[: len(lost)]]
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


@dataclass
class Lists:
    """``packed(list, rows)`` on disk; centroid and radius of each list."""

    packed: DataFrame
    centroids: np.ndarray
    list_id: np.ndarray
    cluster: np.ndarray
    radius: np.ndarray


def lists(rows: DataFrame, total: int, p: Params = Params()) -> Lists:
    """Inverted lists of ``rows(id, label, vec)``, a written table of ``total`` rows."""
    h = F.xxhash64(F.col("id"))
    last = least_hashed(rows, h, "id", min(p.sample, total), total)[-1][0]
    k = max(1, min(p.most_centroids, round(total**0.5 / 4)))
    centroids = fitted(rows.where(h <= last), lambda found: k_means(found, k, p.rounds))
    half = (centroids * centroids).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("vec"))
                own = (half - 2 * x @ centroids.T).argmin(1)
                dist = np.sqrt(((x - centroids[own]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(dist)], names=["id", "label", "vec", "cluster", "dist"])

    assigned = materialize(rows.select("id", "label", "vec").mapInArrow(assign, "id long, label long, vec array<double>, cluster int, dist double"), "hn-assigned")
    each = max(p.list_rows, -(-total // p.most_lists))
    sizes = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each centroid
    parts = assigned.sparkSession.createDataFrame([(c, -(-n // each)) for c, n in sizes.items()], "cluster int, parts long")
    x = assigned.join(F.broadcast(parts), "cluster")
    x = x.withColumn("list", F.col("cluster") * F.lit(1 << 32) + F.expr("pmod(xxhash64(id, 1), parts)"))
    told = x.groupBy("list").agg(F.max("dist").alias("radius")).orderBy("list").collect()  # most_lists + most_centroids rows at most
    ids = np.array([r["list"] for r in told], np.int64)
    packed = materialize(x.groupBy("list").agg(F.collect_list(F.struct("id", "label", "vec")).alias("rows")), "hn-lists")
    return Lists(packed, centroids, ids, (ids >> 32).astype(int), np.array([r["radius"] for r in told]))


def _requests(at: Lists, first: int, last: int | None):
    """For each anchor the lists between two places of its order that it may not pass over."""
    centroids, list_id, cluster, radius = at.centroids, at.list_id, at.cluster, at.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, of = [], []
            for i, a in enumerate(b.to_pylist()):
                q = np.array(a["vec"])
                middle, wide = (centroids @ q)[cluster], float(np.sqrt(q @ q)) * radius
                slack = 1e-6 * (1 + np.abs(middle) + wide)  # of the bounds' own rounding
                upper, lower = middle + wide + slack, middle - wide - slack
                lo, hi, kth = (np.array(a[c], float) for c in ("lo", "hi", "kth"))  # by window; nan: no k-th score yet
                order = np.argsort(-upper, kind="stable")
                order = order[((upper[order, None] >= lo) & (lower[order, None] <= hi)).any(1)][first:last]
                up, low = upper[order, None], lower[order, None]
                open_ = ((up >= lo) & (low <= hi) & (np.isnan(kth) | (np.minimum(up, hi) >= kth))).any(1)
                hit = list_id[order[open_]]
                asked.append(hit)
                of.append(np.full(len(hit), i))
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked), pa.int64()), *b.take(pa.array(np.concatenate(of), pa.int64())).columns], names=["list", *b.schema.names])

    return run


def _scan(k: int, same: bool):
    """Scores of a block of anchors over a list: of each anchor and window the first ``k``, those that are none of its first ``k`` left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                rows, asking = b.column("rows")[n].values, b.column("anchors")[n].values
                ids, labels = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                scores = np.rint(_matrix(asking.field("vec")) @ _matrix(rows.field("vec")).T).astype(np.int64)
                out: list[list] = [[], [], [], []]
                told = (asking.field(c).to_pylist() for c in ("anchor_id", "label", "lo", "hi", "kth"))
                for anchor, label, lo, hi, kth, s in zip(*told, scores, strict=True):
                    hi, least = np.array(hi), np.fmax(np.array(lo), np.array(kth))
                    fit = np.flatnonzero(((labels == label) == same) & (ids != anchor) & (s >= least.min()) & (s <= hi.max()))
                    fit = fit[np.lexsort((ids[fit], -s[fit]))]
                    for j in range(len(lo)):
                        mine = fit[(s[fit] >= least[j]) & (s[fit] <= hi[j])][:k]
                        for column, values in zip(out, (np.full(len(mine), anchor), np.full(len(mine), j), s[mine], ids[mine]), strict=True):
                            column.append(values)
                arrays = [np.concatenate(c) if c else np.array([], np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0], pa.int64()), pa.array(arrays[1], pa.int32()), pa.array(arrays[2], pa.int64()), pa.array(arrays[3], pa.int64())], names=["anchor_id", "window", "score", "id"])

    return run


def first_rows(at: Lists, anchors: DataFrame, n_anchors: int, k: int, same: bool, p: Params, name: str) -> DataFrame:
    """The first ``k`` rows by score of each window of ``anchors(anchor_id, label, vec, lo, hi)``, arrays of windows: (anchor_id, window, score, id, rank). ``same``:
    rows of the anchor's label, else of all others."""
    found = None
    blocks = max(1, -(-n_anchors // p.block))
    windows = F.sequence(F.lit(0), F.size("lo") - 1)
    for first, last in zip((0, *p.waves), (*p.waves, None), strict=True):
        asking = anchors.withColumn("kth", F.transform("lo", lambda _: F.lit(float("nan"))))
        if found is not None:
            worst = found.groupBy("anchor_id", "window").agg(F.min("score").cast("double").alias("s"), F.count("*").alias("n")).where(F.col("n") == k)
            worst = worst.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "s"))).alias("worst"))
            asking = anchors.join(worst, "anchor_id", "left").withColumn("kth", F.transform(windows, lambda j: F.coalesce(F.try_element_at("worst", j), F.lit(float("nan"))))).drop("worst")
        columns = "anchor_id long, label long, vec array<double>, lo array<double>, hi array<double>, kth array<double>"
        requests = asking.select("anchor_id", "label", "vec", "lo", "hi", "kth").mapInArrow(_requests(at, first, last), f"list long, {columns}")
        tiles = requests.groupBy("list", F.expr(f"pmod(xxhash64(anchor_id), {blocks})").alias("block")).agg(F.collect_list(F.struct("anchor_id", "label", "vec", "lo", "hi", "kth")).alias("anchors"))
        new = tiles.join(at.packed, "list").select("anchors", "rows").mapInArrow(_scan(k, same), "anchor_id long, window int, score long, id long")
        order = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
        both = new if found is None else found.drop("rank").unionByName(new)
        found = materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"hn-{name}")
    return found


def mine(rows: DataFrame, anchors: Column, p: Params = Params()) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds, among all of ``rows(id, label, vec)``: see ``RESULT``."""
    part = materialize(taking_part(rows), "hn-rows")
    total, n_anchors = part.select(F.count("*"), F.count_if(anchors)).first()
    if not n_anchors:
        return part.sparkSession.createDataFrame([], RESULT)
    at = lists(part, total, p)
    asking = part.where(anchors).select(F.col("id").alias("anchor_id"), "label", "vec")
    every = asking.withColumn("lo", F.array(F.lit(float("-inf")))).withColumn("hi", F.array(F.lit(float("inf"))))
    near = first_rows(at, every, n_anchors, p.positives, True, p, "positives")
    window = F.struct(F.col("rank"), F.ceil(F.col("score") * p.low / F.lit(100.0)).cast("double").alias("lo"), F.floor(F.col("score") * p.high / F.lit(100.0)).cast("double").alias("hi"))
    spans = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(window)).alias("w"))
    bounded = asking.join(spans, "anchor_id").withColumn("lo", F.transform("w", lambda w: w["lo"])).withColumn("hi", F.transform("w", lambda w: w["hi"]))
    far = first_rows(at, bounded, n_anchors, p.negatives, False, p, "negatives")
    positives = near.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(positives, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def of_embeddings(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """``mine`` over ``embeddings(vec_id, embedding, label)``: every hundredth vector is an anchor, every seventh has the label after its own, components are
    whole 256ths."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fit = F.when(sound(F.col("embedding")), grid(F.col("embedding")))
    return mine(embeddings.select(F.col("vec_id").alias("id"), label.alias("label"), fit.alias("vec")), F.col("id") % 100 == 0, p)
