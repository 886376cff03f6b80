"""Approximate nearest neighbours by inner product: a forest of sorted arrays of long hash strings.

Each tree hashes a vector to a string of 60 bits, signs against planes that are orthogonal within runs of the dimension. A tree is its strings in
order, so the rows that share a prefix with a query are a stretch of it. A query descends to its longest match in each tree and then
ascends all trees together, a bit at a time, until the stretches hold ``enough`` rows; those rows are its candidates, and they are scored on
their original vectors. Vectors are lifted by a coordinate that makes all equally long, so that the largest inner product is the smallest angle.

``enough`` isn't guessed. For ``Params.tuned`` queries the true neighbours are found by a scan, and the least number is taken with which
the forest finds ``Params.recall`` of them: at any size and for any spread of the vectors. Uniform random vectors, which no index
prunes well, need large numbers, clustered ones small.

On Spark: equal vectors are one class, with the ids that can be needed (one more than ``k``; ties go to small ids). Classes are packed in
blocks of bounded size. Strings are dealt by tree, first bits and part, so that a row of the forest is bounded also where a third of all rows share a
prefix; a query goes to all parts of its prefix, or of shorter prefixes while it ascends beyond the first bits. Depths are counted in one pass and
summed by query and length; in the next, candidates leave as pairs of two-byte places by (block of rows, block of queries), and each such tile is
scored at once. No candidate is dropped. The driver holds the sizes of prefixes (2^13 for each tree at most) and the tuning queries' neighbours.

Defined results: null and zero vectors, those with null or non-finite components and those of another length than the most common one (of equally common
ones the shortest) take no part, nor do rows without an id. Rows that agree in id and vector are one; where an id has several vectors each
is a candidate, but none of them is its own query's. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.hard_negatives import sound
from siftspark.store import materialize

RESULT = "query_id long, rank int, vec_id long, score double"
BITS = 60


@dataclass(frozen=True)
class Params:
    """``tuned`` queries of least hash set how far all ascend, so that ``recall`` of their ``k`` neighbours are found."""

    k: int = 20
    trees: int = 64
    recall: float = 0.95
    tuned: int = 128
    seed: int = 11
    block: int = 4096
    queries: int = 1024
    stretch: int = 1 << 18
    pairs: int = 1 << 20


@lru_cache(maxsize=4)
def planes(d: int, trees: int, seed: int) -> np.ndarray:
    """(trees * BITS, d) normals; those of a tree are orthogonal in runs of ``d``."""
    rng = np.random.default_rng(seed)
    runs = -(-BITS // d)
    return np.concatenate([np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0].T for _ in range(runs)])[:BITS] for _ in range(trees)])


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, n) strings as whole numbers, first bit highest."""
    normals = planes(vectors.shape[1], trees, seed)
    worth = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return np.stack([((vectors @ normals[t * BITS : (t + 1) * BITS].T) > 0) @ worth for t in range(trees)])


def lifted(vectors: np.ndarray, longest: float | None) -> np.ndarray:
    """Rows over the longest one's length, with what they lack as one more coordinate; queries (None) lack nothing."""
    if longest is None:
        return np.hstack([vectors / np.sqrt((vectors * vectors).sum(1))[:, None], np.zeros((len(vectors), 1))])
    v = vectors / longest
    return np.hstack([v, np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))[:, None]])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _packed(rows: DataFrame, block: Column, name: str, *columns: str) -> DataFrame:
    """(block, rows): the rows of a block in one, their places fixed by being written."""
    return materialize(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows")), name)


def _coded(packed: DataFrame, p: Params, longest: float | None) -> DataFrame:
    """(tree, code, ref): the strings of packed vectors; ``ref`` is block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in zip(b.column("block").to_pylist(), b.column("rows"), strict=True):
                codes = strings(lifted(_matrix(rows.values.field("vec")), longest), p.trees, p.seed)
                refs = (block << 16) + np.arange(codes.shape[1])
                for t in range(p.trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(refs), t, np.int32)), pa.array(codes[t]), pa.array(refs)], names=["tree", "code", "ref"])

    return packed.select("block", "rows").mapInArrow(run, "tree int, code long, ref long")


@dataclass
class Forest:
    """``arrays(tree, first, part, codes, refs)`` in order of codes; ``sizes[tree, first]`` rows in ``parts`` parts."""

    arrays: DataFrame
    first: int
    sizes: np.ndarray
    parts: np.ndarray


def grow(blocks: DataFrame, n: int, longest: float, p: Params) -> Forest:
    first = min(13, max(0, int(np.ceil(np.log2(max(n, 1) / p.stretch)))))
    coded = materialize(_coded(blocks, p, longest).withColumn("first", F.shiftright("code", BITS - first)), "pf-codes")
    sizes = np.zeros((p.trees, 1 << first), np.int64)
    for r in coded.groupBy("tree", "first").count().collect():  # trees * 2^13 rows at most
        sizes[r["tree"], r["first"]] = r["count"]
    parts = np.maximum(1, -(-sizes // p.stretch))
    spread = coded.sparkSession.createDataFrame([(int(t), int(f), int(parts[t, f])) for t, f in zip(*np.nonzero(parts > 1), strict=True)] or [(-1, -1, 1)], "tree int, first long, parts int")
    dealt = coded.join(F.broadcast(spread), ["tree", "first"], "left").withColumn("part", F.expr("cast(pmod(xxhash64(ref), coalesce(parts, 1)) as int)"))
    entries = F.array_sort(F.collect_list(F.struct("code", "ref")))
    arrays = dealt.groupBy("tree", "first", "part").agg(entries.alias("e")).select("tree", "first", "part", F.col("e.code").alias("codes"), F.col("e.ref").alias("refs"))
    return Forest(materialize(arrays, "pf-forest"), first, sizes, parts)


def _stretch(codes: np.ndarray, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings with so long a prefix of ``q`` begin and end."""
    rest = (np.int64(1) << (BITS - length).astype(np.int64)) - 1
    return np.searchsorted(codes, q & ~rest, "left"), np.searchsorted(codes, q | rest, "right")


def _counts(at: Forest):
    """(ref, length, n): how many rows of a tree share so long a prefix with a query, down to its longest match."""
    first, sizes = at.first, at.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                codes = b.column("codes")[n].values.to_numpy()
                asking = b.column("asks")[n].values
                q, ref = (asking.field(c).to_numpy() for c in ("code", "ref"))
                tree, part = b.column("tree")[n].as_py(), b.column("part")[n].as_py()
                out: list[tuple] = []
                if part == 0:  # prefixes that are shorter than those dealt by are whole rows of the forest
                    for length in range(first):
                        by_prefix = sizes[tree].reshape(1 << length, -1).sum(1)
                        out.append((ref, length, by_prefix[q >> (BITS - length)]))
                for length in range(first, BITS + 1):
                    lo, hi = _stretch(codes, q, np.full(len(q), length))
                    some = hi > lo
                    q, ref = q[some], ref[some]
                    if not len(q):
                        break
                    out.append((ref, length, (hi - lo)[some]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r for r, _, _ in out])), pa.array(np.concatenate([np.full(len(r), k, np.int32) for r, k, _ in out])), pa.array(np.concatenate([c for _, _, c in out]).astype(np.int64))], names=["ref", "length", "n"])

    return run


def _candidates(p: Params, n_blocks: int):
    """(block, of, rows, asking): pairs of places of a row in its block and a query in its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                codes, refs = b.column("codes")[n].values.to_numpy(), b.column("refs")[n].values.to_numpy()
                asking = b.column("asks")[n].values
                q, ref, length = (asking.field(c).to_numpy() for c in ("code", "ref", "length"))
                lo, hi = _stretch(codes, q, length)
                at = 0
                while at < len(q):
                    held = np.cumsum(hi[at:] - lo[at:])
                    upto = at + max(1, int(np.searchsorted(held, p.pairs, "right")))
                    size = hi[at:upto] - lo[at:upto]
                    asks = np.repeat(ref[at:upto], size)
                    begins = np.repeat(lo[at:upto] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                    hits = refs[np.arange(len(asks)) + begins]
                    tile = (asks >> 16) * n_blocks + (hits >> 16)
                    order = np.argsort(tile, kind="stable")
                    tiles, starts = np.unique(tile[order], return_index=True)
                    ends = [*starts[1:], len(tile)]
                    places = lambda x: [(x[order[s:e]] & 0xFFFF).astype("<u2").tobytes() for s, e in zip(starts, ends, strict=True)]  # noqa: B023, E731
                    if len(tiles):
                        yield pa.RecordBatch.from_arrays([pa.array(tiles % n_blocks), pa.array(tiles // n_blocks), pa.array(places(hits), pa.binary()), pa.array(places(asks), pa.binary())], names=["block", "of", "rows", "asking"])
                    at = upto

    return run


def _best(scores: np.ndarray, ids: list, vectors: np.ndarray, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The first ``k`` (score, id) of classes with these scores, by score exactly summed, then id."""
    near = np.flatnonzero(scores > -np.inf)
    if len(near) > k:
        least = np.partition(scores[near], len(near) - k)[len(near) - k]
        near = near[scores[near] >= least - 1e-9 * (1 + abs(least))]
    exact = dots(vectors[near], np.broadcast_to(query, (len(near), len(query))))
    return sorted(((float(s), i) for s, c in zip(exact, near, strict=True) for i in ids[c]), key=lambda x: (-x[0], x[1]))[:k]


def _tiles(p: Params):
    """(ref, score, id): of each query of a tile the first rows among its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                block, of = b.column("rows")[n].values, b.column("queries")[n].values
                x, q, ids = _matrix(block.field("vec")), _matrix(of.field("vec")), block.field("ids").to_pylist()
                asked = np.zeros((len(q), len(x)), bool)
                for pair in b.column("pairs")[n].as_py():
                    asked[np.frombuffer(pair["asking"], "<u2"), np.frombuffer(pair["rows"], "<u2")] = True
                scores = np.where(asked, q @ x.T, -np.inf)
                base = b.column("of")[n].as_py() << 16
                found = [(base + i, s, vec_id) for i in np.flatnonzero(asked.any(1)) for s, vec_id in _best(scores[i], ids, x, q[i], p.k + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["ref", "score", "id"])

    return run


def _true_neighbours(blocks: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of some queries the vectors of its nearest classes but itself, by a scan that keeps ``k`` of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column("rows"):
                x = _matrix(rows.values.field("vec"))
                scores = queries @ x.T
                for i, q in enumerate(queries):
                    scores[i, (x == q).all(1)] = -np.inf
                    top = np.argsort(-scores[i], kind="stable")[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i, np.int32)), pa.array(scores[i, top]), pa.array(x[top].tolist(), pa.list_(pa.float64()))], names=["i", "score", "vec"])

    near = blocks.select("rows").mapInArrow(run, "i int, score double, vec array<double>").where(F.col("score") > float("-inf"))
    best = near.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "vec"))).where(F.col("r") <= k)
    found: list[list] = [[] for _ in queries]
    for r in best.select("i", "vec").collect():  # tuned * k rows at most
        found[r["i"]].append(r["vec"])
    return [np.array(v) for v in found]


def _enough(blocks: DataFrame, asking: DataFrame, totals: DataFrame, longest: float, p: Params) -> int:
    """The least number of rows that stretches must hold for the tuning queries to find the recall asked for."""
    each = asking.select(F.col("block"), F.posexplode("rows").alias("i", "row")).select(F.expr("block * 65536L + i").alias("ref"), "row.vec")
    tuned = each.orderBy(F.xxhash64("ref"), "ref").limit(p.tuned).collect()
    q = np.array([r["vec"] for r in tuned])
    truth = _true_neighbours(blocks, q, p.k)
    held: dict[int, dict[int, int]] = {r["ref"]: {} for r in tuned}
    for r in totals.where(F.col("ref").isin(list(held))).collect():
        held[r["ref"]][r["length"]] = r["n"]
    wanted: list[tuple[float, float]] = []  # (rows that must be held to reach a neighbour, its weight)
    of_queries = strings(lifted(q, None), p.trees, p.seed)
    for i, r in enumerate(tuned):
        if len(truth[i]):
            shared = strings(lifted(truth[i], longest), p.trees, p.seed) ^ of_queries[:, i : i + 1]
            depth = BITS - np.where(shared > 0, np.floor(np.log2(np.maximum(shared, 1).astype(float))) + 1, 0).min(0).astype(int)
            # a query that stops deeper than ``depth`` misses it: the next deeper length must hold too few
            wanted += [(held[r["ref"]].get(int(x) + 1, 0) + 1, 1 / len(depth)) for x in depth]
    if not wanted:
        return 1
    wanted.sort()
    got = np.cumsum([w for _, w in wanted]) / sum(w for _, w in wanted)
    return int(wanted[int(np.searchsorted(got, p.recall))][0])


def nearest(rows: DataFrame, queries: Column, p: Params = Params()) -> DataFrame:
    """The ``k`` nearest found of each row of ``rows(id, vec)`` for which ``queries`` holds, among all other rows: see ``RESULT``."""
    fit = rows.where(F.col("id").isNotNull() & sound(F.col("vec"))).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where(F.exists("vec", lambda x: x != 0))
    sizes = fit.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = rows.sparkSession.createDataFrame([], RESULT)
    if sizes is None:
        return empty
    fit = fit.where(F.size("vec") == sizes["d"]).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0 is 0
    told = materialize(fit.distinct().withColumn("asks", F.coalesce(queries, F.lit(False))).select("id", "vec", "asks"), "pf-rows")
    first = told.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("r") <= p.k + 1)
    ids = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialize(ids.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), "pf-classes")
    n, longest = classes.select(F.count("*"), F.sqrt(F.max("norm2"))).first()
    asked = told.where("asks").select("vec").distinct()
    wanted = asked.count()
    if not wanted:
        return empty
    n_blocks, q_blocks = -(-n // p.block), -(-wanted // p.queries)
    by = lambda count: F.expr(f"pmod(xxhash64(vec), {count})")
    blocks = _packed(classes, by(n_blocks), "pf-blocks", "ids", "vec")
    asking = _packed(asked, by(q_blocks), "pf-asking", "vec")

    forest = grow(blocks, n, longest, p)
    codes = materialize(_coded(asking, p, None).withColumn("first", F.shiftright("code", BITS - forest.first)), "pf-asked")
    keys, entry = ["tree", "first"], F.collect_list(F.struct("code", "ref"))
    depths = forest.arrays.join(codes.groupBy(*keys).agg(entry.alias("asks")), keys).select("tree", "part", "codes", "asks").mapInArrow(_counts(forest), "ref long, length int, n long")
    totals = materialize(depths.groupBy("ref", "length").agg(F.sum("n").alias("n")), "pf-depths")
    enough = _enough(blocks, asking, totals, longest, p)
    stops = totals.groupBy("ref").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("length"))), F.lit(0)).alias("length"))

    going = codes.join(stops, "ref")
    beyond = F.greatest(F.lit(forest.first) - F.col("length"), F.lit(0))  # bits of the prefixes dealt by that the query has left behind
    width = F.call_function("shiftleft", F.lit(1).cast("long"), beyond)
    going = going.withColumn("width", width).withColumn("least", F.expr("first - first % width")).withColumn("first", F.explode(F.expr("sequence(least, least + width - 1)"))).drop("width", "least")
    asks = going.groupBy(*keys).agg(F.collect_list(F.struct("code", "ref", "length")).alias("asks"))
    pairs = forest.arrays.join(asks, keys).select("codes", "refs", "asks").mapInArrow(_candidates(p, n_blocks), "block long, of long, rows binary, asking binary")
    tiles = pairs.groupBy("block", "of").agg(F.collect_list(F.struct("rows", "asking")).alias("pairs"))
    tiles = tiles.join(blocks, "block").join(asking.select(F.col("block").alias("of"), F.col("rows").alias("queries")), "of")
    scored = tiles.select("of", "rows", "queries", "pairs").mapInArrow(_tiles(p), "ref long, score double, id long")
    order = W.partitionBy("ref").orderBy(F.desc("score"), "id")
    best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= p.k + 1).groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("best"))

    named = asking.select("block", F.posexplode("rows").alias("i", "row")).select("row.vec", F.expr("block * 65536L + i").alias("ref"))
    each = told.where("asks").select(F.col("id").alias("query_id"), "vec").join(named, "vec").select("query_id", "ref").join(best, "ref")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, p.k)
    out = each.select("query_id", F.posexplode(others).alias("i", "b"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def of_embeddings(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """``nearest`` over ``embeddings(vec_id, embedding)`` for every twentieth vector."""
    return nearest(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), F.col("id") % 20 == 0, p)
