"""Operators over embeddings, against brute force in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from conftest import DATA
from siftspark.llm import hard_negatives, prefix_forest, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n, d=12, groups=6, spread=0.3, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    x = centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def odd_rows(n):
    """Clustered rows with a third of them equal, and rows that take no part."""
    x = vectors(n)
    x[1 : n // 3] = x[1]
    rows = [(i, [float(v) for v in x[i]], i % 10) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * 12, [inf] + [0.0] * 11, [None] + [0.5] * 11, [0.5] * 5, [0.0] * 12]
    return rows + [(n + 100 - n % 100 + 100 * k, v, 1) for k, v in enumerate(bad)] + [(None, rows[0][1], 1), (100_001, rows[5][1], None)]


def fits(row, zero=True):
    v = row[1]
    return row[0] is not None and v is not None and len(v) == 12 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


def negatives_brute(rows):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in v]) for i, v, label in rows if label is not None and fits((i, v))]
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(va, v, strict=True)), i, label == la) for i, label, v in rows if i != a))
        for s, i, _ in [x for x in scored if x[2]][:5]:
            inside = [(-t, j) for t, j, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(a, i, r + 1, j, -s, t) for r, (t, j) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rows = odd_rows(700)
    small = hard_negatives.Params(list_rows=40, block=3, waves=(1, 3), sample=200)
    for p in (hard_negatives.Params(), small):
        got = hard_negatives.of_embeddings(spark.createDataFrame(rows, SCHEMA), p)
        assert sorted(map(tuple, got.collect())) == negatives_brute(rows)


def test_hard_negatives_skip_lists(spark):
    """On clustered rows the bounds leave most lists unvisited, and the result is that of a visit to all."""
    rows = [(i, [float(c) for c in v], i % 4) for i, v in enumerate(vectors(3000, groups=10, spread=0.03))]
    part = hard_negatives.taking_part(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id id", "label", "transform(embedding, x -> floor(256 * x)) vec"))
    at = hard_negatives.lists(part, 3000)
    ask = part.where("id % 100 = 0").selectExpr("id anchor_id", "label", "vec", "array(cast('-Infinity' as double)) lo", "array(cast('Infinity' as double)) hi", "array(cast(200.0 * 250 as double)) kth")
    asked = ask.mapInArrow(hard_negatives._requests(at, 0, None), "list long, anchor_id long, label long, vec array<double>, lo array<double>, hi array<double>, kth array<double>")
    assert 0 < asked.count() < 30 * len(at.list_id) / 3


def test_hard_negatives_of_repeated_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.of_embeddings(none).collect() == []
    rows = odd_rows(300)
    got = hard_negatives.of_embeddings(spark.createDataFrame(rows + rows[:120], SCHEMA).selectExpr("*", "'x' id", "'y' vec"))
    assert sorted(map(tuple, got.collect())) == negatives_brute(rows)
    assert hard_negatives.of_embeddings(spark.createDataFrame([(3, [1.0], 1)], SCHEMA)).collect() == []


def nearest_brute(rows, k=20):
    rows = [r for r in rows if fits(r, zero=False)]
    x = np.array([r[1] for r in rows])
    out = {}
    for i, r in enumerate(rows):
        if r[0] % 20 == 0:
            s = prefix_forest.dots(np.broadcast_to(x[i], x.shape), x)
            order = sorted((-s[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != r[0])[:k]
            out[r[0]] = [(j, -t) for t, j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_nearest_is_exact_where_all_is_asked(spark):
    """With a recall of 1 the forest must ascend to the last neighbour of the tuning queries; here these are all queries."""
    rows = odd_rows(500)
    for p in (prefix_forest.Params(recall=1.0), prefix_forest.Params(recall=1.0, block=64, queries=3, stretch=50, trees=5, pairs=100)):
        got, want = found(prefix_forest.of_embeddings(spark.createDataFrame(rows, SCHEMA), p)), nearest_brute(rows)
        assert got.keys() == want.keys()
        for q in want:
            assert [round(s, 12) for _, s in got[q]] == [round(s, 12) for _, s in want[q]]
            assert {i for i, s in got[q] if s > got[q][-1][1] + 1e-9} == {i for i, s in want[q] if s > want[q][-1][1] + 1e-9}


def test_ties_go_to_small_ids(spark):
    rows = odd_rows(300)
    got = found(prefix_forest.of_embeddings(spark.createDataFrame(rows, SCHEMA), prefix_forest.Params(recall=1.0)))
    assert [i for i, _ in got[20]] == [i for i in range(1, 30) if i != 20][:20]  # rows 1 to 99 are equal


def test_nearest_by_inner_product_not_by_angle(spark):
    x = vectors(400) * np.linspace(0.1, 5, 400)[:, None]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got, want = found(prefix_forest.of_embeddings(spark.createDataFrame(rows, SCHEMA))), nearest_brute(rows)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9


def test_recall_on_the_test_table(spark):
    e = spark.read.parquet(str(DATA / "embeddings.parquet"))
    got = found(queries.queries()["op12_prefix_forest"](spark, str(DATA)))
    table = e.collect()
    x, ids = np.array([r["embedding"] for r in table], float), [r["vec_id"] for r in table]
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    hit = np.mean([len({i for i, _ in got[ids[a]]} & {ids[j] for j in np.argsort(-s[n])[:20]}) / 20 for n, a in enumerate(asked)])
    assert set(got) == {ids[a] for a in asked} and hit >= 0.9


@pytest.mark.parametrize("rows", [[], [(20, None, 1)], [(20, [0.0, 0.0], 1)], [(3, [1.0, 2.0], 1), (7, [1.0, 0.0], 1)]])
def test_nearest_of_nothing(spark, rows):
    assert prefix_forest.of_embeddings(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_one_row_and_repeats(spark):
    assert prefix_forest.of_embeddings(spark.createDataFrame([(20, [1.0, 2.0], 1)], SCHEMA)).collect() == []
    rows = [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (21, [1.0, 2.0], 2), (21, [1.0, 2.0], 2), (22, [2.0, 1.0], 1)]
    assert found(prefix_forest.of_embeddings(spark.createDataFrame(rows, SCHEMA))) == {20: [(21, 5.0), (22, 4.0)]}


def test_rows_without_a_key_stay_where_they_are(spark):
    from siftspark.llm.joins import skew_join

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(3000)], "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3)], "k string, v long")
    got = skew_join(rows, table, "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted((i, k, {"hot": 1, "k2": 2, "k5": 3}.get(k)) for i, k in rows.collect())
    few = skew_join(rows.where("i < 3"), table, "k", "v")
    assert sorted(map(tuple, few.collect())) == [(0, None, None), (1, "hot", 1), (2, "k2", 2)]
