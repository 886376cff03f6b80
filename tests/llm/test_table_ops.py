"""Operators over tables, against brute force in plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from conftest import DATA, same_as_oracle
from siftspark.llm import fingerprint, graph, jaccard_join, kd_shards, mixing, oracles, preference, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    same_as_oracle(spark, duck, queries.queries()[name], oracles.oracle_sql()[name])


def sets_of(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets)), key=repr)


def corpus(seed, groups=6, copies=9, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for _ in range(groups):
        text = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            t = list(text)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t) + (" " + shared if rng.random() < 0.4 else ""))
    rows += ["", None, "one", "one", "ONE", "two words", " ", shared, shared]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("how", [jaccard_join.Join(), jaccard_join.Join(block_classes=4, block_tokens=300, part_tokens=500)], ids=["whole blocks", "thinned and chunked"])
def test_near_components_equal_all_pairs(spark, how):
    rows = corpus(5)
    df = spark.createDataFrame([*rows, (None, "a b c d e f g")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_components(df, how).collect()), key=repr)
    assert got == near_brute([*rows, (None, "a b c d e f g")])


def test_divide_skip_finds_every_component_of_a_large_block():
    import numpy as np

    rng = random.Random(2)
    docs = []
    for _ in range(4):
        core = rng.sample(range(10_000), 60)
        docs += [sorted(set(core) - set(rng.sample(core, 3)) | set(rng.sample(range(10_000), 3))) for _ in range(40)]
    sets = [np.array(d, dtype=np.int64) for d in docs]
    how = jaccard_join.Join()
    for small in (1, 1000):
        links = jaccard_join.divide_skip([len(s) for s in sets], sets, list(range(len(sets))), how, small=small)
        parts = jaccard_join._Parts(list(range(len(sets))))
        for i, j in links:
            assert 100 * len(set(docs[i]) & set(docs[j])) >= 80 * len(set(docs[i]) | set(docs[j]))
            parts.join(i, j)
        want = jaccard_join._Parts(list(range(len(sets))))
        for i in range(len(docs)):
            for j in range(i):
                if 100 * len(set(docs[i]) & set(docs[j])) >= 80 * len(set(docs[i]) | set(docs[j])):
                    want.join(i, j)
        assert [parts.root(i) for i in range(len(docs))] == [want.root(i) for i in range(len(docs))]


@pytest.mark.parametrize("classes", [63, 64, 65, 999, 1000, 1001])
def test_divide_skip_links_the_same_parts_by_heap_and_on_arrays(classes):
    import numpy as np

    rng, how = random.Random(classes), jaccard_join.Join()
    cores = [rng.sample(range(3000), 30) for _ in range(classes // 20)]
    sets = []
    for i in range(classes):
        core = cores[i % len(cores)]
        sets.append(np.array(sorted(set(core) - set(rng.sample(core, i % 4)) | set(rng.sample(range(3000), i % 4))), dtype=np.int64))
    has = np.zeros((classes, 3000), np.float32)
    for i, x in enumerate(sets):
        has[i, x] = 1
    common, size = has @ has.T, has.sum(axis=1)
    linked = 100 * common >= 80 * (size[:, None] + size[None] - common)
    want = jaccard_join._Parts(list(range(classes)))
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        want.join(i, j)
    for how_small in ({}, {"small": 0}, {"small": 10_000}):
        got = jaccard_join._Parts(list(range(classes)))
        for i, j in jaccard_join.divide_skip([len(x) for x in sets], sets, list(range(classes)), how, **how_small):
            assert linked[i, j]
            got.join(i, j)
        assert [got.root(i) for i in range(classes)] == [want.root(i) for i in range(classes)]


def test_groups_at_the_bound_of_a_block_equal_all_pairs(spark):
    rng, rows = random.Random(30), []
    for g, copies in enumerate([29, 30, 31]):
        core = [f"g{g}w{i}" for i in range(60)]
        for _ in range(copies):
            t = list(core)
            t[rng.randrange(60)] = f"n{len(rows)}"
            if rng.random() < 0.3:
                t[rng.randrange(60)] = f"m{len(rows)}"
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_components(df, jaccard_join.Join(block_classes=30)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == near_brute(rows)


def test_near_duplicates_keep_one_and_blanks(spark):
    rows = [(3, "a b c d e f g h", "x"), (1, "A b c d e f g h", "y"), (2, None, "z"), (2, None, "z"), (5, "other words are here for sure", "q"), (1, "A b c d e f g h", "y")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, "y"), (2, "z"), (2, "z"), (5, "q")]
    assert jaccard_join.keep_one(got.where("false")).count() == 0


def test_stages_take_columns_of_any_name_and_empty_tables(spark):
    import corpus_pipeline

    names = ["keep", "KEEP_TEXT", "__tokens", "__Lang", "row", "Kept", "toxicity", "x__words"]
    rows = [(i, "some words of a text that are here for all to read " * 2 + f"number {i // 2}", "en", "s1", *(f"{n}{i}" for n in names)) for i in range(6)] + [(None, None, None, None, *(None for _ in names)), (9, "", "en", "s1", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, df, str(DATA))
        assert got.columns == df.columns
        assert all(r["keep"] == f"keep{r['doc_id']}" for r in got.collect() if r["doc_id"] is not None and r["doc_id"] < 9)
        assert stage(spark, df.where("false"), str(DATA)).count() == 0


def test_near_duplicates_of_repeated_ids_keep_one_of_each_group(spark):
    one, two, three = "a b c d e f g h", "other words are here for sure", "and a third text that nothing else is like"
    rows = [(1, one), (1, two), (1, three), (2, one), (7, three), (3, two), (1, one)]
    for order in (rows, rows[::-1]):
        got = jaccard_join.keep_one(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, one), (1, two), (1, three)])


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 5}") for i in range(600)] + [(7, "same", "en", "hot")] * 200 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards.shards(df).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    size = {}
    for r in got:
        size.setdefault(r["shard"], []).append(r)
    assert sorted(size) == list(range(8))
    total = [sum(r["size"] for r in x) for x in size.values()]
    assert max(total) - min(total) < 1500
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in size.values())
    assert kd_shards.shards(df.where("false")).count() == 0
    assert {r["shard"] for r in kd_shards.shards(df.limit(3)).collect()} <= set(range(8))


@pytest.mark.parametrize("n", [1, 3, 6, 8])
def test_shards_equal_a_plain_tree(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(5000), "y" * rng.randint(0, 300), rng.choice(["en", "de", None]), rng.choice(["a", "b", "hot", "hot", "hot"])) for _ in range(400)] + [(7, "same", "en", "hot")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    narrow, _, _ = kd_shards._scaled(kd_shards.describe(df))
    points = [r.asDict() for r in narrow.collect()]

    def split(part, k):
        if k == 1 or len(part) < 2:
            return [part] + [[] for _ in range(k - 1)]
        spread = [max(x[f"k{d}"] >> 32 for x in part) - min(x[f"k{d}"] >> 32 for x in part) for d in range(4)]
        d = max(range(4), key=lambda i: (spread[i], -i))
        part = sorted(part, key=lambda x: (x[f"k{d}"], x["low"]))
        share, sums = sum(x["size"] for x in part) * (k // 2) / k, [0]
        for x in part:
            sums.append(sums[-1] + x["size"])
        cut = min(range(1, len(part)), key=lambda i: (abs(sums[i] - share), -i))
        return split(part[:cut], k // 2) + split(part[cut:], k - k // 2)

    want = [sorted((x["doc_id"], x["size"], x["text_crc32"]) for x in leaf) for leaf in split(points, n)]
    got = [[] for _ in range(n)]
    for r in kd_shards.shards(df, n).collect():
        got[r["shard"]].append((r["doc_id"], r["size"], r["text_crc32"]))
    assert [sorted(x) for x in got] == want


def likeness(a, b):
    cells = lambda t: set(re.findall(r"[^\n]{1,128}", t))
    x, y = cells(a), cells(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_fingerprints_equal_sets(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["alpha", "béta", "γ", "delta"]) + str(rng.randint(0, 99)) for _ in range(12))
    texts = ["", "a", "\n".join(line() for _ in range(3)), "\n".join(line() for _ in range(90)), "same\nsame", "same\nsame", None, "x" * 1000, "\n\n"]
    rows = list(zip([5, 1, 900, 77, 3, 4, 12, 100_000, 13], texts, strict=True))
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(t, edited)) < 1e-12 and abs(r["near_next"] - likeness(t, n)) < 1e-12
    assert got[3]["fingerprint"] == got[4]["fingerprint"]
    alone = fingerprint.compare_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def inverted(text):
    """(b, digests) of a fingerprint, from its text alone: each group is peeled place by place."""
    bits, groups = text.split("|")
    found = set()
    for group in filter(None, groups.split(";")):
        size, places = group.split(":")[1].split("/")
        state = {}
        for place in filter(None, places.split("-")):
            c, n, k, h = (int(x, 16) for x in place.split("."))
            state[c] = [n, k, h]
        members = {}  # a pure place gives a digest, whose other places hold it as well
        while pure := [(c, x) for c, x in state.items() if x[0] == 1]:
            k, h = pure[0][1][1:]
            members[k] = h
            for c in _places[k, int(size)]:
                state[c] = [state[c][0] - 1, state[c][1] ^ k, state[c][2] ^ h]
        assert all(x == [0, 0, 0] for x in state.values())
        found |= set(members)
    return int(bits), found


#: (digest, size) to its places, filled by the test
_places: dict = {}


def test_likeness_follows_from_the_fingerprints_alone(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    line = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(14))
    base_ = [line() for _ in range(300)]
    texts = ["\n".join(base_), "\n".join(base_[:150] + [line() for _ in range(150)]), "\n".join(base_[:4]), "", line(), "\n".join(base_[:40]), "\n".join(base_[1:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fingerprint.compare_with_edits(df).collect())
    keys = [int(r[0]) & (2**64 - 1) for r in df.select(F.explode(fingerprint.digests(F.col("text")))).distinct().collect()]
    edits = spark.createDataFrame([(i, texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[(i + 1) % len(texts)][: len(texts[i]) // 2]) for i in range(len(texts))], "doc_id long, text string")
    keys += [int(r[0]) & (2**64 - 1) for r in edits.select(F.explode(fingerprint.digests(F.col("text")))).distinct().collect()]
    signed = spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k,) for k in set(keys)], "k long")
    for i, size in enumerate(fingerprint.PLACES):
        for r in signed.select("k", F.array(*(fingerprint._place(F.col("k"), j, size // 3, i) for j in range(3))).alias("p")).collect():
            _places[r["k"] & (2**64 - 1), size] = r["p"]
    alike = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    sets = [inverted(r["fingerprint"])[1] for r in got]
    for i, r in enumerate(got):
        assert abs(r["near_edited"] - alike(sets[i], inverted(r["edited_fingerprint"])[1])) < 1e-12
        assert abs(r["near_next"] - alike(sets[i], sets[(i + 1) % len(sets)])) < 1e-12


def test_fingerprints_meet_the_next_document_whatever_the_ids(spark):
    rng = random.Random(4)
    ids = [1, 9_200_000_000_000_000_000, -(1 << 63), 10**15, *range(100, 400)]
    rows = [(i, f"text {i} " + "y" * rng.randint(0, 40)) for i in ids] + [(None, "none")] + [(7, "same")] * 400
    x = spark.createDataFrame(rows, "doc_id long, t string").repartition(5).selectExpr("doc_id", "t", "array(xxhash64(t)) as keys")
    got = fingerprint.with_next(x, rows=20).collect()
    assert len(got) == len(rows)
    after = {(r["doc_id"], r["t"], r["next"]["t"]) for r in got}
    order = sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]))
    least = [r for r in order if r[0] is None or r[0] == -(1 << 63)]
    for a, b in zip(order[2:], order[3:], strict=False):
        assert (*a, b[1]) in after
    assert (7, "same", "same") in after and sum(r["next"]["t"] == "same" for r in got) == 400
    assert any((*order[-1], x[1]) in after for x in least)


def test_preference_prompt_is_the_common_prefix(spark):
    turns = lambda p, *x: [(p, i, r, t) for i, (r, t) in enumerate(x)]
    chosen = turns(1, ("user", "hi"), ("assistant", "hello"), ("user", "why"), ("assistant", "because")) + turns(2, ("user", "q"), ("assistant", None))
    rejected = turns(1, ("user", "hi"), ("assistant", "hello"), ("user", "why"), ("assistant", "no")) + turns(2, ("user", "q"), ("assistant", None)) + turns(3, (None, "only"))
    schema = "pair_id long, turn long, role string, text string"
    got = {r["pair_id"]: r for r in preference.pair_up(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert got[1]["n_prompt"] == 3 and got[1]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nwhy<|end|>\n"
    assert got[1]["chosen"] == "<|assistant|>\nbecause<|end|>\n" and got[1]["chosen_mask"] == "0-14:0,14-29:1"
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt"] == 2
    assert got[3]["prompt"] == "" and got[3]["rejected"].startswith("<|unknown|>")


def test_budgets_stay_among_siblings_first(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "c", 100), ("d1", "en", "e", 1000)]
    how = mixing.Mix(share=0.3, max_epochs=1, domains={"d0": 1, "d1": 1}, langs={})
    got = {(r["domain"], r["source"]): r["budget"] for r in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), how).collect()}
    # 363 tokens: 181 a domain; in d0 90 a language; b gives 10, so a takes 80
    assert got == {("d0", "a"): 80, ("d0", "b"): 10, ("d0", "c"): 90, ("d1", "e"): 181}


def test_mixture_takes_prefixes_and_whole_epochs(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else None, f"s{i % 4}") for i in range(300)] + [(None, "null id here", "en", None), (1, None, "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    how = mixing.Mix(share=0.6, sources={"s0": 9})
    got = mixing.mixed_ids(df, how).collect()
    held = {}
    for r in got:
        held.setdefault((r["domain"], r["lang"], r["source"]), 0)
        held[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
    leaves = mixing.labelled(df).where("__tokens > 0").groupBy("__domain", "__lang", "__source").agg({"__tokens": "sum"}).toDF("domain", "lang", "source", "tokens")
    for b in mixing.budgets(leaves, how).collect():
        assert 0 <= b["budget"] - held.get((b["domain"], b["lang"], b["source"]), 0) <= 7
    again = mixing.select(df, how)
    assert again.columns == df.columns and again.count() == len(got)
    assert mixing.select(df.where("false")).count() == 0


def test_pipeline_runs_and_keeps_only_what_its_stages_keep(spark):
    import corpus_pipeline
    from siftspark.llm import compression_rules

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a = corpus_pipeline.drop_toxic(spark, docs, str(DATA)).cache()
    b = corpus_pipeline.quality_rules(spark, a, str(DATA)).cache()
    want = {r["doc_id"] for r in compression_rules.measure(a).where("kept").collect()}
    assert {r["doc_id"] for r in b.collect()} == want and b.columns == docs.columns
    c = corpus_pipeline.near_duplicates(spark, b, str(DATA)).cache()
    brute = near_brute([(r["doc_id"], r["text"]) for r in b.collect()])
    assert sorted(r["doc_id"] for r in c.collect()) == sorted({k for _, n, k in brute if n})
    assert corpus_pipeline.mix(spark, c, str(DATA)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(DATA)).where("not round_trip").count() == 0
