"""Document fingerprints: invertible Bloom lookup sketches over hashed paragraph cells.

A paragraph is a line; long ones go in cells of ``cell`` code points, counted from the line's start. A text is the set of its
cells' 64-bit digests. The set is dealt into groups by the digests' leading bits, 2 ** b of them, so that a group has at most about
GROUP digests; each group has a sketch of m places in three parts. A digest falls in one place of every part and adds to a count,
the xor of digests and the xor of their checks. A group is sketched at the first size of PLACES at which it peels: places that hold
one digest are taken out until none is full. The fingerprint is b and the groups' sketches, so it can be inverted.

Fingerprints of two versions are compared at the larger of their b; one with fewer groups is inverted and dealt anew. In each
group that either has, sketches of the first size subtract place by place, and what the versions share is gone; peeling tells which
digests either side has alone. If places stay full, both are sketched at the next size, and so on; at the last one the inverted groups
are compared themselves. Likeness is computed from what was peeled. It follows from the two fingerprints alone (a test computes it
from their text); the query takes the digests it has just sketched and not those that inversion would give back, which are the same.

All of it is DataFrame functions over arrays of a row. Texts are shuffled once, by ranges of (doc_id, hash of the text, row), so that
a document meets the next one; a range ends with the first document of the range after it. Ranges are cut at quantiles of a sample of
these keys: the sample decides the sizes of ranges only, and every row is in one.

Defined results: a null text is empty; an empty text has no cells. Likeness is shared over all distinct cells, 1 for two sets
without cells. Order is by doc_id, null as the least id, ties by a hash of the text; the last document is followed by the first, a
single one by itself. Any long is a doc_id. Repeated rows follow each other. Equal texts have equal fingerprints. Other columns aren't
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.llm.sampling import least_hashed

CELL = 128
PLACES = (24, 96, 384)
GROUP = 8
ROUNDS = 12
#: rows of a range, and the most ranges: cuts are literals of the plan, three longs each
RANGE_ROWS = 512
RANGES = 1 << 16


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column, cell: int = CELL) -> Column:
    """Sorted distinct digests of a text's paragraph cells."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{cell}}})"), F.lit(1)), lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 32)


def _place(k: Column, j: int, part: int, salt: int) -> Column:
    """The place of a digest in the j-th part."""
    return (F.lit(j * part) + F.pmod(F.xxhash64(k, F.lit(salt), F.lit(j)), F.lit(part))).cast("int")


def _entries(keys: Column, sign: Column | int, places: int, salt: int) -> Column:
    """What each digest adds, at its place in each of the three parts."""
    part = places // 3
    sign = F.lit(sign) if isinstance(sign, int) else sign

    def one(k: Column) -> Column:
        return F.array(*(F.struct(_place(k, j, part, salt).alias("c"), sign.cast("int").alias("n"), k.alias("k"), _check(k).alias("h")) for j in range(3)))

    return F.flatten(F.transform(keys, one))


def _add(place: Column, more: Column) -> Column:
    return F.aggregate(more, place, lambda a, e: F.struct(a["c"].alias("c"), (a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["h"].bitwiseXOR(e["h"]).alias("h")))


def _full(x: Column) -> Column:
    return (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0)


def sketch(keys: Column, places: int, salt: int, sign: int = 1) -> Column:
    """Full places of a sketch, in order: array of (c place, n count, k xor of digests, h xor of checks)."""
    none = lambda c: F.struct(c.alias("c"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    return let(_entries(keys, sign, places, salt), lambda all_: F.transform(F.array_sort(F.array_distinct(F.transform(all_, lambda e: e["c"]))), lambda c: _add(none(c), F.filter(all_, lambda e: e["c"] == c))))


def text_of(places: Column) -> Column:
    """A sketch as text: ``place.count.digests.checks``, hexadecimal."""
    return F.array_join(F.transform(places, lambda x: F.concat_ws(".", F.hex(x["c"]), F.hex(x["n"]), F.hex(x["k"]), F.hex(x["h"]))), "-")


def subtract(left: Column, right: Column) -> Column:
    """Places of ``left`` less those of ``right``; equal contents leave nothing."""
    less = lambda e: F.struct(e["c"].alias("c"), (-e["n"]).alias("n"), e["k"].alias("k"), e["h"].alias("h"))

    def of(x: Column) -> Column:
        alone = F.transform(F.filter(x["b"], lambda e: ~F.exists(x["a"], lambda y: y["c"] == e["c"])), less)
        met = F.transform(x["a"], lambda y: _add(y, F.transform(F.filter(x["b"], lambda e: e["c"] == y["c"]), less)))
        return F.filter(F.concat(met, alone), _full)

    return let(F.struct(left.alias("a"), right.alias("b")), of)


def peel(places: Column, size: int, salt: int) -> Column:
    """(rest, found): places that stay full, and digests taken out as (k, n), n 1 for the left side and -1 for the right."""
    start = F.struct(places.alias("rest"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"))

    def once(state: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(state["rest"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"]))), lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n"))))

        def take(p: Column) -> Column:
            part = size // 3
            out = F.flatten(F.transform(p, lambda q: F.array(*(F.struct(_place(q["k"], j, part, salt).alias("c"), (-q["n"]).alias("n"), q["k"].alias("k"), _check(q["k"]).alias("h")) for j in range(3)))))
            rest = let(out, lambda o: F.filter(F.transform(state["rest"], lambda x: _add(x, F.filter(o, lambda e: e["c"] == x["c"]))), _full))
            return F.struct(rest.alias("rest"), F.concat(state["found"], p).alias("found"))

        return let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(take(p)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(F.size(s["rest"]) == 0, s).otherwise(once(s)))


def bits_of(keys: Column) -> Column:
    """b: the leading bits that deal a set into groups of GROUP / 2 to GROUP digests on average."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(keys), F.lit(1)) / F.lit(float(GROUP))))).cast("int")


def _group(key: Column, bits: Column) -> Column:
    # a shift by 64 - b, in two steps as Java takes shifts modulo 64
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.shiftrightunsigned(key, 1), F.lit(63) - bits))


def _dealt(entries: Column, group: Callable[[Column], Column]) -> Column:
    """Entries that are in the order of their groups, cut into arrays of one group."""

    def cut(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (group(F.get(x, i)) != group(F.get(x, i - 1))))
        return let(at, lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(x))), lambda i, j: F.slice(x, i + 1, j - i)))

    return let(entries, lambda x: F.when(F.size(x) == 0, F.slice(F.array(x), 1, 0)).otherwise(cut(x)))


def _unsigned(keys: Column) -> Column:
    """Digests in the order of their bits; leading bits then come in order as well."""
    return F.concat(F.filter(keys, lambda k: k >= 0), F.filter(keys, lambda k: k < 0))


def _unless(name: str, i: int, step: Callable[[Column, int], Column]) -> Callable[[Column], Column]:
    """The i-th step for groups whose field ``name`` isn't known yet."""
    return lambda g: F.when(g[name].isNotNull(), g).otherwise(step(g, i))


def with_fingerprint(rows: DataFrame, keys: str, into: str) -> DataFrame:
    """A column of sorted distinct digests as text: b, then ``group:size/places`` for each group that has digests."""

    def written(g: Column, i: int) -> Column:
        done = lambda x: F.struct(g["x"].alias("x"), F.concat(F.lit(f"{PLACES[i]}/"), text_of(x)).alias("s"))
        if i + 1 == len(PLACES):
            return done(sketch(g["x"], PLACES[i], i))
        return let(sketch(g["x"], PLACES[i], i), lambda x: F.when(F.size(peel(x, PLACES[i], i)["rest"]) == 0, done(x)).otherwise(g))

    x = rows.withColumn("bits", bits_of(F.col(keys)))
    groups = _dealt(_unsigned(F.col(keys)), lambda k: _group(k, F.col("bits")))
    x = x.withColumn("groups", F.transform(groups, lambda g: F.struct(g.alias("x"), F.lit(None).cast("string").alias("s"))))
    for i in range(len(PLACES)):
        x = x.withColumn("groups", F.transform("groups", _unless("s", i, written)))
    named = F.transform("groups", lambda g: F.concat(F.hex(_group(F.get(g["x"], F.lit(0)), F.col("bits"))), F.lit(":"), g["s"]))
    return x.withColumn(into, F.concat(F.col("bits").cast("string"), F.lit("|"), F.array_join(named, ";"))).drop("groups", "bits")


def _try(g: Column, i: int) -> Column:
    """A group (x, y, l, r) with l and r, the digests either side has alone, known from sketches of the i-th size; l stays
    null where they don't peel."""
    got = peel(subtract(sketch(g["x"], PLACES[i], i), sketch(g["y"], PLACES[i], i)), PLACES[i], i)
    count = lambda x, n: F.size(F.filter(x["found"], lambda q: q["n"] == n))
    return let(got, lambda x: F.struct(g["x"].alias("x"), g["y"].alias("y"), F.when(F.size(x["rest"]) == 0, count(x, 1)).alias("l"), count(x, -1).alias("r")))


def with_likeness(rows: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """Shared over all digests of two columns of sorted distinct digests, from the peeled difference of their fingerprints."""
    tagged = lambda keys, sign: F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))
    both = F.array_sort(F.concat(tagged(F.col(a), 1), tagged(F.col(b), -1)))
    x = rows.withColumn("bits", F.greatest(bits_of(F.col(a)), bits_of(F.col(b)))).withColumn("groups", both)
    in_order = F.concat(F.filter("groups", lambda e: e["k"] >= 0), F.filter("groups", lambda e: e["k"] < 0))
    side = lambda g, sign: F.transform(F.filter(g, lambda e: e["s"] == sign), lambda e: e["k"])
    none = F.lit(None).cast("int")
    x = x.withColumn("groups", F.transform(_dealt(in_order, lambda e: _group(e["k"], F.col("bits"))), lambda g: F.struct(side(g, 1).alias("x"), side(g, -1).alias("y"), none.alias("l"), none.alias("r"))))
    for i in range(len(PLACES)):
        x = x.withColumn("groups", F.transform("groups", _unless("l", i, _try)))
    lost = lambda g, one, other: F.size(F.array_except(g[one], g[other]))
    alone = lambda g: F.struct(F.coalesce(g["l"], lost(g, "x", "y")).alias("l"), F.coalesce(g["r"], lost(g, "y", "x")).alias("r"))
    x = x.withColumn("alone", F.aggregate("groups", F.struct(F.lit(0).alias("l"), F.lit(0).alias("r")), lambda t, g: let(alone(g), lambda n: F.struct((t["l"] + n["l"]).alias("l"), (t["r"] + n["r"]).alias("r")))))
    shared = (F.size(a) - F.col("alone.l")) / (F.size(a) + F.col("alone.r")).cast("double")
    return x.withColumn(into, F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared)).drop("groups", "bits", "alone")


_LEAST = -(1 << 63)


def _ranged(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` with ``range``, ascending with (k, h, r): doc_id, hash of the text, row."""
    keyed = docs.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("h", F.xxhash64("t")).withColumn("r", F.monotonically_increasing_id())
    total = docs.count()
    ranges = min(RANGES, max(1, total // rows))
    if ranges == 1:
        return keyed.withColumn("range", F.lit(0))
    packed = keyed.select(F.xxhash64("k", "h", "r").alias("mixed"), "r")
    chosen = [r for _, r in least_hashed(packed, F.col("mixed"), "r", 4 * ranges, total)]
    sample = keyed.join(F.broadcast(docs.sparkSession.createDataFrame([(r,) for r in chosen], "r long")), "r").select("k", "h", "r").collect()
    sample = sorted((x["k"], x["h"], x["r"]) for x in sample)
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)]
    cut = [F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in range(3)]
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def after(at: Column, step: Column) -> Column:
        """Step on where the cut before the place stepped to isn't beyond the row."""
        i = (at + step - 1).cast("int")
        k, h, r = (F.get(c, i) for c in cut)
        below = (k < F.col("k")) | ((k == F.col("k")) & ((h < F.col("h")) | ((h == F.col("h")) & (r <= F.col("r")))))
        return at + F.when(F.coalesce(below, F.lit(False)), step).otherwise(0)

    return keyed.withColumn("range", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), after))


def with_next(docs: DataFrame, cell: int = CELL, rows: int = RANGE_ROWS) -> DataFrame:
    """``docs(doc_id, t, keys)`` with ``next`` (t, keys) of the document that follows, by ranges of about ``rows`` rows."""
    ranged = _ranged(docs, rows)
    # at most RANGES narrow rows: the first key of each range and the range that takes its text
    heads = ranged.groupBy("range").agg(F.min(F.struct("k", "h")).alias("x"))
    before = W.orderBy("range")
    heads = heads.select(F.col("x.k").alias("k"), F.col("x.h").alias("h"), F.coalesce(F.lag("range").over(before), F.max("range").over(W.partitionBy())).alias("to"))
    first = ranged.select("k", "h", "t").join(F.broadcast(heads), ["k", "h"]).groupBy("to").agg(F.min("t").alias("t"))
    none = F.lit(None).cast("long")
    guests = first.select(none.alias("doc_id"), "t", digests(F.col("t"), cell).alias("keys"), none.alias("k"), none.alias("h"), none.alias("r"), F.col("to").alias("range"), F.lit(True).alias("guest"))
    held = ranged.select("doc_id", "t", "keys", "k", "h", "r", "range", F.lit(False).alias("guest")).unionByName(guests)
    by = W.partitionBy("range").orderBy("guest", "k", "h", "r")
    return held.withColumn("next", F.lead(F.struct("t", "keys")).over(by)).where("not guest").select("doc_id", "t", "keys", "next")


def compare_with_edits(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """The fingerprint of each text and of its edited text, and their likeness; see the module."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")).withColumn("keys", digests(F.col("t"), cell))
    x = with_next(own, cell).withColumn("n_chars", F.length("t").cast("long")).withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    edited = F.concat(F.expr("substring(t, 1, cast(n_chars as int) - half)"), F.expr("substring(next.t, 1, half)"))
    x = x.select("doc_id", "n_chars", "keys", F.col("next.keys").alias("next_keys"), edited.alias("e"))
    x = x.select("doc_id", "n_chars", "keys", "next_keys", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), digests(F.col("e"), cell).alias("edited_keys"))
    x = with_fingerprint(with_fingerprint(x, "keys", "fingerprint"), "edited_keys", "edited_fingerprint")
    x = with_likeness(with_likeness(x, "keys", "edited_keys", "near_edited"), "keys", "next_keys", "near_next")
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
