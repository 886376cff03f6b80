"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct five-word shingles. Two documents link when 100 * |A and B| >= 80 * |A or B|.

1. Texts are taken in blocks of a million shingles, in the scan's partitions. Equal sets are one *class*, named by a 64-bit hash of
   the set; a class is a two-byte number in each block that has it, and one block's is searched for all.
2. Lengths of the inverted lists. A block's shingle hashes are sorted, and those of a hash range travel together as differences of
   six bytes with the class's number: eight bytes a posting, however many ranges there are. A shingle that several classes of a block
   have sends one posting with their count, so a shingle of a third of all texts weighs a posting a block. Ranges add the counts up,
   and send the length of each list back to the blocks on it. A shingle of one class in one block can't be shared and goes no further.
3. A class of n shingles needs T = ceil(0.8 n) of them in any partner, whatever the partner's size. With fewer than T shared
   shingles it has no partner. The rest keep their shared shingles, shortest list first; all lists but the last T - 1 are
   *short*: a partner is on at least one.
4. Classes that meet on short lists form blocks (connected components over one edge for each posting, to the list's smallest
   class). Linked classes are always in one block.
5. In a block: DivideSkip. For each class the short lists are merged by a heap, classes seen at least T - L times are
   candidates, and the L long lists are binary-probed for these only. The counts are exact overlaps.
6. A block beyond the bounds (one large group of copies) is first thinned: each class is held against the smallest class
   of its short lists, which joins nearly all of a tight group at linear cost. Classes on a short list whose classes are
   still in several parts then meet in chunks, chunk against chunk, by the same DivideSkip; pairs within a part are skipped,
   as they are connected already. No link between parts can be missed, and no task holds more than two chunks.

Results are whole: no list, bucket or partner is capped. Links and components stay distributed.

A posting is eight bytes at every size, but a block and a range meet in a row of its own: n shingles make (n / 2e6) * (n / 4e6) rows at
most, few against n up to some 1e13.

Defined results: a null or wordless text has no shingles, links with nothing and is its own component; a text of one to four
words is one shingle. Repeated texts share a component. A null doc_id keeps its row, and is left out when the smallest id of
a component is sought. Other columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm import kernel
from siftspark.llm.graph import components
from siftspark.llm.joins import skew_join, unused
from siftspark.store import discard, materialize


@dataclass(frozen=True)
class Join:
    width: int = 5
    numerator: int = 80
    denominator: int = 100
    #: shingles in one block of texts, and in one range of hashes; a worker takes some 60 bytes a shingle of either, and fewer and larger
    #: ones make fewer rows of more postings, so executors with more memory should have larger ones
    block_tokens: int = 1_000_000
    part_tokens: int = 2_000_000
    #: a block with more classes or shingles is thinned and cut into chunks
    block_classes: int = 1000
    block_size: int = 2_000_000


def _set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _text_id() -> list[Column]:
    """A text's name: 96 bits of hashes."""
    return [F.xxhash64("text").alias("text_id"), F.hash("text").alias("text_id2")]


#: range -1 - x stands for what goes past the ranges to block x's own place: the texts of a block and its repeated shingles
_PACKED = "part int, block long, kind byte, width int, low binary, ords binary, counts binary"
_TEXTS, _HELD, _POSTS = 0, 1, 2
_MANY = 0xFFFF


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def part_start(part: int, parts: int) -> int:
    """The least hash of a range."""
    return -(-(part << 32) // parts) << 32


def pack(tokens: np.ndarray, start: int) -> tuple[int, bytes]:
    """Ascending hashes as differences from the one before, in as few bytes as the largest takes, six at least."""
    steps = np.diff(tokens, prepend=np.uint64(start))
    most = int(steps.max()) if len(steps) else 0
    width = max(6, (most.bit_length() + 7) // 8)
    return width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(low: bytes, width: int, start: int) -> np.ndarray:
    steps = np.zeros((len(low) // width, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(start)


def _packed(texts: DataFrame, parts: int, homes: int, how: Join) -> DataFrame:
    """Blocks of texts. A block sends its postings to the ranges of their hashes, and to its home (one of ``homes`` numbers from
    -1 down) the names of its texts with their classes, sizes and numbers, and the members of each shingle that several classes have."""

    from pyspark import TaskContext

    def flush(block: int, names: dict[tuple, tuple], sets: list[np.ndarray]) -> Iterator[tuple]:
        home = -1 - block % homes
        table = np.array([(*name, *found) for name, found in names.items()], dtype=np.int64)
        yield home, block, _TEXTS, 0, table.tobytes(), b"", b""
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        del by
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        times = np.diff(np.append(head, len(tokens)))
        many = times > 1
        if many.any():
            members = owner[np.repeat(many, times)]
            yield home, block, _HELD, 8, tokens[head[many]].tobytes(), members.tobytes(), times[many].astype(np.int32).tobytes()
        ords = np.where(many, _MANY, owner[head]).astype(np.uint16)
        tokens = tokens[head]
        cuts = np.searchsorted(part_of(tokens, parts), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            at = slice(cuts[p], cuts[p + 1])
            width, low = pack(tokens[at], part_start(p, parts))
            yield p, block, _POSTS, width, low, ords[at].tobytes(), times[at][many[at]].astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[int, int], tuple[int, int, int]] = {}  # name of a text to class, size and number in the block
        classes: dict[int, int] = {}
        sets: list[np.ndarray] = []
        total, block = 0, TaskContext.get().partitionId() << 32

        def emit() -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            weight = 0
            for row in flush(block, names, sets) if names else ():
                held.append(row)
                weight += len(row[4])
                if len(held) >= 256 or weight > 1 << 22:
                    yield _batch(held)
                    held, weight = [], 0
            if held:
                yield _batch(held)
            names.clear()
            classes.clear()
            sets.clear()

        for batch in batches:
            for t, u, x in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                if (t, u) in names:
                    continue
                s = kernel.shingles(_bytes(x.as_py()), how.width)
                if not len(s):
                    continue
                own = _set_id(s)
                if own not in classes:
                    classes[own] = len(sets)
                    sets.append(s)
                    total += len(s)
                names[t, u] = (own, len(s), classes[own])
                if total >= how.block_tokens or len(sets) >= _MANY:
                    yield from emit()
                    total, block = 0, block + 1
        yield from emit()

    return texts.select("text_id", "text_id2", "text").mapInArrow(run, _PACKED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "block", "kind", "width", "low", "ords", "counts"])


_LISTS = "block long, kind byte, tokens binary, ords binary, lengths binary"


def _lists(packed: DataFrame, parts: int, homes: int) -> DataFrame:
    """For each block: its texts, its repeated shingles, and of each range the shared shingles with the lengths of their lists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        if part < 0:
            return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "tokens": pdf["low"], "ords": pdf["ords"], "lengths": pdf["counts"]})
        start = part_start(part, parts)
        blocks = pdf["block"].to_numpy()
        cuts = np.concatenate([[0], np.cumsum([len(x) // k for x, k in zip(pdf["low"], pdf["width"], strict=True)])])
        tokens = np.empty(cuts[-1], dtype=np.uint64)
        ords = np.empty(cuts[-1], dtype=np.uint16)
        weight = np.ones(cuts[-1], dtype=np.int32)
        for i, (low, width, own, counts) in enumerate(zip(pdf["low"], pdf["width"], pdf["ords"], pdf["counts"], strict=True)):
            at = slice(cuts[i], cuts[i + 1])
            tokens[at], ords[at] = unpack(low, width, start), np.frombuffer(own, np.uint16)
            if counts:
                weight[at][ords[at] == _MANY] = np.frombuffer(counts, np.int32)
        by = np.argsort(tokens, kind="stable").astype(np.int32)
        sorted_ = tokens[by]
        head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        del sorted_
        total = np.minimum(np.add.reduceat(weight[by], head, dtype=np.int64), 2**31 - 1).astype(np.int32)
        length = weight  # of the list of each posting, in the order of the rows
        length[by] = np.repeat(total, np.diff(np.append(head, len(by))))
        del by, head, total
        out = []
        for i in range(len(blocks)):
            at = slice(cuts[i], cuts[i + 1])
            live = length[at] > 1
            if live.any():
                out.append((int(blocks[i]), _POSTS, tokens[at][live].tobytes(), ords[at][live].tobytes(), length[at][live].tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "tokens", "ords", "lengths"])

    return packed.repartition(parts + homes, "part").groupBy("part").applyInPandas(run, _LISTS)


def _members(lists: DataFrame) -> DataFrame:
    """(block, ord, text_id, text_id2, class, n_shingles) of each text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64).reshape(-1, 5)
                for i in range(0, len(x), 10_000):
                    y = x[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), block)), pa.array(y[:, 4].astype(np.int32)), pa.array(y[:, 0]), pa.array(y[:, 1].astype(np.int32)), pa.array(y[:, 2]), pa.array(y[:, 3])], names=["block", "ord", "text_id", "text_id2", "class", "n_shingles"])

    return lists.where(F.col("kind") == _TEXTS).select("block", "tokens").mapInArrow(run, "block long, ord int, text_id long, text_id2 int, class long, n_shingles long")


def _searchable(lists: DataFrame, members: DataFrame, how: Join) -> DataFrame:
    """(class, n, tokens, short): classes with at least T shared shingles, shortest list first; ``short`` lists suffice."""

    def run(key: tuple, pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame([], columns=["class", "n", "tokens", "short"])
        posts, held = pdf[pdf["kind"] == _POSTS], pdf[pdf["kind"] == _HELD]
        if not len(posts) or not len(of):
            return empty
        tokens, ords, length = (np.frombuffer(b"".join(posts[c]), t) for c, t in (("tokens", np.uint64), ("ords", np.uint16), ("lengths", np.int32)))
        del posts
        if len(held):  # members of the block's repeated shingles, with the lengths that came back for these
            of_many = np.flatnonzero(ords == _MANY)
            of_many = of_many[np.argsort(tokens[of_many])]
            times = np.frombuffer(b"".join(held["lengths"]), np.int32)
            alone = ords != _MANY
            tokens = np.concatenate([tokens[alone], np.repeat(tokens[of_many], times)])
            length = np.concatenate([length[alone], np.repeat(length[of_many], times)])
            ords = np.concatenate([ords[alone], np.frombuffer(b"".join(held["ords"]), np.uint16)])
        names, sizes = np.zeros(_MANY + 1, np.int64), np.full(_MANY + 1, -1, np.int64)
        names[of["ord"]], sizes[of["ord"]] = of["class"], of["n_shingles"]
        least = -(-sizes * how.numerator // how.denominator)
        shared = np.bincount(ords, minlength=_MANY + 1)
        fit = (sizes >= 0) & (shared >= least)
        use = np.flatnonzero(fit[ords])
        use = use[np.lexsort((tokens[use], length[use], ords[use]))]
        alive = np.flatnonzero(fit)
        ends, sorted_ = np.cumsum(shared[alive]), tokens[use].view(np.int64)
        rows = [(int(names[i]), int(sizes[i]), sorted_[e - shared[i] : e], int(shared[i] - least[i] + 1)) for i, e in zip(alive, ends, strict=True)]
        return pd.DataFrame(rows, columns=["class", "n", "tokens", "short"]) if rows else empty

    first = members.groupBy("class").agg(F.min(F.struct("block", "ord", "n_shingles")).alias("x")).select(F.col("x.block").alias("block"), F.col("x.ord").alias("ord"), F.col("x.n_shingles").alias("n_shingles"), "class")
    return lists.where(F.col("kind") != _TEXTS).groupBy("block").cogroup(first.groupBy("block")).applyInPandas(run, "class long, n long, tokens array<long>, short int")


def heap_merge(lists: list[list[int]], least: int) -> dict[int, int]:
    """Members of at least ``least`` of the sorted lists, with their counts: a k-way merge by a heap of list heads."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out: dict[int, int] = {}
    while heap:
        at, times = heap[0][0], 0
        while heap and heap[0][0] == at:
            _, i, j = heap[0]
            times += 1
            if j + 1 < len(lists[i]):
                heapq.heapreplace(heap, (lists[i][j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
        if times >= least:
            out[at] = times
    return out


class _Parts:
    """Union by smaller index within one block."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def divide_skip(sizes: list[int], sets: list[np.ndarray], labels: list[int], how: Join, small: int = 64) -> list[tuple[int, int]]:
    """Links that connect what ``labels`` leaves apart, as (index, index); with distinct labels, links that span every
    component of the block.

    Classes are taken by size, each sought among those before it. Lists hold positions in that order. Up to ``small`` classes
    the short lists are merged by a heap and long ones probed by bisection; beyond, the merge and the probes of all
    candidates are done on arrays. There a class is also probed against the last member of the parts met last, and
    is not sought any further where all classes before it are in its part."""
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    parts, out = _Parts(labels), []
    few = len(order) <= small
    owner = np.repeat(np.arange(len(order)), [len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order]) if order else np.empty(0, np.int64)
    by = np.argsort(tokens, kind="stable")
    names, start = np.unique(tokens[by], return_index=True)
    lists = np.split(owner[by], start[1:])
    index = dict(zip(names.tolist(), [x.tolist() for x in lists] if few else lists, strict=True))
    lasts: dict[int, int] = {}  # part -> its last member so far

    def linked(i: int, j: int, common: int) -> bool:
        return how.denominator * common >= how.numerator * (sizes[i] + sizes[j] - common)

    def join(i: int, j: int) -> None:
        parts.join(i, j)
        out.append((i, j))

    for me, i in enumerate(order):
        least = -(-sizes[i] * how.numerator // how.denominator)
        if not few:
            for j in list(lasts.values())[-3:]:
                if parts.root(j) != parts.root(i) and linked(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
                    join(i, j)
        if any(parts.root(j) != parts.root(i) for j in lasts.values()) and len(sets[i]) >= least:
            found = sorted((index[t] for t in sets[i].tolist()), key=len)
            long = _long_lists([len(x) for x in found], least)
            short, probes = found[: len(found) - long], found[len(found) - long :]
            for at, times in (_sought(me, short, probes, least, long) if few else _sought_on_arrays(me, short, probes, least, long, lambda at, own=i: parts.root(order[at]) != parts.root(own))):
                if parts.root(order[at]) != parts.root(i) and linked(i, order[at], times):
                    join(i, order[at])
        fresh = {parts.root(j): j for j in lasts.values()}
        fresh.pop(parts.root(i), None)
        lasts = fresh | {parts.root(i): i}
    return out


def _long_lists(lengths: list[int], least: int) -> int:
    """How many of the longest lists are probed and not merged: more of them where they are much longer than the rest."""
    long = int(least / (0.5 * np.log2(lengths[-1] + 1) + 1))
    return min(least - 1, max(long, sum(1 for x in lengths if x > 4 * lengths[0])))


def _sought(me: int, short: list[list[int]], probes: list[list[int]], least: int, long: int) -> Iterator[tuple[int, int]]:
    """Positions before ``me`` on ``least`` lists or more, with the number of lists."""
    for at, times in heap_merge(short, max(1, least - long)).items():
        if at >= me:
            continue
        for k, x in enumerate(probes):
            if times + len(probes) - k < least:
                break
            p = bisect_left(x, at)
            times += p < len(x) and x[p] == at
        if times >= least:
            yield at, times


def _sought_on_arrays(me: int, short: list[np.ndarray], probes: list[np.ndarray], least: int, long: int, wanted) -> Iterator[tuple[int, int]]:
    at, times = np.unique(np.concatenate(short), return_counts=True)
    use = (at < me) & (times >= max(1, least - long))
    at, times = at[use], times[use]
    use = np.fromiter(map(wanted, at.tolist()), bool, len(at))
    at, times = at[use], times[use]
    for k, x in enumerate(probes):
        use = times + (len(probes) - k) >= least
        if not use.all():
            at, times = at[use], times[use]
        if not len(at):
            return
        p = np.minimum(np.searchsorted(x, at), len(x) - 1)
        times = times + (x[p] == at)
    yield from ((a, t) for a, t in zip(at.tolist(), times.tolist(), strict=True) if t >= least)


def _search(blocks: DataFrame, tasks: int, how: Join) -> DataFrame:
    """(a, b): links found in each block; several blocks share a task. ``blocks(block, task, class, label, n, tokens)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, x in pdf.groupby("block", sort=False):
            if len(x) > 1:
                x = x.sort_values("class")
                names, labels = x["class"].tolist(), x["label"].tolist()
                sets = [np.asarray(t, dtype=np.int64) for t in x["tokens"]]
                if len(set(names)) < len(names):
                    first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
                    names, labels, sets = ([v[i] for i in first] for v in (names, labels, sets))
                    x = x.iloc[first]
                out += [(names[i], names[j]) for i, j in divide_skip(x["n"].tolist(), sets, labels, how)]
        return pd.DataFrame(out, columns=["a", "b"])

    return blocks.repartition(tasks, "task").groupBy("task").applyInPandas(run, "a long, b long")


def _links_of_large(big: DataFrame, edges: DataFrame, how: Join) -> tuple[DataFrame, list[DataFrame]]:
    """Links of oversized blocks; see step 6. ``big(class, block, n, tokens, short)``."""
    spark = big.sparkSession
    side = lambda x, y: big.select(F.col("class").alias(x), F.col("n").alias(f"n{y}"), F.col("tokens").alias(f"t{y}"))
    near = edges.join(side("a", 1), "a").join(side("b", 2), "b").withColumn("c", F.size(F.array_intersect("t1", "t2")))
    hub = materialize(near.where(F.col("c") * how.denominator >= how.numerator * (F.col("n1") + F.col("n2") - F.col("c"))).select("a", "b"), "hub-links")
    parts = components(hub, "hub-parts")
    labels = materialize(big.select("class", "block", F.size("tokens").alias("w")).join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("root", "class")).drop("root"), "hub-labels")
    posts = big.select("class", F.explode(F.slice("tokens", F.lit(1), F.col("short"))).alias("token")).join(labels.select("class", "label"), "class")
    mixed = posts.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    open_ = materialize(labels.join(posts.join(mixed, "token").select("class").distinct(), "class"), "hub-open")
    per = open_.groupBy("block").agg(F.count("*").alias("k"), F.sum("w").alias("w")).agg(F.max("k").alias("k"), F.count("*").alias("blocks")).first()
    if not per["blocks"]:
        return hub, [hub, parts, labels, open_]
    per = open_.groupBy("block").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
    chunks = F.greatest(F.ceil(F.col("k") / (how.block_classes // 2)), F.ceil(F.col("w") / (how.block_size // 2)), F.lit(1)).cast("int")
    dealt = open_.drop("w").join(per.select("block", chunks.alias("chunks")), "block").withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    pairs = dealt.join(big.select("class", "n", "tokens"), "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("class", "label", "n", "tokens", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    found = _search(pairs.withColumn("task", F.col("block")), int(spark.conf.get("spark.sql.shuffle.partitions")), how)
    return hub.unionByName(found), [hub, parts, labels, open_]


def _prepared(docs: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """(lists, members) of the texts of ``docs``; ``lists`` is written."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*_text_id(), "text")
    # bytes over five are words at most; only sizes of ranges follow from it
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(4, size // 5 // how.part_tokens + 1))
    homes = max(1, min(shuffles, parts))
    lists = materialize(_lists(_packed(texts, parts, homes, how), parts, homes), "lists")
    return lists, _members(lists)


def class_links(lists: DataFrame, members: DataFrame, how: Join = Join()) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links between classes that give every component, and the tables they are read from."""
    spark = lists.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    searchable = materialize(_searchable(lists, members, how), "searchable")
    posts = searchable.select("class", F.explode(F.slice("tokens", F.lit(1), F.col("short"))).alias("token"))
    heads = posts.groupBy("token").agg(F.min("class").alias("head"), F.count("*").alias("k")).where("k > 1").select("token", "head")
    edges = materialize(posts.join(heads, "token").where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")).distinct(), "edges")
    block = components(edges, "blocks")
    placed = searchable.join(block.select(F.col("node").alias("class"), F.col("root").alias("block")), "class")
    per = materialize(placed.groupBy("block").agg(F.count("*").alias("k"), F.sum(F.size("tokens")).alias("w")), "block-sizes")
    large = (F.col("k") > how.block_classes) | (F.col("w") > how.block_size)
    summary = per.agg(F.sum(F.when(large, 1).otherwise(0)).alias("large"), F.sum("w").alias("w")).first()
    tasks = int(max(shuffles, (summary["w"] or 0) // how.block_size * 2))
    small = placed.join(per.where(~large).select("block"), "block").select("block", F.pmod(F.xxhash64("block"), F.lit(tasks)).cast("int").alias("task"), "class", F.col("class").alias("label"), "n", "tokens")
    links = _search(small, tasks, how)
    kept = [searchable, edges, block, per]
    if summary["large"]:
        big = placed.join(per.where(large).select("block"), "block").select("class", "block", "n", "tokens", "short")
        of_big = edges.join(block.select(F.col("node").alias("a"), F.col("root").alias("block")), "a").join(per.where(large).select("block"), "block").select("a", "b")
        more, tables = _links_of_large(big, of_big, how)
        links, kept = links.unionByName(more), kept + tables
    return links, kept


def _rooted(docs: DataFrame, how: Join) -> DataFrame:
    """(doc_id, text_id, text_id2, n_shingles, class, root) for every row; null class and root for an empty set."""
    lists, found = _prepared(docs, how)
    members = materialize(found.select("block", "ord", "text_id", "text_id2", "class", "n_shingles"), "members")
    links, used = class_links(lists, members, how)
    root = components(links, "near")
    discard(lists, *used)
    named = members.groupBy("text_id", "text_id2").agg(F.first("class").alias("class"), F.first("n_shingles").alias("n_shingles"))
    texts = named.join(root.select(F.col("node").alias("class"), "root"), "class", "left").select("text_id", "text_id2", F.struct("n_shingles", "class", F.coalesce("root", "class").alias("root")).alias("x"))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_id()), "names")
    by_name = skew_join(rows.withColumn("name", F.struct("text_id", "text_id2")), texts.select(F.struct("text_id", "text_id2").alias("name"), "x"), "name", "x")
    return materialize(by_name.select("doc_id", "text_id", "text_id2", F.coalesce("x.n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.col("x.class").alias("class"), F.col("x.root").alias("root")), "rooted")


def near_components(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    keyed = _rooted(docs, how)
    least = keyed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"))
    return skew_join(keyed.select("doc_id", "n_shingles", "root"), least, "root", "first").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id, and of several texts with
    that doc_id in the group one of the smallest (class, name of the text). Rows that repeat its doc_id and text stay once; documents
    without words or without a doc_id stay. Other columns pass through, whatever their names."""
    names = docs.columns
    keep, text, text2 = (unused(names, x) for x in ("keep", "keep_text", "keep_text2"))
    found = _rooted(docs.select("doc_id", "text"), how).where("root is not null and doc_id is not null")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "class", "text_id", "text_id2")).alias("x")).select(F.col("x.doc_id").alias(keep), F.col("x.text_id").alias(text), F.col("x.text_id2").alias(text2))
    one, two = _text_id()
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    blank = docs.where(~wordy)
    with_words = docs.where(wordy).withColumn(text + "_own", one).withColumn(text2 + "_own", two)
    same = (F.col("doc_id") == F.col(keep)) & (F.col(text + "_own") == F.col(text)) & (F.col(text2 + "_own") == F.col(text2))
    kept = with_words.join(first, same, "left_semi").dropDuplicates(["doc_id", text + "_own", text2 + "_own"]).select(*names)
    return kept.unionByName(blank)
