"""Sharding by a k-d tree over metadata, with leaves of nearly equal bytes.

A node that stands for k of the n shards is split across its widest metadata dimension (size, language, source, id; each scaled to
the same range over all rows) into k // 2 shards and the rest, at the median weighted by bytes, or at the quantile of that share where k is
odd, until a node stands for one shard. A dimension's order goes on with the text's checksum, then the id, then the row, so a
cut can fall inside a group of ties of any size; equal texts stay together unless the cut falls among them.

Cuts are exact and distributed: between two rows, where the bytes before are nearest to the share. The order is a number of 128 bits,
read 12 bits at a time until one row is left (rows that agree in all 128 bits stay together). Each pass sums bytes by (node, digit) in
the scan's partitions before a shuffle of those sums; all nodes of a level share a pass, and at most nodes x 4096 sums reach the
driver. Texts are scanned once, to a narrow table of sizes and checksums.

Slots are gapless: rows are dealt to buckets by a hash of the row, a shard's buckets begin where the ones before end, and only the
inside of a bucket is sorted, so a shard is never in one task.

The number of shards is given, or follows from the bytes that a leaf may have. A tree of more than LEAVES shards is grown in tiers: its upper part until each node
stands for LEAVES shards at most, then the rows are written with their node, and each node's own tree is grown over its rows alone and written. So
neither an expression nor what reaches the driver at once grows with the number of shards.

Defined results: a null text has size 1 and the checksum of the empty text. Null labels are a value of their own; null ids
come first. Repeated rows get slots of their own. Fewer rows than shards leave shards empty. An empty table gives an empty result.
Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftspark.store import materialize

DIMS = ("size", "lang", "source", "id")
_BITS, _DIGIT = 31, 12
#: shards of one tree; beyond, trees stand below a tree
LEAVES = 256


@dataclass
class Node:
    name: int
    bytes_: int
    rows: int
    #: how many shards it stands for
    shards: int = 1
    dim: int = 0
    #: rows with (high, low) of the node's order up to these go left
    cut: tuple[int, int] | None = None
    left: Node | None = None
    right: Node | None = None


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, d0..d3, low): what the tree sees of each row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    label = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)).cast("double")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), label("lang").alias("d1"), label("source").alias("d2"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d3"), F.monotonically_increasing_id().alias("row"))
    return x.withColumn("d0", F.log2(F.col("size").cast("double")))


def _scaled(narrow: DataFrame) -> tuple[DataFrame, int, int]:
    """Dimensions scaled to 31 bits; ``k0..k3`` hold the dimension and the checksum, ``low`` the id and the row."""
    ends = narrow.agg(*(f(f"d{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("a", F.min), ("z", F.max))), F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not ends["rows"]:
        return narrow, 0, 0
    unit = lambda i: F.floor((F.col(f"d{i}") - ends[f"a{i}"]) / F.lit(max(ends[f"z{i}"] - ends[f"a{i}"], 1e-12)) * (2**_BITS - 1)).cast("long")
    q = [F.least(unit(i), F.lit(2**_BITS - 1)) for i in range(4)]
    x = narrow.select("doc_id", "size", "text_crc32", "row", *(F.shiftleft(q[i], 32).bitwiseOR(F.col("text_crc32")).alias(f"k{i}") for i in range(4)), F.shiftleft(q[3], 32).bitwiseOR(F.xxhash64("row").bitwiseAND(F.lit(2**32 - 1))).alias("low"))
    return x, int(ends["bytes"]), int(ends["rows"])


def _left(node: Node) -> Column:
    high, low = node.cut
    k = F.col(f"k{node.dim}")
    return (k < high) | ((k == high) & (F.col("low") <= low))


def _walk(node: Node, value) -> Column:
    if node.cut is None:
        return F.lit(value(node))
    return F.when(_left(node), _walk(node.left, value)).otherwise(_walk(node.right, value))


def _medians(rows: DataFrame, nodes: list[Node]) -> None:
    """Set the cut of each node: the end of a prefix of its order with nearly its left shards' part of the bytes."""
    pick = lambda f: F.coalesce(*(F.when(F.col("node") == n.name, f(n)) for n in nodes))
    rows = rows.withColumn("high", pick(lambda n: F.col(f"k{n.dim}")))
    before = {n.name: 0 for n in nodes}
    prefix = {n.name: [0, 0] for n in nodes}  # the digits so far of high and low
    open_ = {n.name: n for n in nodes}
    for level in range(12):
        part, step = divmod(level, 6)
        shift = 60 - _DIGIT * step
        col = F.col("high" if part == 0 else "low")
        keep = None
        for n in open_.values():
            hi, lo = prefix[n.name]
            if part == 0:
                same = F.shiftright("high", shift + _DIGIT) == hi if step else F.lit(True)
            else:
                same = (F.col("high") == hi) & (F.shiftright("low", shift + _DIGIT) == lo if step else F.lit(True))
            mine = (F.col("node") == n.name) & same
            keep = mine if keep is None else keep | mine
        digit = F.shiftright(col, shift).bitwiseAND(F.lit(2**_DIGIT - 1))
        sums = rows.where(keep).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
        for name, n in list(open_.items()):
            mine = sorted((r["digit"], r["w"], r["n"]) for r in sums if r["node"] == name)
            half, at = n.bytes_ * (n.shards // 2) / n.shards, before[name]
            for digit_, w, count in mine:
                if at + w >= half:
                    break
                at += w
            before[name] = at
            prefix[name][part] = (prefix[name][part] << _DIGIT) | digit_
            if count == 1 or level == 11:  # the cut is before or after this last row, whichever is nearer; no side is empty
                take = at == 0 or (at + w - half <= half - at and at + w < n.bytes_)
                hi, lo = prefix[name]
                if part == 0:
                    end = ((hi + 1) << shift) - 1 if take else (hi << shift) - 1
                    n.cut = (end, 2**63 - 1)
                else:
                    n.cut = (hi, ((lo + 1) << shift) - 1 if take else (lo << shift) - 1)
                del open_[name]
        if not open_:
            return


def grow(rows: DataFrame, total: int, count: int, n: int, most: int = 1) -> Node:
    """The tree over described and scaled rows, until nodes stand for ``most`` shards."""
    root = Node(1, total, count, n)
    leaves = [root]
    while big := [x for x in leaves if x.shards > most and x.rows > 1]:
        placed = rows.withColumn("node", _walk(root, lambda x: x.name)) if root.cut else rows.withColumn("node", F.lit(1))
        wide = placed.groupBy("node").agg(*(f(F.shiftright(f"k{i}", 32)).alias(f"{end}{i}") for i in range(4) for end, f in (("a", F.min), ("z", F.max)))).collect()
        spread = {r["node"]: [r[f"z{i}"] - r[f"a{i}"] for i in range(4)] for r in wide}
        for x in big:
            x.dim = max(range(4), key=lambda i: (spread[x.name][i], -i))
        _medians(placed, big)
        for x in big:
            x.left, x.right = Node(2 * x.name, 0, 0, x.shards // 2), Node(2 * x.name + 1, 0, 0, x.shards - x.shards // 2)
        held = rows.withColumn("node", _walk(root, lambda x: x.name)).groupBy("node").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()
        of = {r["node"]: (r["w"], r["n"]) for r in held}
        leaves = [c for x in big for c in (x.left, x.right)]
        for c in leaves:
            c.bytes_, c.rows = of.get(c.name, (0, 0))
    return root


def _number(node: Node, at: int = 0) -> dict[int, int]:
    if node.cut is None:
        return {node.name: at}
    return _number(node.left, at) | _number(node.right, at + node.left.shards)


def _ends(node: Node) -> list[Node]:
    return [node] if node.cut is None else _ends(node.left) + _ends(node.right)


def _sharded(rows: DataFrame, total: int, count: int, n: int, most: int) -> DataFrame:
    """Rows with their ``shard``; see LEAVES."""
    root = grow(rows, total, count, n, 1 if n <= most else most)
    number = _number(root)
    if n <= most:
        return rows.withColumn("shard", _walk(root, lambda x: number[x.name]))
    tiers = materialize(rows.withColumn("node", _walk(root, lambda x: x.name)).repartition("node"), "shard-nodes")
    parts = []
    for node in _ends(root):
        if node.rows:
            own = tiers.where(F.col("node") == node.name).drop("node")
            parts.append(materialize(_sharded(own, node.bytes_, node.rows, node.shards, most).withColumn("shard", F.col("shard") + number[node.name]), "shard-part"))
    return reduce(DataFrame.unionByName, parts)


def shards(docs: DataFrame, n: int = 8, bucket_rows: int = 20_000, target_bytes: int | None = None, leaves: int = LEAVES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for rows (doc_id, text, lang, source): shards 0 to n - 1 of
    nearly equal bytes, as far as rows can be parted. ``target_bytes``: as many shards as leave none above these bytes on average, in place of ``n``."""
    rows, total, count = _scaled(materialize(describe(docs), "shard-rows"))
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    buckets = count // bucket_rows + 1
    placed = _sharded(rows, total, count, n if target_bytes is None else max(1, -(-total // target_bytes)), leaves).withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(buckets)).cast("int"))
    held = placed.groupBy("shard", "bucket").agg(F.count("*").alias("k"))
    starts = held.withColumn("start", F.sum("k").over(W.partitionBy("shard").orderBy("bucket")) - F.col("k")).drop("k")
    slot = F.col("start") + F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    return placed.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
