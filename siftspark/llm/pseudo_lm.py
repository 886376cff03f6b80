"""Language-model scoring by masked pseudo-likelihood.

A text's tokens are its words, lower-cased and without ASCII punctuation: the commonest words of the whole corpus by id, all others
by one of a few hash buckets. A bidirectional window network predicts each token from the ``reach`` tokens on both sides, the
token itself masked: position-wise embeddings are summed, squashed, and read by a two-step softmax (a class of tokens, then the
member within it). A word of a bucket is told from the others there by a further step, log(times / (times of the bucket + 1)), whose
counts are of all words of the corpus and stay a table, joined by word; what is left of a bucket is for words never counted. Words with a
large share of the corpus (``Net.frequent``), which bounds their number at any size, are added in the scan, so that no key of the join is heavy.
A text's score is the sum of the log-probabilities of all its words.

What is learned covers the corpus: word counts are over all texts, and texts, as token ids, are dealt by hash into buckets of about
``bucket_tokens``. In each round each bucket trains a copy on every position of every text in it, in an order that follows from the
rows alone; copies are averaged, weighted by positions, up a tree of fan-in 64, so the driver gets 64 models at most, what is gathered
grows with the input, and nothing depends on how files are split. Scoring is one more pass, every token of every text.
Network, gradients and Adagrad are plain numpy. A batch's hidden layer is a sum of rows of tables (tokens x hidden), one for each side's
place, and its gradient is summed by token before it meets the embeddings; batches double from ``batch`` to ``most_batch``.

Defined results: null, empty and punctuation-only texts have no tokens, sum 0 and mean 0. Repeated rows score alike. Words that are
equally common rank by hash. A corpus without words leaves the network at its start, and an empty table gives an empty result. Other
columns pass through; those named like a result, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm import kernel
from siftspark.store import discard, materialize

_DROP = bytes(c for c in range(33, 127) if not chr(c).isalpha())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Net:
    classes: int = 32
    members: int = 32
    rare: int = 32
    reach: int = 2
    dim: int = 16
    hidden: int = 24
    rounds: int = 2
    batch: int = 512
    #: a batch doubles after so many steps, up to the largest
    steps: int = 64
    most_batch: int = 2048
    bucket_tokens: int = 2_000_000
    rate: float = 0.08
    seed: int = 5
    #: words of a bucket with a larger share of all words than this are frequent; there are at most 1 / share of them
    frequent: float = 2.0**-19

    @property
    def tokens(self) -> int:
        return self.classes * self.members


Weights = dict[str, np.ndarray]


def start(net: Net) -> Weights:
    rng = np.random.default_rng(net.seed)
    rand = lambda *s, by=0.1: (rng.standard_normal(s) * by).astype(np.float32)
    return {"e": rand(net.tokens + 1, net.dim), "p": rand(2 * net.reach, net.dim, net.hidden, by=0.3), "b": np.zeros(net.hidden, np.float32), "c": rand(net.hidden, net.classes), "cb": np.zeros(net.classes, np.float32), "m": rand(net.classes, net.hidden, net.members), "mb": np.zeros((net.classes, net.members), np.float32)}


def _clean(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _DROP)


def hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, end to end, and the number of words of each text."""
    clean = [_clean(t) for t in texts]
    starts, hashes = kernel.placed_hashes(b" ".join(clean))
    ends = np.cumsum([len(x) + 1 for x in clean], dtype=np.int64)
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


@dataclass(frozen=True)
class Slots:
    """Sorted hashes by their leading bits: where the names of a slot begin, and whether it has several; no slot has more than ``most``."""

    first: np.ndarray
    several: np.ndarray
    shift: np.uint64
    most: int


def slots_of(names: np.ndarray) -> Slots:
    bits = max(16, len(names).bit_length() + 3)
    shift = np.uint64(64 - bits)
    held = np.bincount((names >> shift).astype(np.int64), minlength=1 << bits)
    first = np.minimum(np.cumsum(held) - held, max(0, len(names) - 1)).astype(np.int32)
    return Slots(first, held > 1, shift, int(held.max()))


def _found(words: np.ndarray, names: np.ndarray, slots: Slots | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the sorted ``names``, and the places there of those that are. ``slots``: of the names, where many calls share them."""
    if not len(names):
        return np.zeros(len(words), bool), np.empty(0, np.int64)
    slots = slots_of(names) if slots is None else slots
    slot = (words >> slots.shift).astype(np.int64)
    at = slots.first[slot].astype(np.int64)
    known = names[at] == words
    rest = np.flatnonzero(~known & slots.several[slot])
    for _ in range(slots.most - 1):
        at[rest] = np.minimum(at[rest] + 1, len(names) - 1)
        known[rest] = names[at[rest]] == words[rest]
        rest = rest[~known[rest]]
    return known, at[known]


def ids_of(text: str | None, names: np.ndarray, order: np.ndarray, net: Net) -> np.ndarray:
    """Token ids: ``names`` sorted word hashes, ``order`` their ids."""
    return _ids(kernel.word_hashes(_clean(text)), names, order, net)


def _ids(h: np.ndarray, names: np.ndarray, order: np.ndarray, net: Net, slots: Slots | None = None) -> np.ndarray:
    out = net.tokens - net.rare + (h % np.uint64(net.rare)).astype(np.int64)
    known, at = _found(h, names, slots)
    out[known] = order[at]
    return out


def _sides(net: Net) -> np.ndarray:
    return np.array([*range(-net.reach, 0), *range(1, net.reach + 1)])


def contexts(ids: np.ndarray, at: np.ndarray, net: Net) -> np.ndarray:
    """Ids around each position, left to right; the padding id beyond the ends."""
    padded = np.concatenate([np.full(net.reach, net.tokens), ids, np.full(net.reach, net.tokens)])
    steps = np.array([*range(net.reach), *range(net.reach + 1, 2 * net.reach + 1)])
    return padded[at[:, None] + steps]


def _tables(w: Weights) -> np.ndarray:
    """What each token adds to the hidden layer at each side; the bias rides along with the first."""
    out = np.matmul(w["e"][None], w["p"])
    out[0] += w["b"]
    return out


def log_probs(context: np.ndarray, target: np.ndarray, w: Weights, net: Net, tables: np.ndarray | None = None) -> np.ndarray:
    """log p(target | both sides)."""
    tables = _tables(w) if tables is None else tables
    n, width = len(target), len(w["b"])
    cls = target // net.members
    mem = target - cls * net.members
    by = np.argsort(cls.astype(np.uint16), kind="stable")
    cls, mem = cls[by], mem[by]
    sides_of = context.T.take(by, axis=1)
    z = tables[0].take(sides_of[0], axis=0)
    for p in range(1, len(sides_of)):
        z += tables[p].take(sides_of[p], axis=0)
    np.tanh(z, out=z)
    h = np.ones((n, width + 1), z.dtype)
    h[:, :width] = z
    cut = np.searchsorted(cls, np.arange(net.classes + 1)).tolist()
    first = h @ np.vstack([w["c"], w["cb"]])
    m = np.concatenate([w["m"], w["mb"][:, None]], axis=1)
    second = np.empty((n, net.members), h.dtype)
    for k in range(net.classes):
        if cut[k + 1] > cut[k]:
            np.dot(h[cut[k] : cut[k + 1]], m[k], out=second[cut[k] : cut[k + 1]])
    rows = np.arange(n)
    own = first.ravel()[rows * net.classes + cls] + second.ravel()[rows * net.members + mem]
    out = np.empty(n, h.dtype)
    out[by] = own - _log_total(first) - _log_total(second)
    return out


def _log_total(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row; ``x`` is used up."""
    if len(x) and x.max() < 80:
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    most = x.max(axis=1)
    return most + np.log(np.exp(x - most[:, None]).sum(axis=1))


def _softmax(x: np.ndarray, rows: int) -> np.ndarray:
    """Of rows, in place, each divided by ``rows``; logits are cut at 80, so that no row's largest has to be sought."""
    if len(x) and x.max() > 80:
        np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x *= np.repeat(1 / (x @ np.full(x.shape[1], rows, x.dtype)), x.shape[1]).reshape(x.shape)
    return x


def _crossed(a: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """``a.T @ b`` of tall matrices, by blocks of rows that stay near the processor."""
    k = len(a) // block * block
    out = a[k:].T @ b[k:]
    if k:
        out += np.matmul(a[:k].reshape(-1, block, a.shape[1]).transpose(0, 2, 1), b[:k].reshape(-1, block, b.shape[1])).sum(axis=0)
    return out


def _sums_by(tokens: np.ndarray, rows: np.ndarray, vocab: int) -> np.ndarray:
    """The sum of the rows of each token. Two columns are added as one complex number."""
    kind, width = rows.dtype, rows.shape[1]
    pair = np.result_type(kind, np.complex64)
    pairs = (np.pad(rows, ((0, 0), (0, 1))) if width % 2 else rows).view(pair)
    out = np.zeros((pairs.shape[1], vocab), pair)
    for k in range(len(out)):
        np.add.at(out[k], tokens, pairs[:, k])
    return out.T.copy().view(kind)[:, :width]


def gradients(context: np.ndarray, target: np.ndarray, w: Weights, net: Net) -> Weights:
    """Of the mean negative log-probability of a batch. Biases ride along as a last row of their matrix, read by a column of ones."""
    n, sides, width, (vocab, dim) = len(target), context.shape[1], len(w["b"]), w["e"].shape
    kind = w["e"].dtype
    cls = target // net.members
    mem = target - cls * net.members
    by = np.argsort(cls.astype(np.uint16), kind="stable")  # rows of a class lie together
    cls, mem = cls[by], mem[by]
    tokens = context.take(by, axis=0).astype(np.intp).ravel()
    e, p = w["e"].take(tokens, axis=0).reshape(n, sides * dim), w["p"].reshape(sides * dim, width)
    z = e @ p
    z += w["b"]
    np.tanh(z, out=z)
    h = np.ones((n, width + 1), kind)
    h[:, :width] = z
    cut = np.searchsorted(cls, np.arange(net.classes + 1)).tolist()
    rows, one = np.arange(n), kind.type(1 / n)
    d = _softmax(h @ np.vstack([w["c"], w["cb"]]), n)
    d.ravel()[rows * net.classes + cls] -= one
    m = np.concatenate([w["m"], w["mb"][:, None]], axis=1)
    q, back, second = np.empty((n, net.members), kind), np.empty((n, width), kind), np.zeros_like(m)
    filled = [(k, h[i:j], q[i:j], back[i:j]) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
    for k, own, logits, _ in filled:
        np.dot(own, m[k], out=logits)
    _softmax(q, n)
    q.ravel()[rows * net.members + mem] -= one
    upward = w["m"].transpose(0, 2, 1).copy()
    for k, own, off, onto in filled:
        np.dot(own.T, off, out=second[k])
        np.dot(off, upward[k], out=onto)
    back += d @ w["c"].T
    first = _crossed(h, d)
    z *= z
    np.subtract(1, z, out=z)
    z *= back
    embedded = _sums_by(tokens, (z @ p.T).reshape(n * sides, dim), vocab)
    return {"c": first[:width], "cb": first[width], "m": second[:, :width], "mb": second[:, width], "b": np.ones(n, kind) @ z, "p": _crossed(e, z).reshape(w["p"].shape), "e": embedded}


def learn(context: np.ndarray, target: np.ndarray, w: Weights, square: Weights, net: Net) -> None:
    """One Adagrad step on a batch."""
    for k, g in gradients(context, target, w, net).items():
        square[k] += g * g
        step = np.sqrt(square[k])
        step += 1e-4
        np.divide(g, step, out=step)
        step *= net.rate
        w[k] -= step


def learn_all(texts: list[np.ndarray], w: Weights, net: Net, seed: int) -> None:
    """Adagrad over every position of the texts, each once, in a mixed order."""
    square = {k: np.full_like(v, 1e-3) for k, v in w.items()}
    pad = np.full(net.reach, net.tokens, dtype=np.int32)
    flat = np.concatenate([pad, *(y for x in texts for y in (x, pad))], dtype=np.int32)
    at = np.flatnonzero(flat != net.tokens).astype(np.int32)
    np.random.default_rng(seed).shuffle(at)
    sides = _sides(net)
    done, step = 0, 0
    while done < len(at):
        pick = at[done : done + min(net.most_batch, net.batch << min(step // net.steps, 40))]
        learn(flat[pick[:, None] + sides], flat[pick], w, square, net)
        done, step = done + len(pick), step + 1


def _distinct(words: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each of ``texts`` texts, in order; how often each occurs there; and where a next text's words begin."""
    order = np.lexsort((words, text))
    words, text = words[order], text[order]
    head = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (text[1:] != text[:-1]))) if len(words) else np.empty(0, np.int64)
    return words[head], np.diff(head, append=len(words)), np.searchsorted(text[head], np.arange(1, texts))


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row a word of several counts of words."""
    words, times = (np.concatenate(x) for x in zip(*counts, strict=True))
    by = np.argsort(words)
    words = words[by]
    head = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.empty(0, np.int64)
    total = np.add.reduceat(times[by], head) if len(head) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(words[head].view(np.int64)), pa.array(total.astype(np.int64))], names=["word", "times"])


def word_counts(docs: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(word, times): hashes of all words of all texts, and how often they occur. A task sums up to about ``most`` counts of parts of its texts first, so the aggregate meets fewer rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                hashes, _ = hashes_of(batch.column(0).slice(i, 1000).to_pylist())
                held.append(np.unique(hashes, return_counts=True))
                if sum(len(x) for x, _ in held) >= most:
                    yield _summed(held)
                    held.clear()
        if held:
            yield _summed(held)

    return docs.select("text").mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def vocabulary(docs: DataFrame, net: Net = Net(), counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest words of all texts, and their ids by rank."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.orderBy(F.desc("times"), "word").limit(net.tokens - net.rare).collect()
    names = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    by = np.argsort(names)
    return names[by], by.astype(np.int64)


@dataclass(frozen=True)
class Rare:
    """Words of the buckets: a table (word, nano) of their log-probabilities within their bucket in 1e-9, so that sums don't depend
    on an order; ``unseen`` is that of a word never counted, by bucket. ``frequent`` holds the sorted hashes and the nanos of the
    frequent words, which are in many texts: the scan adds these, and only the others are joined."""

    words: DataFrame
    unseen: list[int]
    frequent: tuple[np.ndarray, np.ndarray]


def _bucket(net: Net) -> str:
    """The bucket of a word, whose hash is unsigned."""
    return f"cast(pmod(pmod(word, {net.rare}) + if(word < 0, {(1 << 64) % net.rare}, 0), {net.rare}) as int)"


def rare_words(counts: DataFrame, vocab: tuple[np.ndarray, np.ndarray], net: Net = Net()) -> Rare:
    rest = counts.where(~F.col("word").isin(vocab[0].view(np.int64).tolist())).withColumn("bucket", F.expr(_bucket(net)))
    totals = {r["bucket"]: r["n"] for r in rest.groupBy("bucket").agg(F.sum("times").alias("n")).collect()}
    total = F.element_at(F.array(*(F.lit(totals.get(k, 0) + 1) for k in range(net.rare))), F.col("bucket") + 1)
    words = rest.select("word", "times", F.round(F.log(F.col("times") / total) * 1e9).cast("long").alias("nano"))
    often = F.col("times") > net.frequent * (counts.agg(F.sum("times")).first()[0] or 0)
    got = words.where(often).select("word", "nano").toArrow()
    names, nano = (got.column(c).to_numpy().astype(np.int64) for c in ("word", "nano"))
    by = np.argsort(names.view(np.uint64))
    unseen = [-round(float(np.log(totals.get(k, 0) + 1)) * 1e9) for k in range(net.rare)]
    return Rare(words.where(~often).select("word", "nano"), unseen, (names.view(np.uint64)[by], nano[by]))


def _pack(w: Weights) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _unpack(raw: bytes, like: Weights) -> Weights:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = flat[at : at + n].reshape(like[k].shape).copy()
        at += n
    return out


def _average(copies: DataFrame, like: Weights) -> Weights:
    """The mean of models (n, raw), weighted by n, up a tree of fan-in 64."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        flat = sum(np.frombuffer(r, np.float32).astype(np.float64) * k for r, k in zip(pdf["raw"], pdf["n"], strict=True)) / n
        return pd.DataFrame({"id": [int(pdf["id"].iloc[0]) // 64], "n": [n], "raw": [flat.astype(np.float32).tobytes()]})

    rows = materialize(copies, "lm-copies")
    while rows.count() > 64:
        rows = materialize(rows.groupBy(F.floor(F.col("id") / 64).alias("g")).applyInPandas(merge, "id long, n long, raw binary"), "lm-merged")
    got = sorted(rows.collect(), key=lambda r: r["id"])
    if not got:
        return like
    n = sum(r["n"] for r in got)
    mean: Weights = {}
    for r in got:
        for k, v in _unpack(r["raw"], like).items():
            mean[k] = mean.get(k, 0) + v.astype(np.float64) * (r["n"] / n)
    return {k: v.astype(np.float32) for k, v in mean.items()}


def tokens_of(docs: DataFrame, vocab: tuple[np.ndarray, np.ndarray], buckets: int, net: Net = Net()) -> DataFrame:
    """(bucket, key, ids): the token ids, two or four bytes each, of all texts that have some. Equal texts are dealt by doc_id too."""
    kind = "<u2" if net.tokens < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_of(vocab[0])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hashes, lens = hashes_of(part.column(1).to_pylist())
                raw = [x.tobytes() for x in np.split(_ids(hashes, *vocab, net, slots).astype(kind), np.cumsum(lens)[:-1])]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["key", "ids"])
                yield out.filter(pa.array([bool(x) for x in raw]))

    key = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    return docs.select(key.alias("key"), "text").mapInArrow(run, "key long, ids binary").select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "ids")


def _round(w: Weights, net: Net, seed: int, kind: str):
    """Trains a copy of ``w`` on a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        own = {k: v.copy() for k, v in w.items()}
        bucket = rows.column("bucket")[0].as_py()
        texts = [np.frombuffer(x, kind) for _, x in sorted(zip(rows.column("key").to_pylist(), rows.column("ids").to_pylist(), strict=True))]
        del rows
        learn_all(texts, own, net, seed)
        return pa.table({"id": pa.array([bucket], pa.int64()), "n": pa.array([sum(map(len, texts))], pa.int64()), "raw": pa.array([_pack(own)], pa.binary())})

    return run


def train(docs: DataFrame, vocab: tuple[np.ndarray, np.ndarray], net: Net = Net(), total: int | None = None) -> Weights:
    """``total``: the number of words of ``docs``, where it is known."""
    w = start(net)
    if total is None:
        total = word_counts(docs).agg(F.sum("times")).first()[0] or 0
    buckets = max(1, total // net.bucket_tokens)
    tokens = materialize(tokens_of(docs, vocab, buckets, net), "lm-tokens")
    kind = "<u2" if net.tokens < 1 << 16 else "<u4"
    for turn in range(net.rounds):

        w = _average(tokens.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_round(w, net, net.seed + turn, kind), "id long, n long, raw binary"), w)
    discard(tokens)
    return w


def score_text(text: str | None, vocab: tuple[np.ndarray, np.ndarray], w: Weights, net: Net, tables: np.ndarray | None = None, block: int = 16384) -> tuple[int, float]:
    ids = ids_of(text, *vocab, net)
    total = 0.0
    for i in range(0, len(ids), block):
        at = np.arange(i, min(i + block, len(ids)))
        total += float(log_probs(contexts(ids, at, net), ids[at], w, net, tables).sum(dtype=np.float64))
    return len(ids), total


def score(docs: DataFrame, vocab: tuple[np.ndarray, np.ndarray], w: Weights, net: Net = Net(), text: str = "text", rare: Rare | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_likelihood`` (sum) and ``mean_log_likelihood``; words of a bucket count alike without ``rare``."""
    from pyspark import TaskContext

    new = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()), T.StructField("mean_log_likelihood", T.DoubleType())]
    names = {f.name for f in new}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names and (keep_text or f.name != text)]
    passed = [f.name for f in kept]
    held = [T.StructField("__row", T.LongType()), T.StructField("__words", T.ArrayType(T.LongType())), T.StructField("__times", T.ArrayType(T.LongType())), T.StructField("__often", T.LongType())] if rare else []
    least = net.tokens - net.rare
    often, nano = rare.frequent if rare else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sides = _tables(w), _sides(net)
        slots, slots_often = slots_of(vocab[0]), slots_of(often)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, total, words, times, sums = [], [], [], [], []
            for i in range(0, batch.num_rows, 256):
                hashes, lens = hashes_of(batch.column(batch.schema.get_field_index(text)).slice(i, 256).to_pylist())
                ids, cuts = _ids(hashes, *vocab, net, slots), np.cumsum(lens)
                if held:
                    of = np.repeat(np.arange(len(lens)), lens)
                    at = np.flatnonzero(ids >= least)
                    known, found = _found(hashes[at], often, slots_often)
                    add = np.zeros(len(ids) + 1, np.int64)
                    add[at[known] + 1] = nano[found]
                    sums += np.diff(np.cumsum(add)[cuts], prepend=0).tolist()
                    name, k, held_by = _distinct(hashes[at[~known]], of[at[~known]], len(lens))
                    words += np.split(name.view(np.int64), held_by)
                    times += np.split(k, held_by)
                # texts end to end, with the padding id between them
                padded = np.full(len(ids) + net.reach * (len(lens) + 1), net.tokens, dtype=np.int64)
                at = np.arange(len(ids)) + net.reach * (1 + np.repeat(np.arange(len(lens)), lens))
                padded[at] = ids
                lp = np.zeros(len(ids))
                for j in range(0, len(ids), 4096):
                    lp[j : j + 4096] = log_probs(padded[at[j : j + 4096, None] + sides], ids[j : j + 4096], w, net, tables)
                n += lens.tolist()
                total += [float(x.sum()) for x in np.split(lp, cuts[:-1])]
            mean = [t / k if k else 0.0 for t, k in zip(total, n, strict=True)]
            cols = [batch.column(batch.schema.get_field_index(p)) for p in passed] + [pa.array(n, pa.int64()), pa.array([t if k else 0.0 for t, k in zip(total, n, strict=True)], pa.float64()), pa.array(mean, pa.float64())]
            if held:
                cols += [pa.array(np.arange(row, row + batch.num_rows)), pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())), pa.array(sums, pa.int64())]
                row += batch.num_rows
            yield pa.RecordBatch.from_arrays(cols, names=[*passed, *(f.name for f in [*new, *held])])

    asked = list(dict.fromkeys([*passed, text]))
    scored = docs.select(*asked).mapInArrow(run, T.StructType([*kept, *new, *held]))
    if rare is None:
        return scored
    # row ids are of one run of the scan, so both sides of the join read its table
    scored = materialize(scored, "lm-scored")
    pairs = scored.select("__row", F.explode(F.arrays_zip("__words", "__times")).alias("x")).select("__row", F.col("x.__words").alias("word"), F.col("x.__times").alias("k"))
    unseen = F.element_at(F.array(*map(F.lit, rare.unseen)), F.expr(_bucket(net)) + 1)
    more = pairs.join(rare.words, "word", "left").groupBy("__row").agg(F.sum(F.col("k") * F.coalesce("nano", unseen)).alias("__nano"))
    total = F.col("log_likelihood") + (F.col("__often") + F.coalesce("__nano", F.lit(0))) / F.lit(1e9)
    return scored.drop("__words", "__times").join(more, "__row", "left").select(
        *passed, "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).otherwise(0.0).alias("mean_log_likelihood")
    )
