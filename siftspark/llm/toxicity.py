"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is lower-cased (A-Z), stripped of ASCII punctuation and split into words. A word's input is two hashed word vectors
(added, so that a collision in one table doesn't carry a word's weight) beside the mean of its hashed byte-trigram vectors.
Windows of ``width`` words, ``stride`` apart, cover every word of every text and overlap; each is read in both directions,
its states are pooled by attention, and the text's score is that of its most toxic window.

Training is plain numpy, in one task of the cluster, from a bounded sample (``Training``: documented limits on labelled rows and
text length) chosen by hash over the whole label table; the driver gets the weights. Scoring is one pass over the scan's own
partitions, without a shuffle. A worker's memory is its word table (bounded), one batch of windows and the text at hand.

Defined results: null and empty texts score like a window without words. Without labels of both kinds, every text scores the
share of toxic labels, 0 where there are none. Repeated rows score alike. Conflicting labels of a document: toxic wins.
Labels of null or unknown documents are left out. Columns of the input pass through; clashing names are replaced. An empty table gives an empty result.
A text of any length is scored by its windows, some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm import kernel
from siftspark.llm.sampling import fitted, least_hashed

_DROP = bytes(c for c in range(33, 127) if not chr(c).isalpha())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Shape:
    width: int = 48
    stride: int = 32
    hidden: int = 8
    word_dim: int = 8
    char_dim: int = 8
    attention: int = 8
    word_bits: int = 16
    char_bits: int = 14


@dataclass(frozen=True)
class Training:
    #: the bound of the labelled sample: rows of either label, and bytes of a text
    positives: int = 1500
    negatives: int = 3000
    text_bytes: int = 20_000
    #: epochs, and more of them until so many batches were learned from
    epochs: int = 5
    steps: int = 120
    batch: int = 256
    rate: float = 0.01
    #: of the toxic texts, so many with the least evidence sit out an epoch: labels are weak, and such texts teach noise
    trimmed: float = 0.08
    seed: int = 11


@dataclass
class Model:
    shape: Shape
    prior: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _DROP).split()


def _hashed(words: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both word tables; trigram rows of all words and where each word's begin."""
    h = kernel.word_hashes(b" ".join(words))
    one, two = (h & np.uint64((1 << shape.word_bits) - 1)).astype(np.int64), (h >> np.uint64(64 - shape.word_bits)).astype(np.int64)
    raw = np.frombuffer(b"\x02" + b"\x03\x02".join(words) + b"\x03", np.uint8).astype(np.uint64)
    code = kernel.mix(raw[:-2] | (raw[1:-1] << np.uint64(8)) | (raw[2:] << np.uint64(16)))
    inside = (raw[1:-1] != 2) & (raw[1:-1] != 3)
    rows = (code[inside] & np.uint64((1 << shape.char_bits) - 1)).astype(np.int64)
    lens = np.array([len(w) for w in words])
    return one, two, rows, np.concatenate([[0], np.cumsum(lens)[:-1]])


def _inputs(words: list[bytes], w: dict[str, np.ndarray], shape: Shape) -> np.ndarray:
    one, two, rows, at = _hashed(words, shape)
    lens = np.diff(np.append(at, len(rows)))[:, None]
    return np.hstack([w["e1"][one] + w["e2"][two], np.add.reduceat(w["c"][rows], at, axis=0) / lens]).astype(np.float32)


def window_starts(n: int, shape: Shape) -> range:
    """Starts of the windows over ``n`` words; the last ends with the text."""
    return range(0, max(1, n - shape.width + shape.stride), shape.stride)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    g = h @ u
    zr = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
    return n + z * (h - n), z, r, n, g[:, 2 * k :]


def forward(proj: np.ndarray, lens: np.ndarray, w: dict[str, np.ndarray], shape: Shape, keep: bool = False) -> tuple[np.ndarray, dict]:
    """Logits of windows. proj (width, windows, 6 hidden): input parts of both directions; lens falls from row to row."""
    k, width, b = shape.hidden, proj.shape[0], proj.shape[1]
    states = np.zeros((width, b, 2 * k), dtype=np.float32)
    tape: dict = {"f": [None] * width, "b": [None] * width}
    for side, order, off in (("f", range(width), 0), ("b", range(width - 1, -1, -1), 1)):
        h, u = np.zeros((b, k), dtype=np.float32), w["u" + side]
        for t in order:
            m = int(np.searchsorted(-lens, -t, "left"))  # rows with lens > t
            if m:
                old = h[:m].copy() if keep else h[:m]
                new = _step(proj[t, :m, 3 * k * off : 3 * k * (off + 1)], old, u, k)
                if keep:
                    tape[side][t] = (m, old, *new[1:])
                h[:m] = new[0]
                states[t, :m, k * off : k * (off + 1)] = new[0]
    q = np.tanh(states @ w["wa"])
    e = q @ w["va"]
    e[np.arange(width)[:, None] >= lens[None, :]] = -1e9
    a = np.exp(e - e.max(axis=0))
    a *= np.arange(width)[:, None] < lens[None, :]
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbd->bd", a, states)
    return pooled @ w["wo"] + w["bo"][0], tape | {"states": states, "q": q, "a": a, "pooled": pooled}


def backward(d: np.ndarray, proj: np.ndarray, tape: dict, w: dict[str, np.ndarray], shape: Shape) -> dict[str, np.ndarray]:
    """Gradients from those of the logits, ``proj`` included."""
    k, width = shape.hidden, proj.shape[0]
    states, q, a = tape["states"], tape["q"], tape["a"]
    g = {"wo": tape["pooled"].T @ d, "bo": np.array([d.sum()], dtype=np.float32)}
    dp = d[:, None] * w["wo"][None, :]
    da = np.einsum("bd,tbd->tb", dp, states)
    de = a * (da - (a * da).sum(axis=0))
    dq = de[:, :, None] * w["va"] * (1 - q * q)
    g["va"] = np.einsum("tb,tbd->d", de, q)
    g["wa"] = np.einsum("tbd,tbe->de", states, dq)
    ds = a[:, :, None] * dp[None] + dq @ w["wa"].T
    dproj = np.zeros_like(proj)
    for side, order, off in (("f", range(width - 1, -1, -1), 0), ("b", range(width), 1)):
        u, du = w["u" + side], np.zeros_like(w["u" + side])
        dh = np.zeros((proj.shape[1], k), dtype=np.float32)
        for t in order:
            if tape[side][t] is None:
                continue
            m, old, z, r, n, gn = tape[side][t]
            dn_h = dh[:m] + ds[t, :m, k * off : k * (off + 1)]
            dz = dn_h * (old - n) * z * (1 - z)
            dn = dn_h * (1 - z) * (1 - n * n)
            dr = dn * gn * r * (1 - r)
            dx = np.hstack([dz, dr, dn])
            dg = np.hstack([dz, dr, dn * r])
            du += old.T @ dg
            dh[:m] = dn_h * z + dg @ u.T
            dproj[t, :m, 3 * k * off : 3 * k * (off + 1)] = dx
        g["u" + side] = du
    g["proj"] = dproj
    return g


def _start(shape: Shape, rng: np.random.Generator) -> dict[str, np.ndarray]:
    k, d = shape.hidden, shape.word_dim + shape.char_dim
    rand = lambda *s, by=0.3: (rng.standard_normal(s) * by).astype(np.float32)
    w = {"e1": np.zeros((1 << shape.word_bits, shape.word_dim), np.float32), "e2": np.zeros((1 << shape.word_bits, shape.word_dim), np.float32), "c": rand(1 << shape.char_bits, shape.char_dim, by=0.1), "wx": rand(d, 6 * k), "bx": np.zeros(6 * k, np.float32), "uf": rand(k, 3 * k), "ub": rand(k, 3 * k), "wa": rand(2 * k, shape.attention), "va": rand(shape.attention), "wo": rand(2 * k), "bo": np.array([-2.0], np.float32)}
    return w


def _log_odds(docs: list[np.ndarray], labels: np.ndarray, one: np.ndarray, two: np.ndarray, w: dict[str, np.ndarray]) -> None:
    """Words (numbers from 1) seen in three texts or more begin with their log odds in the first dimension of both word tables."""
    times = np.zeros((2, len(one) + 1), dtype=np.int32)
    for x, y in zip(docs, labels, strict=True):
        times[int(y), np.unique(x)] += 1
    seen = np.flatnonzero(times[:, 1:].sum(axis=0) >= 3)
    n = times[:, 1:][:, seen].astype(float)
    odds = np.log((n[1] + 0.5) / (labels.sum() + 1)) - np.log((n[0] + 0.5) / (len(labels) - labels.sum() + 1))
    odds = np.clip(odds, -1, 4) * np.minimum(1, n.sum(axis=0) / 20)
    order = np.argsort(n.sum(axis=0), kind="stable")  # of words in one row the commonest stays
    for table, rows in (("e1", one), ("e2", two)):
        w[table][rows[seen[order]], 0] = odds[order] / 2


def _numbered(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Texts as numbers of their words, from 1 in the order of the bytes, and those words."""
    first: dict[bytes, int] = {}
    docs = [np.fromiter((first.setdefault(t, len(first)) for t in words_of(text)), np.int32) for text in texts]
    names = sorted(first)
    rank = np.empty(len(names), np.int32)
    rank[[first[t] for t in names]] = np.arange(1, len(names) + 1, dtype=np.int32)
    return [rank[x] for x in docs], names


def train(texts: list[str | None], labels: list[int], shape: Shape = Shape(), how: Training = Training(), share: float | None = None) -> Model:
    """A model from labelled texts. ``share``: that of toxic rows among all labels, where the sample has another one; the
    last bias is moved by the difference of the log odds.

    Texts are held as word numbers (4 bytes) and windows as starts and sizes; what a batch needs is built for that batch."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(shape, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(how.seed)
    docs, vocabulary = _numbered(texts)
    w = _start(shape, rng)
    one, two, rows, at = (x.astype(np.int32) for x in _hashed(vocabulary, shape)) if vocabulary else (np.empty(0, np.int32),) * 4
    lens = np.diff(np.append(at, len(rows))).astype(np.int32)
    del vocabulary
    _log_odds(docs, y, one, two, w)

    def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigram rows of some words of the vocabulary, end to end, and where each word's begin."""
        n = lens[words]
        start = np.cumsum(n) - n
        return rows[np.arange(n.sum()) + np.repeat(at[words] - start, n)], start

    def vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of some words of the vocabulary, and their trigram rows."""
        r, a = grams(words)
        chars = np.add.reduceat(w["c"][r], a, axis=0) / lens[words].astype(np.float32)[:, None]
        return np.hstack([w["e1"][one[words]] + w["e2"][two[words]], chars]).astype(np.float32, copy=False), r

    starts = [np.asarray(window_starts(len(x), shape), dtype=np.int32) for x in docs]
    count = [len(x) for x in starts]
    ends = np.cumsum([len(x) for x in docs])
    owner_ = np.repeat(np.arange(len(docs), dtype=np.int32), count)
    inner = np.concatenate(starts)
    base = inner + np.repeat(ends - [len(x) for x in docs], count)
    size = np.minimum(np.repeat([len(x) for x in docs], count) - inner, shape.width).astype(np.int32)
    flat = np.append(np.concatenate(docs), np.zeros(shape.width, np.int32))
    del docs, starts, inner

    def grid(pick: np.ndarray | slice) -> np.ndarray:
        """Word numbers of some windows, 0 beyond their ends."""
        cells = np.arange(shape.width)
        return np.where(cells < size[pick][:, None], flat[base[pick][:, None] + cells], 0)

    dense = ("wx", "bx", "uf", "ub", "wa", "va", "wo", "bo")
    moment = {k: (np.zeros_like(w[k]), np.zeros_like(w[k])) for k in dense}
    square = {k: np.full(len(w[k]), 1e-6, np.float32) for k in ("e1", "e2", "c")}
    tick = 0

    def projected() -> np.ndarray:
        """Input parts of all words, row 0 for none."""
        out = np.empty((len(one) + 1, 6 * shape.hidden), np.float32)
        out[0] = w["bx"]
        for i in range(0, len(one), 8192):
            out[i + 1 : i + 8193] = vectors(np.arange(i, min(i + 8192, len(one))))[0] @ w["wx"] + w["bx"]
        return out

    for epoch in range(max(how.epochs, how.steps)):
        if epoch >= how.epochs and tick >= how.steps:
            break
        logit = np.empty(len(base), np.float32)
        if epoch:
            proj = projected()
            for i in range(0, len(base), 512):
                logit[i : i + 512] = _logits(proj, grid(slice(i, i + 512)), size[i : i + 512], w, shape)
            del proj
        else:  # before any step, a window is as toxic as its most telling word
            telling = np.append(np.float32(0), w["e1"][one, 0] + w["e2"][two, 0])
            for i in range(0, len(base), 4096):
                logit[i : i + 4096] = telling[grid(slice(i, i + 4096))].max(axis=1)
        order = np.lexsort((-logit, owner_))
        top = order[np.concatenate([[True], owner_[order][1:] != owner_[order][:-1]])]
        hits = top[y[owner_[top]] == 1]
        doubted = hits[np.argsort(logit[hits], kind="stable")][: int(how.trimmed * len(hits))]
        top = np.setdiff1d(top, doubted) if epoch else top
        others = np.flatnonzero(y[owner_] == 0)
        chosen = np.concatenate([top, rng.choice(others, min(len(others), len(y)), replace=False)])
        rng.shuffle(chosen)
        for s in range(0, len(chosen), how.batch):
            pick = chosen[s : s + how.batch]
            pick = pick[np.argsort(-size[pick], kind="stable")]
            ids = grid(pick)
            used, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape).T
            real = used[used > 0] - 1
            vec = np.zeros((len(used), shape.word_dim + shape.char_dim), np.float32)
            if len(real):
                vec[used > 0], r = vectors(real)
            proj = (vec @ w["wx"] + w["bx"])[back]
            out, tape = forward(proj, size[pick], w, shape, keep=True)
            d = ((_sigmoid(out) - y[owner_[pick]]) / len(pick)).astype(np.float32)
            g = backward(d, proj, tape, w, shape)
            dvec_proj = _gathered(back.ravel(), g.pop("proj").reshape(-1, 6 * shape.hidden))[1]
            g["wx"], g["bx"] = vec.T @ dvec_proj, dvec_proj.sum(axis=0)
            dvec = dvec_proj @ w["wx"].T
            tick += 1
            for k in dense:
                m, v = moment[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                w[k] -= how.rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-6)
            if len(real):
                dw = dvec[used > 0]
                n = lens[real]
                for k, to, by in (("e1", one[real], dw[:, : shape.word_dim]), ("e2", two[real], dw[:, : shape.word_dim]), ("c", r, np.repeat(dw[:, shape.word_dim :] / n.astype(np.float32)[:, None], n, axis=0))):
                    rows_, total = _gathered(to, by)
                    square[k][rows_] += (total**2).mean(axis=1)
                    w[k][rows_] -= how.rate * total / np.sqrt(square[k][rows_])[:, None]
    own = float(y.mean())
    if share is not None and 0 < share < 1:
        w["bo"] += np.float32(np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return Model(shape, own if share is None else share, w)


def _gathered(rows: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, ascending, and the sum of what belongs to each."""
    order = np.argsort(rows, kind="stable")
    distinct, start = np.unique(rows[order], return_index=True)
    return distinct, np.add.reduceat(by[order], start, axis=0)


def _logits(proj: np.ndarray, grid: np.ndarray, size: np.ndarray, w: dict[str, np.ndarray], shape: Shape) -> np.ndarray:
    order = np.argsort(-size, kind="stable")
    most = max(1, int(size.max())) if len(size) else 1
    out = np.empty(len(size), np.float32)
    out[order] = forward(proj[grid[order, :most].T], size[order], w, shape)[0]
    return out


class Scorer:
    """Scores texts in batches of windows, with a bounded table of the words met last."""

    def __init__(self, model: Model, most_words: int = 120_000, batch: int = 1024) -> None:
        self.model, self.most, self.batch = model, most_words, batch
        self._fresh()

    def _fresh(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * self.model.shape.hidden), np.float32)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(ids < 0).tolist()
        if missed:
            new = list(dict.fromkeys(words[i] for i in missed))
            w, at = self.model.weights, len(self.number)
            if len(self.table) < at + len(new) + 1:
                grown = np.zeros((max(2 * len(self.table), at + len(new) + 1), self.table.shape[1]), np.float32)
                grown[: at + 1] = self.table[: at + 1]
                self.table = grown
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.table[at + i + 1 : at + i + 1 + len(part)] = _inputs(part, w, self.model.shape) @ w["wx"] + w["bx"]
            self.number.update(zip(new, range(at + 1, at + 1 + len(new)), strict=True))
            ids[missed] = [self.number[words[i]] for i in missed]
        return ids

    def scores(self, texts: list[str | None]) -> list[float]:
        model, shape = self.model, self.model.shape
        if not model.weights:
            return [model.prior] * len(texts)
        best = np.full(len(texts), -np.inf)
        words: list[bytes] = []
        spans: list[tuple[int, int, int]] = []  # text, first word, words
        most = self.batch * shape.stride

        def flush() -> None:
            if len(self.number) > self.most:
                self._fresh()
            ids = np.append(self._ids(words), np.zeros(shape.width, np.int64))
            starts = [np.arange(len(window_starts(n, shape))) * shape.stride for _, _, n in spans]
            count = [len(x) for x in starts]
            inner = np.concatenate(starts)
            size = np.minimum(np.repeat([n for _, _, n in spans], count) - inner, shape.width)
            grid = ids[(np.repeat([at for _, at, _ in spans], count) + inner)[:, None] + np.arange(shape.width)]
            np.maximum.at(best, np.repeat([i for i, _, _ in spans], count), _logits(self.table, grid, size, model.weights, shape))
            words.clear()
            spans.clear()

        for i, text in enumerate(texts):
            own = words_of(text)
            for cut in range(0, max(1, len(own)), most):  # a long text in parts that overlap like its windows
                part = own[cut : cut + most + shape.width - shape.stride]
                if cut and len(part) <= shape.width - shape.stride:
                    break
                spans.append((i, len(words), len(part)))
                words += part
                if len(words) >= most:
                    flush()
        if spans:
            flush()
        return _sigmoid(best).tolist()


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), how: Training = Training()) -> Model:
    """Learn from labelled rows: of each label those with the least hash of doc_id, up to the bound. Only their ids (at
    most positives + negatives) reach the driver and are broadcast to the scan of the texts; their texts go to the task that trains."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    chosen = [(k, y) for y, most in ((1, how.positives), (0, how.negatives)) if counts.get(y) for _, k in least_hashed(known.where(F.col("toxic") == y), F.xxhash64("doc_id"), "doc_id", most, counts[y])]
    if not chosen:
        return train([], [], shape, how)
    texts = docs.where(F.octet_length("text") <= how.text_bytes).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int")), "doc_id")
    share = counts.get(1, 0) / total

    def learn(rows: list[dict]) -> Model:
        least: dict[int, tuple[str, int]] = {}  # of several texts of a doc_id the least
        for r in rows:
            if r["doc_id"] not in least or r["text"] < least[r["doc_id"]][0]:
                least[r["doc_id"]] = (r["text"], r["toxic"])
        order = [least[i] for i in sorted(least)]
        rows.clear()
        return train([t for t, _ in order], [y for _, y in order], shape, how, share)

    return fitted(sample, learn)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 in ``column``."""
    kept = [f for f in docs.schema.fields if f.name.lower() != column.lower()]
    passed = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out: list[float] = []
            for i in range(0, batch.num_rows, 256):
                out += scorer.scores(batch.column(at).slice(i, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in passed), pa.array(out, pa.float64())], names=[*passed, column])

    return docs.select(*passed, *([text] if text not in passed else [])).mapInArrow(run, schema)
