"""Quality by a weak-label model.

Overlapping heuristic labellers each vote good, bad or abstain on a text. Their votes form a pattern; counts of patterns over
all texts are all that expectation-maximisation needs to estimate how often each labeller votes and is right, for either kind, and
the share of good texts. The posterior of a text's pattern is its label. Posterior labels then train a hashed linear scorer (words,
word shapes, character classes; logistic loss in numpy), which judges every text.

Patterns are at most 3 ** labellers, whatever the corpus, so their counts can be collected. The scorer is fitted on a bounded sample
(``Fit.rows`` rows with the least hash; of them, texts over ``Fit.text_bytes`` are left out), in one task; the driver gets keys and
weights. Votes, counts, posteriors and scores cover all texts.

Defined results: null and empty texts get votes like any text (too short), a posterior and a score. Repeated rows are alike, and
count once in the sample. Ties of the hash go by doc_id. An empty table gives an empty result. Where only one kind is seen the
scorer gives the posterior's mean. ``label`` passes other columns through and replaces one named like its own, in any case of
letters; ``judge`` reads doc_id and text and returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.llm import kernel
from siftspark.llm.sampling import fitted, least_hashed

GOOD, BAD, ABSTAIN = "g", "b", "-"
_UPPER, _LETTER, _DIGIT, _SYMBOL, _HIGH = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL[list(b"#$%&*<>|{}[]~^_=+\\/@")] = True
_HIGH[128:] = True
_SHAPE = bytes(ord("A") if _UPPER[c] else ord("a") if _LETTER[c] else ord("0") if _DIGIT[c] else c for c in range(256))
#: function words of four languages; fixed values
STOPWORDS = b"the of and to in is that for it was on with as are be at this have from or by an not der die und das in den von zu mit sich des auf ist im dem nicht ein eine als auch de la le et les des en un du une que est pour qui dans a par plus pas au sur el los y del se las por con no su para es al lo como mas o".split()
_STOP = np.unique(kernel.word_hashes(b" ".join(STOPWORDS)))


@dataclass(frozen=True)
class Fit:
    rows: int = 4000
    text_bytes: int = 20_000
    bits: int = 16
    epochs: int = 12
    rate: float = 0.3
    decay: float = 1e-4
    seed: int = 3
    em_rounds: int = 200


def measures(data: bytes) -> dict[str, float]:
    raw = np.frombuffer(data, np.uint8)
    words = kernel.word_hashes(data, fold=True)
    n, size = len(words), max(1, len(raw))
    letters = max(1, int(_LETTER[raw].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "words": n,
        "symbols": float(_SYMBOL[raw].sum()) / size,
        "upper": float(_UPPER[raw].sum()) / letters,
        "digits": float(_DIGIT[raw].sum()) / size,
        "distinct": len(np.unique(words)) / n if n else 0.0,
        "top": float(np.unique(words, return_counts=True)[1].max()) / n if n else 0.0,
        "stop": float(np.isin(words, _STOP).mean()) if n else 0.0,
        "letters": letters / size,
        "word_len": letters / n if n else 0.0,
        "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "ended": sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines) if lines else 0.0,
        "bars": data.count(b"|") / max(1, n),
        "bangs": data.count(b"!!") / max(1, n),
    }


def _pick(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else ABSTAIN


#: each labeller sees the measures of a text
LABELLERS = (
    ("symbols", lambda m: _pick(m["symbols"] > 0.05, m["symbols"] < 0.005)),
    ("variety", lambda m: _pick(m["words"] >= 20 and m["distinct"] < 0.15, m["distinct"] > 0.4)),
    ("repeat", lambda m: _pick(m["words"] >= 20 and m["top"] > 0.3, m["top"] < 0.12)),
    ("shout", lambda m: _pick(m["upper"] > 0.4, m["upper"] < 0.15)),
    ("table", lambda m: _pick(m["bars"] > 0.2, m["bars"] < 0.01)),
    ("bangs", lambda m: _pick(m["bangs"] > 0.1, False)),
    ("function_words", lambda m: _pick(m["words"] >= 20 and m["stop"] < 0.02, m["stop"] > 0.08)),
    ("lines", lambda m: _pick(m["same_lines"] > 0.3, False)),
    ("endings", lambda m: _pick(m["ended"] < 0.2, m["ended"] > 0.6)),
    ("short", lambda m: _pick(m["words"] < 5, False)),
)


def votes(data: bytes) -> str:
    m = measures(data)
    return "".join(f(m) for _, f in LABELLERS)


def estimate(patterns: dict[str, int], how: Fit = Fit()) -> tuple[dict[str, float], float, np.ndarray]:
    """Posterior of good for each pattern, the share of good texts, and tables[kind, labeller, vote] of vote probabilities.
    Labellers count as independent given the kind; the start is the majority of votes, which also names the kinds."""
    if not patterns:
        return {}, 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], dtype=float)
    seen = np.array([["bg-".index(c) for c in p] for p in names])
    hot = np.eye(3)[seen]
    good = (hot[:, :, 1].sum(axis=1) + 1) / (hot[:, :, 1].sum(axis=1) + 3 * hot[:, :, 0].sum(axis=1) + 2)
    tables, share = np.zeros((2, seen.shape[1], 3)), 0.5
    for _ in range(how.em_rounds):
        for kind, w in ((0, n * (1 - good)), (1, n * good)):
            held = np.einsum("p,plv->lv", w, hot) + 1.0
            tables[kind] = held / held.sum(axis=1, keepdims=True)
        share = float((n * good).sum() + 1) / (n.sum() + 2)
        log = np.log(tables)[:, np.arange(seen.shape[1]), seen].sum(axis=2) + np.log([[1 - share], [share]])
        fresh = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        if np.abs(fresh - good).max() < 1e-9:
            good = fresh
            break
        good = fresh
    return dict(zip(names, good.tolist(), strict=True)), share, tables


def features(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): words and shapes by their share of the text, character classes by theirs."""
    mask = np.uint64((1 << bits) - 1)
    words, shapes = kernel.word_hashes(data, fold=True), kernel.word_hashes(data.translate(_SHAPE))
    raw = np.frombuffer(data, np.uint8)
    n, size = max(1, len(words)), max(1, len(raw))
    at, times = np.unique(words & mask, return_counts=True)
    sat, stimes = np.unique(kernel.mix(shapes) & mask, return_counts=True)
    dense = np.array([_SYMBOL[raw].sum() / size, _UPPER[raw].sum() / size, _DIGIT[raw].sum() / size, len(at) / n, min(n, 50) / 50])
    base = (1 << bits) * 2
    return np.concatenate([at, sat + np.uint64(1 << bits), np.arange(base, base + len(dense), dtype=np.uint64)]).astype(np.int64), np.concatenate([times / n * 4, stimes / n * 8, dense * 4])


def fit(texts: list[bytes], labels: list[float], how: Fit = Fit()) -> tuple[np.ndarray, float]:
    """(weights, bias) of the scorer from soft labels."""
    w, square = np.zeros((1 << how.bits) * 2 + 8), np.full((1 << how.bits) * 2 + 8, 1e-2)
    mean = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
    b = float(np.log(mean / (1 - mean)))
    rows = [features(t, how.bits) for t in texts]
    rng = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            p = 1 / (1 + np.exp(-np.clip(b + w[at] @ v, -30, 30)))
            g = (p - labels[i]) * v + how.decay * w[at]
            square[at] += g * g
            w[at] -= how.rate * g / np.sqrt(square[at])
            b -= 0.01 * (p - labels[i])
    return w, b


def label(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``votes``, one letter for each labeller."""
    kept = [f for f in docs.schema.fields if f.name.lower() != "votes"]
    passed = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [votes((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(p)) for p in passed), pa.array(got, pa.string())], names=[*passed, "votes"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("votes", T.StringType())]))


def _scorer(docs: DataFrame, total: int, posterior: dict[str, float], share: float, how: Fit) -> tuple[np.ndarray, float]:
    """The scorer fitted to the sample: keys are chosen from hashes alone, then only their texts are fetched."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k"), "text")
    chosen = least_hashed(keyed, F.col("h"), "k", how.rows, total)
    if not chosen:
        return fit([], [], how)
    sample = keyed.where(F.octet_length("text") <= how.text_bytes).join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long, k long")), ["h", "k"])

    def learn(rows: list[dict]) -> tuple[np.ndarray, float]:
        texts = [t.encode("utf-8", "surrogatepass") for _, t in sorted({(r["h"], r["text"]) for r in rows})]
        return fit(texts, [posterior.get(votes(t), share) for t in texts], how)

    return fitted(sample, learn)


def judge(docs: DataFrame, how: Fit = Fit(), least: float = 0.5) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of each row of ``docs(doc_id, text)``."""
    counts = {r["votes"]: r["n"] for r in label(docs.select("text")).drop("text").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, share, _ = estimate(counts, how)
    w, b = _scorer(docs, sum(counts.values()), posterior, share, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                data = (t or "").encode("utf-8", "surrogatepass")
                at, v = features(data, how.bits)
                cast = votes(data)
                out.append((cast, posterior.get(cast, share), float(1 / (1 + np.exp(-np.clip(b + w[at] @ v, -30, 30))))))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array([x >= least for x in cols[2]], pa.bool_())], names=["doc_id", "votes", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")
