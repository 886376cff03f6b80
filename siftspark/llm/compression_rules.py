"""Quality rules by compression bands.

A text is compressed by zstandard as a whole and in fixed chunks. The ratio is compressed bytes over raw bytes. Repetitive
text compresses far below prose of its length, random or encoded text far above; a long text that hides a bad passage
shows it in one of its chunks, the last of which is what is left of the text. Limits depend on the length, since a short text
pays for its headers and tables. Under 128 bytes zstandard stores much prose as it is, so encoded text is told there by the
entropy of the bytes of its words.

Defined results: a null or empty text has no words, so its base rule fails and it is not kept. Repeated rows are judged
each for itself; other columns pass through untouched. Nothing is sampled and no text is cut: a row's memory is its text. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftspark.llm import kernel

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True

#: (bytes from, lowest ratio, highest ratio) of a whole text, and of what is left after its full chunks.
WHOLE_BANDS = (
    (0, 0.70, 9.9), (64, 0.60, 9.9), (96, 0.50, 9.9), (128, 0.42, 0.94), (192, 0.36, 0.90), (256, 0.30, 0.88), (384, 0.25, 0.82), (512, 0.20, 0.78),
    (768, 0.20, 0.76), (1024, 0.17, 0.74), (4096, 0.14, 0.71), (16384, 0.11, 0.69),
)
#: The same for full chunks.
CHUNK_BANDS = ((0, 0.0, 9.9), (4096, 0.10, 0.72))
#: The same for the entropy of a whole text's words, which decides where the ratio has no high limit yet.
ENTROPY_BANDS = ((0, 0.0, 0.54), (56, 0.0, 0.57), (96, 0.0, 0.60), (128, 0.0, 9.9))


@dataclass(frozen=True)
class Bands:
    whole: tuple[tuple[int, float, float], ...] = WHOLE_BANDS
    chunk: tuple[tuple[int, float, float], ...] = CHUNK_BANDS
    chunk_bytes: int = 4096
    #: a text is bad from this share of its bytes, or this many, in bad chunks
    bad_chunk_share: float = 0.34
    bad_chunk_bytes: int = 2048
    level: int = 3
    min_words: int = 10
    repeat_percent: int = 20


COLUMNS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("whole_ratio", T.DoubleType()),
    T.StructField("lowest_chunk_ratio", T.DoubleType()),
    T.StructField("highest_chunk_ratio", T.DoubleType()),
    T.StructField("verdict", T.StringType()),
]


def _band(bands: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    low, high = bands[0][1:]
    for least, lo, hi in bands:
        if size >= least:
            low, high = lo, hi
    return low, high


def _entropy(raw: np.ndarray) -> float:
    """Bits of a byte of the words by the text's own counts, over 8."""
    times = np.bincount(raw[~kernel._SEP[raw]])
    p = times[times > 0] / max(times.sum(), 1)
    return float(-(p * np.log2(p)).sum() / 8)


def _repeats(words: np.ndarray, width: int = 5) -> int:
    w = kernel.windows(words, width)
    if not len(w):
        return 0
    _, back, times = np.unique(w, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def _dup_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in data.split(b"\n"):
        if line in seen:
            found += 1
        elif line.split(None, 1):
            seen.add(line)
    return found


def judge(text: str | None, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    words = kernel.word_hashes(data)
    n = len(words)
    chars = int((~kernel._SEP[raw] & ((raw & 0xC0) != 0x80)).sum())
    symbols, dups, repeat = int(_SYMBOL[raw].sum()), _dup_lines(data), _repeats(words)
    failed = n < bands.min_words or 100 * repeat > bands.repeat_percent * n
    whole = len(pack.compress(data)) / len(data) if data else None
    lows = highs = None
    verdict = "base" if failed else "kept"
    if data:
        low, high = _band(bands.whole, len(data))
        parts = [data[i : i + bands.chunk_bytes] for i in range(0, len(data), bands.chunk_bytes)]
        sizes = np.array([len(x) for x in parts])
        ratios = np.array([len(pack.compress(x)) / len(x) for x in parts]) if len(parts) > 1 else np.array([whole])
        lows, highs = float(ratios.min()), float(ratios.max())
        if not failed:
            limits = [_band(bands.chunk if k == bands.chunk_bytes else bands.whole, k) for k in sizes]
            most = min(bands.bad_chunk_share * len(data), bands.bad_chunk_bytes - 1)
            if whole < low:
                verdict = "repetitive"
            elif whole > high or (len(data) < ENTROPY_BANDS[-1][0] and _entropy(raw) > _band(ENTROPY_BANDS, len(data))[1]):
                verdict = "incompressible"
            elif sizes[[r < lo for r, (lo, _) in zip(ratios, limits, strict=True)]].sum() > most:
                verdict = "repetitive_chunks"
            elif sizes[[r > hi for r, (_, hi) in zip(ratios, limits, strict=True)]].sum() > most:
                verdict = "incompressible_chunks"
    return n, chars, symbols, dups, repeat, failed, verdict == "kept", whole, lows, highs, verdict


def measure(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with the measures and the verdict of each row; a column of ``docs`` with one of their names is replaced.
    Works row by row inside the scan's own partitions: no shuffle, and a lost task reruns alone."""
    names = {f.name.lower() for f in COLUMNS}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, *COLUMNS])
    passed = [f.name for f in kept]
    kinds = [(f.name, {T.LongType: pa.int64(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64(), T.StringType: pa.string()}[type(f.dataType)]) for f in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [judge(x.as_py(), bands, pack) for x in batch.column(batch.schema.get_field_index(text))]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in passed] + [pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=passed + [n for n, _ in kinds])

    return docs.select(*{*passed, text}).select(*dict.fromkeys([*passed, text])).mapInArrow(run, schema)
