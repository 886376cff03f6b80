"""Vectorised word kernels over whole texts, as UTF-8 bytes.

A word is a run of ``[^\\x20\\x09-\\x0D]``: the separators are ASCII, so bytes and code points split alike. Every word gets a
64-bit polynomial hash from prefix sums (one multiplication and one running sum over the bytes, no loop over words), then
a finaliser. Long texts are taken in pieces cut at separators, so the memory of one call does not follow the text length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = _CODE.copy()
_FOLD[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
PIECE = 1 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers, _inverse = _ladder(_P, size), _ladder(_PINV, size)


def _ladder(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def _pieces(data: bytes) -> Iterator[bytes]:
    if len(data) <= PIECE:
        yield data
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            while True:
                block = _SEP[np.frombuffer(data, np.uint8, end - at, at)]
                cut = np.flatnonzero(block)
                if len(cut) or end == len(data):
                    break
                end = min(len(data), end + PIECE)
            if len(cut):
                end = at + int(cut[-1]) + 1
        yield data[at:end]
        at = end


def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    word = np.zeros(len(raw) + 2, dtype=np.int8)
    word[1:-1] = ~_SEP[raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes, fold: bool = False) -> np.ndarray:
    """One hash a word, in order. ``fold`` takes A-Z as a-z, and no other letter."""
    return placed_hashes(data, fold)[1]


def placed_hashes(data: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word, and its hash."""
    code, at, starts, out = (_FOLD if fold else _CODE), 0, [], []
    for piece in _pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        start, end = bounds(raw)
        at += len(raw)
        if not len(start):
            continue
        starts.append(start + (at - len(raw)))
        _grow(len(raw) + 1)
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(code[raw] * _powers[: len(raw)], out=run[1:])
        out.append(mix((run[end] - run[start]) * _inverse[start] + (end - start).astype(np.uint64)))
    return (np.concatenate(starts), np.concatenate(out)) if out else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64))


_STEP = (_CODE[:64] * np.uint64(2) + np.uint64(1)).astype(np.uint64)


def windows(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each window of ``width`` words; none where there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out += words[i : i + n] * _STEP[i % 64]
        if width > 64:
            out = mix(out)
    return mix(out)


def shingles(data: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word windows of the folded words; fewer words count as one window."""
    words = word_hashes(data, fold=True)
    if not len(words):
        return words
    return np.unique(windows(words, min(width, len(words))))
