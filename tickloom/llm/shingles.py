"""Hashes of words and of word shingles for whole batches of texts at once.

A batch's bytes go through numpy together: words are runs of bytes without white
space (A-Z lowered), each hashed as a polynomial over its bytes, and a shingle as a
polynomial over its words' hashes, all modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts of so many bytes are worked on together (a longer text alone).
PIECE = 2_000_000
_P = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + U((k * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_LETTER = mix(_LOWER.astype(U), 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_P, _INVERSE):
            p = np.full(max(n, PIECE + PIECE // 4), base)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes together."""
    n = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    run = (np.cumsum(n) - n) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def shingles(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; fewer words are one shingle, none are none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    none = [np.zeros(0, U)] * len(texts)
    if not len(b):
        return none
    ink = ~_SPACE[b]
    first, last = ink.copy(), ink.copy()
    inner = edges[(edges > 0) & (edges < len(b))]
    first[1:] &= ~ink[:-1]
    first[inner] = ink[inner]
    last[:-1] &= ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(start):
        return none
    power, inverse = _powers(len(b))
    value = _LETTER[b] * power
    total = np.cumsum(value, dtype=U)
    g = mix((total[end] - total[start] + value[start]) * inverse[start], 2)
    at = np.searchsorted(start, edges)  # the first word of each text
    n = np.diff(at)
    run = np.zeros(max(0, len(g) - words + 1), U)
    for k in range(words):
        run += mix(g[k : k + len(run)], 10 + k)
    run = mix(run, 3)
    out = []
    for i, lo in enumerate(at[:-1]):
        if n[i] >= words:
            s = np.sort(run[lo : lo + n[i] - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n[i]:
            short = sum((mix(g[lo + k : lo + k + 1], 10 + k) for k in range(n[i])), np.zeros(1, U))
            out.append(mix(short, 20 + int(n[i])))
        else:
            out.append(np.zeros(0, U))
    return out


def set_hash(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set of tokens."""
    return int(mix(mix(tokens, 4).sum(dtype=U, keepdims=True) + U(len(tokens)), 5).view(np.int64)[0])
