"""Hashed word shingles of whole columns of texts, in numpy over Arrow buffers.

A-Z become lower case, words are the runs of bytes other than blank and 0x09-0x0D. A text's set holds a 64-bit hash of
each distinct run of five words; a text of fewer words has its whole sequence as one; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
STEP = 1 << 20  # bytes of text that are hashed at once, but for a longer text
_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(5)
#: A random value for each byte; capital letters share the small ones'.
_VALUE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b % (1 << 64), np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[size]


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle, in order; data: bytes of all texts, one after another."""
    n = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return empty
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] |= word[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return empty
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends_at] |= word[ends_at]
    ends = np.flatnonzero(last) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    h = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=n)
    out_doc, out = [], []
    if len(h) >= WORDS:
        whole = doc[: -WORDS + 1] == doc[WORDS - 1 :]
        s = h[: -WORDS + 1]
        for k in range(1, WORDS):
            s = mixed(s * np.uint64(3) + h[k : len(h) - WORDS + 1 + k] + np.uint64(k))
        out_doc.append(doc[: -WORDS + 1][whole])
        out.append(s[whole])
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        before = np.cumsum(count) - count
        s = np.full(len(short), 0x51ED270B, np.uint64) + count[short].astype(np.uint64)
        for k in range(WORDS - 1):
            has = count[short] > k
            s[has] = mixed(s[has] * np.uint64(5) + h[before[short[has]] + k])
        out_doc.append(short)
        out.append(s)
    if not out:
        return empty
    return np.concatenate(out_doc), np.concatenate(out)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + STEP, "right")) - 1)
        doc, h = hashed(data[at[row] : at[end]], at[row : end + 1] - at[row])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        cuts = np.searchsorted(doc, np.arange(end - row + 1))
        for i in range(end - row):
            yield np.unique(h[cuts[i] : cuts[i + 1]])
        row = end
