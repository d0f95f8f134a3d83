"""Hashes over the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.common import worker_state
from tabloom.llm.token_orc import text_slices

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_MIX = _rng.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    tables = worker_state().get("powers")
    if tables is None or len(tables[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 2 ** 64))
        tables = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x)]) for x in (_BASE, inverse)]
        if size <= 4 * SLICE_BYTES:  # a very long text has tables of its own
            worker_state()["powers"] = tables
    return tables[0][:n], tables[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; NULL is empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and the
    number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_FOLDED[data] * p[:n], out=total[1:])
    words = (total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _MIX[63]
    return mixed(words), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text with fewer words has its whole sequence as its only shingle; a text
    without words has an empty set.
    """
    empty = np.zeros(0, np.uint64)
    for lo, hi in text_slices(texts, SLICE_BYTES):
        words, at = word_hashes(*raw_bytes(texts.slice(lo, hi - lo)))
        rolled = empty
        if len(words) >= width:
            m = len(words) - width + 1
            rolled = np.zeros(m, np.uint64)
            for k in range(width):
                rolled += words[k:k + m] * _MIX[k]
            rolled = mixed(rolled)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                s = np.sort(rolled[a:b - width + 1])
                yield s[np.r_[True, s[1:] != s[:-1]]]
            elif b > a:
                yield mixed((words[a:b] * _MIX[32:32 + b - a]).sum(keepdims=True) ^ _MIX[62:63] * np.uint64(b - a))
            else:
                yield empty
