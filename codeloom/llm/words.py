"""Words and their hashes, for whole Arrow columns of text at once.

A text column arrives as one UTF-8 buffer with offsets. Words are runs of bytes of a class; each
word gets a 64-bit hash from one prefix sum over the bytes, so no Python string is made. Null is
treated as an empty text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
#: Bytes of text worked on at once; a longer document makes a chunk of its own.
CHUNK = 1 << 19
#: Documents in a chunk at most, which bounds tables of documents x features.
CHUNK_DOCS = 256

#: Bytes of words [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = []

#: What a worker keeps between the tasks of one operator; dropped when it turns to another (see batches).
CACHES: list[dict] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_M, _INV):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values of h (empty if there are fewer)."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, dtype=U)
    out = np.zeros(k, dtype=U)
    for j in range(n):
        out += h[j : j + k] * U(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
    return mix(out)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, dtype=np.int64)
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about CHUNK bytes, and CHUNK_DOCS documents at most."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, i + CHUNK_DOCS, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, hash) of each word, and each document's first word (n + 1)."""
    n = len(data)
    if not n:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0, dtype=U), np.zeros(len(offsets), dtype=np.int64)
    w = is_word[data]
    begin, end = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[cut] = w[cut]
    last = cut[1:] - 1
    end[last] = w[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    p, q = _pow(n + 1)
    b = (LOWER[data] if lower else data).astype(U)
    b += U(1)
    b *= p[:n]
    acc = np.empty(n + 1, dtype=U)
    acc[0] = 0
    np.cumsum(b, out=acc[1:])
    h = mix((acc[e] - acc[s]) * q[s] + (e - s).astype(U) * U(0xA0761D6478BD642F))
    return s, e, h, np.searchsorted(s, offsets)


def release() -> None:
    """Gives memory that is free in this process back to the system: a worker is used again by other tasks, of other
    operators too, and the executor's memory holds what all of them once needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def batches(it: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of their texts."""
    for c in CACHES:
        c.clear()
    release()
    for b in it:
        data, off = buffers(b.column(b.schema.get_field_index(text)))
        for i, j in chunks(off):
            yield b.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
    release()
