"""Vectorised text primitives used inside Arrow tasks.

A batch of texts is one byte buffer plus document offsets (Arrow's own
layout). Words are maximal runs of bytes other than space, tab, LF, VT, FF and
CR; their 64-bit hashes come from one prefix sum over the buffer, so no Python
loop runs over bytes or words.

Tables that are costly to build live in ``worker_cache``, a dict that stays in
the Python worker from task to task.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1 << 20


def worker_cache() -> dict:
    """A dict kept for the life of this Python process."""
    return sys.modules.setdefault("_vitalis_llm_cache", types.ModuleType("_vitalis_llm_cache")).__dict__


def release(*kept: str) -> None:
    """Forget what other operators left in this worker and give freed memory back to the system.

    Entries whose name (of a pair: its first part) is in ``kept`` stay. Everything
    in the cache is made again when it is asked for.
    """
    cache = worker_cache()
    for name in list(cache):
        if (name[0] if isinstance(name, tuple) else name) not in kept and not str(name).startswith("__"):
            del cache[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    return buf, offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes each (a longer document is a run of its own)."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def small_batches(batches, column: int, limit: int = 4 * BLOCK_BYTES):
    """The rows of Arrow batches in slices of about ``limit`` bytes of one column: what a task copies stays small."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in blocks(np.concatenate([[0], np.cumsum(sizes)]), limit):
            yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n (R odd, so invertible)."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        r = 0xD6E8FEB86659FD93
        out = []
        for base in (r, pow(r, -1, 1 << 64)):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            out.append(np.cumprod(p))
        have = cache["powers"] = tuple(out)
    return have


def _byte_values() -> np.ndarray:
    cache = worker_cache()
    if "bytes" not in cache:
        cache["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return cache["bytes"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte span."""
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_byte_values()[buf] * _powers(len(buf) + 1)[0][:len(buf)], out=p[1:])
    return p


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each span, the same wherever they lie."""
    inv = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start])


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets of the documents) of the words of every document."""
    cache = worker_cache()
    if "solid" not in cache:
        solid = np.ones(256, bool)
        solid[list(WHITESPACE)] = False
        cache["solid"] = solid
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = cache["solid"][buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    gap = ~solid[:-1] | cut[1:n]
    first, last = solid.copy(), solid.copy()
    first[1:] &= gap
    last[:-1] &= ~solid[1:] | cut[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def window_hash(words: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (positions past the end wrap to nothing useful)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    m = np.uint64(multiplier)
    for k in range(1, size):
        h *= m
        h += words[k:k + n]
    return mix(h)


def window_room(word_offs: np.ndarray, size: int) -> np.ndarray:
    """For each word position: does a window of ``size`` words from it stay in its document?"""
    total = int(word_offs[-1])
    room = np.zeros(total + 1, np.int32)
    lens = np.diff(word_offs)
    long = lens >= size
    np.add.at(room, word_offs[:-1][long], 1)
    np.add.at(room, word_offs[:-1][long] + lens[long] - size + 1, -1)
    return np.cumsum(room[:-1]) > 0


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    cache = worker_cache()
    if "lower" not in cache:
        t = np.arange(256, dtype=np.uint8)
        t[65:91] += 32
        cache["lower"] = t
    return cache["lower"][buf]


def pack_high(keys: np.ndarray, width: int) -> bytes:
    """The high ``width`` bytes of each 64-bit key."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 8 - width:].tobytes()


def unpack_high(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - width:] = raw
    return out.view(np.uint64).reshape(-1)


def bucket_edges(sorted_keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits buckets (by high bits) begins in sorted keys."""
    if bits == 0:
        return np.array([0, len(sorted_keys)])
    bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(sorted_keys, bounds), len(sorted_keys))
