"""Texts of Arrow batches as byte arrays: words, fingerprints, and tables of numbers in rows.

Small numpy helpers for the inside of tasks. A batch is cut in chunks of a few MB so that a
task's memory does not depend on how many rows a batch holds.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000
SEED = 20_240_601
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**64, 256, dtype=U)


@lru_cache(1)
def _folded() -> np.ndarray:
    low = np.arange(256)
    low[65:91] += 32
    return _letters()[low]


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 … n - 1) modulo 2**64; kept and grown by doubling up to a few MB."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 4096)
        known = np.ones(size, U)
        k = 1
        while k < size:
            m = min(k, size - k)
            known[k:k + m] = known[:m] * U(pow(base, k, 2**64))
            k += m
        if size <= 8 * CHUNK_BYTES:
            _POWERS[base] = known
    return known[:n]


INVERSE = pow(BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of consecutive rows of about ``most`` bytes; null is empty.

    A longer text is a chunk of its own and whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, buf[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a system without it
        return lambda keep: 0


def lean(fn):
    """The function over batches, after which a worker that is used again gives its memory back."""
    @wraps(fn)
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)
    return run


class Prints:
    """Fingerprints of any stretch of a byte array from one prefix sum."""

    def __init__(self, buf: np.ndarray, fold: bool = False):
        n = len(buf)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((_folded() if fold else _letters())[buf] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of buf[start:end]; equal for equal bytes wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def words(buf: np.ndarray, off: np.ndarray, letters: np.ndarray | None = None):
    """(start, end, first word of each text and the end) of the words of every text.

    ``letters`` marks the bytes that words are made of; all but spaces if it is None.
    """
    n = len(buf)
    is_word = ~SPACES[buf] if letters is None else letters[buf]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    heads = off[:-1]
    before[heads[heads < n]] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    tails = off[1:] - 1
    after[tails[tails >= 0]] = False
    end = np.flatnonzero(is_word & ~after) + 1
    return start, end, np.searchsorted(start, off)


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 2, 2, … : the owner of each of the counted things."""
    return np.repeat(np.arange(len(counts)), counts)


def inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, 0, 0, 1, … : the place of each thing within its owner."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def column(values, kind) -> pa.Array:
    return pa.array(values, type=kind)


def packed(numbers: np.ndarray) -> bytes:
    """Differences as byte planes: runs and rising numbers then compress to little."""
    steps = np.diff(numbers, prepend=numbers.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def unpacked(cells, dtype) -> np.ndarray:
    """The numbers of many packed cells as one array."""
    size = np.dtype(dtype).itemsize
    parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel(),
                       dtype=dtype) for b in cells if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def packed_runs(numbers: np.ndarray) -> bytes:
    """64-bit numbers that repeat in runs: how many runs, their numbers, their lengths."""
    starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(numbers)]).astype(np.int32)
    return np.int32(len(starts)).tobytes() + numbers[starts].tobytes() + packed(lengths)


def unpacked_runs(cells, dtype=np.int64) -> np.ndarray:
    """The numbers of many cells of packed runs as one array."""
    parts = []
    for b in cells:
        if b:
            n = int(np.frombuffer(b, np.int32, 1)[0])
            parts.append(np.repeat(np.frombuffer(b, dtype, n, 4), unpacked([b[4 + 8 * n:]], np.int32)))
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def dealt(part: np.ndarray, n_parts: int, columns: list[np.ndarray], pack=None):
    """(part, bytes of each column) for every part that has entries, in entry order.

    ``pack`` names a function to bytes for each column.
    """
    pack = pack or [np.ndarray.tobytes] * len(columns)
    order = np.argsort(part.astype(np.uint16) if n_parts <= 65536 else part, kind="stable")
    counts = np.bincount(part, minlength=n_parts)
    ends = np.cumsum(counts)
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(counts):
        held = [c[ends[p] - counts[p]:ends[p]] for c in columns]
        yield int(p), [to_bytes(c) for c, to_bytes in zip(held, pack)]


def joined(cells, dtype) -> np.ndarray:
    """The numbers of many binary cells as one array."""
    parts = [np.frombuffer(b, dtype) for b in cells if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def runs(keys: np.ndarray):
    """(order, starts, lengths) of the equal keys of an array."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    return order, starts, np.diff(np.r_[starts, len(held)])
