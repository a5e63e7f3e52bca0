"""Vectorised word splitting and hashing over blocks of texts.

A block of texts is joined into one byte buffer, so that finding words, hashing
them and hashing runs of words are a handful of numpy passes instead of a Python
loop over words.  All hashes are 64 bit and depend only on the bytes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Texts are handled in blocks of about this many characters to bound memory.
BLOCK_CHARS = 500_000

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_POWERS = np.ones(1, dtype=np.uint64)

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True

#: ASCII letters and every byte of a multi-byte character count as letters.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, dtype=np.uint64)
            p[0] = 1
            _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a block of texts, in order.

    ``buf`` holds the bytes, ``start``/``end`` the byte range of each word,
    ``doc`` the index of its text and ``first`` the first word of each text
    (one more entry than texts).
    """

    def __init__(self, texts: list[str | None], inside: np.ndarray, lower: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        offsets = np.concatenate(([0], np.cumsum(lengths)))[: len(raw) + 1]
        if lower:
            buf = LOWER[buf]
        word = inside[buf]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.buf = buf
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))
        self.n_texts = len(raw)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        return hash_ranges(self.buf, self.start, self.end)

    def text(self, i: int) -> str:
        return bytes(self.buf[self.start[i] : self.end[i]]).decode("utf-8", "replace")


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; the ranges must be disjoint, ordered and not empty."""
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    inner = np.arange(total) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        terms = _BYTE[buf[np.repeat(start, size) + inner]] * _powers(int(size.max()))[inner]
        return mix(np.add.reduceat(terms, first) + size.astype(np.uint64) * _STEP)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive entries (``len(h) - n + 1`` of them)."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for j in range(n):
            out = out * _BASE + h[j : len(h) - n + 1 + j]
        return mix(out)


def blocks(column: pa.Array | pa.ChunkedArray, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Cut a text column into blocks of bounded size: (index of first row, texts)."""
    block: list[str | None] = []
    begin = size = 0
    for i, value in enumerate(column):
        text = value.as_py()
        if block and size + len(text or "") > block_chars:
            yield begin, block
            block, begin, size = [], i, 0
        block.append(text)
        size += len(text or "") + 1
    if block:
        yield begin, block


def release() -> None:
    """Give memory that is free back to the system; workers live on between tasks and share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: What this worker keeps from task to task, by its key: one thing at most.
_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, kept by this worker until work that keeps something else, or nothing, comes along."""
    if key not in _kept:
        keep_only(key)
        _kept[key] = make()
    return _kept[key]


def keep_only(key: Any) -> None:
    """Drop what this worker keeps under another key."""
    if _kept and key not in _kept:
        _kept.clear()
        release()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: Any = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a partition's batches, which releases memory at its end.

    ``keeps`` is the key of what it takes from ``kept``; workers live on with other work,
    so anything else that earlier work left is dropped first.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
