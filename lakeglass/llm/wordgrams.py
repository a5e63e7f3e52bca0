"""Character n-grams of distinct words, hashed into buckets, for whole blocks at once."""

from __future__ import annotations

import numpy as np

from lakeglass.llm.textbatch import _BASE, _BYTE, Words, mix

#: Stands for the edges of a word; bytes below 32 never occur inside words.
_EDGE = 1


def distinct(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one occurrence of each distinct word, distinct number of each word)."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return first, inverse


def gram_buckets(words: Words, which: np.ndarray, sizes: tuple[int, ...], n_buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buckets of the n-grams of the words ``which``, edge marks included.

    Returns the start of each word in the position axis and, for each n-gram size,
    the bucket at each position; ``n_buckets`` where no n-gram starts.  The words'
    starts are strictly increasing, so ``np.add.reduceat`` sums by word.
    """
    start, size = words.start[which], words.end[which] - words.start[which]
    room = size + 2
    begin = np.cumsum(room) - room
    total = int(room.sum())
    owner_begin = np.repeat(begin, room)
    inner = np.arange(total) - owner_begin
    left = np.repeat(room, room) - inner
    source = np.repeat(start, room) + inner - 1
    edge = (inner == 0) | (left == 1)
    data = np.where(edge, np.uint8(_EDGE), words.buf[np.where(edge, 0, source)])
    code = _BYTE[data]
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(total, dtype=np.uint64)
        for n in range(1, max(sizes) + 1):
            shifted = np.zeros(total, dtype=np.uint64)
            shifted[: max(0, total - n + 1)] = code[n - 1 :]
            h = h * _BASE + shifted
            if n in sizes:
                b = (mix(h + np.uint64(n)) % np.uint64(n_buckets)).astype(np.int64)
                b[left < n] = n_buckets
                if n == 1:
                    b[edge] = n_buckets
                out.append(b)
    return begin, out
