"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Multipliers of the hash functions.
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = 0x9E3779B97F4A7C15
SPACES = b" \t\n\x0b\x0c\r"

PIECE = 1 << 20   # bytes of text that are hashed at once


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_1
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_2
    return h ^ (h >> np.uint64(33))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    return lower, space, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray, offsets: np.ndarray, tables, powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in ``data``, A-Z as
    a-z, and for each text the index of its first word (one more entry at the end).
    A word is a run of bytes other than space, tab to carriage return; a text's end
    also ends a word. Words are hashed as polynomials over their bytes."""
    lower, space, value = tables
    up, down = powers
    word = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    first = np.flatnonzero(word & (~before | edge[:-1]))
    last = np.flatnonzero(word & (~after | edge[1:]))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[lower[data]] * up[:len(data)], out=sums[1:])
    hashes = mix((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, as a sorted array;
    with fewer words the whole sequence as one shingle, without words (or null)
    an empty array."""
    tables = _tables()
    texts = column.cast(pa.large_binary())
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    empty = np.zeros(0, dtype=np.uint64)
    powers = _powers(1)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(starts, starts[row] + PIECE, side="right")) - 1)
        to = min(to, len(texts))
        part, offsets = data[starts[row]:starts[to]], starts[row:to + 1] - starts[row]
        if not len(part):
            yield from (empty for _ in range(row, to))
            row = to
            continue
        if len(powers[0]) < len(part):
            powers = _powers(max(len(part), PIECE))
        words, at = word_hashes(part, offsets, tables, powers)
        if len(words) >= width:
            n = len(words) - width + 1
            whole = words[:n]
            for k in range(1, width):
                whole = mix(whole * np.uint64(BASE) + words[k:k + n])
        for i in range(to - row):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= width:
                yield distinct(whole[a:b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for h in words[a:b]:
                        short = mix(np.array([short * np.uint64(BASE) + h], dtype=np.uint64))[0]
                yield np.array([short], dtype=np.uint64)
            else:
                yield empty
        row = to


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), dtype=bool)
    keep[:1] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]
