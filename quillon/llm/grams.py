"""Words and word n-grams of Arrow text columns, as numpy arrays inside a task.

Texts are cut at the ASCII white space bytes, which never occur inside a longer UTF-8 sequence. A batch is
handled in slices of a few megabytes, so memory stays bounded however many rows a batch has; only a single
text longer than a slice makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Slices where much is held beside each word.
SMALL = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    up, down = _powers.get(base, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        up, down = made
        if size <= 4 * SLICE_BYTES:
            _powers[base] = (up, down)
    return up[:n], down[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of values[start:end] for each range, equal for equal contents."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(SECOND_BASE))


@dataclass
class Words:
    """The words of some texts: bytes ``data``; word w of text t for first[t] <= w < first[t + 1]."""

    rows: slice
    data: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_at: np.ndarray

    def hashes(self) -> np.ndarray:
        return ranges(self.data.astype(np.uint64) + np.uint64(1), BYTE_BASE, self.starts, self.ends)

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, as bytes; and where each word begins there (one more: the end)."""
        lengths = self.ends - self.starts
        at = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        out = np.full(at[-1], 32, dtype=np.uint8)
        inside = np.arange(lengths.sum()) + np.repeat(self.starts - (at[:-1] - np.arange(len(lengths))), lengths)
        out[np.arange(len(inside)) + np.repeat(np.arange(len(lengths)), lengths)] = self.data[inside]
        return out, at

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.lengths())


def slices(texts: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column, slice by slice of about ``size`` bytes; null texts have none. lower: A-Z become a-z first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    everything = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        upto = min(upto, len(texts))
        data = everything[offsets[at] : offsets[upto]]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        text_at = offsets[at : upto + 1] - offsets[at]
        inside = ~SPACE[data]
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        before[text_at[:-1][text_at[:-1] < len(data)]] = False
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        after[text_at[1:][text_at[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        yield Words(slice(at, upto), data, np.searchsorted(starts, text_at), starts, ends, text_at)
        at = upto


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of all runs of k words that lie in one text."""
    h = words.hashes()
    at = np.arange(max(0, len(h) - k + 1))
    last = np.repeat(words.first[1:], words.lengths())[: len(at)]
    at = at[at + k <= last]
    return at, ranges(h, WORD_BASE, at, at + k)
