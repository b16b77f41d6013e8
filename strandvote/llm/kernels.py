"""Vectorised text kernels over Arrow string buffers, for use inside mapInArrow tasks.

A batch is cut into slices of about SLICE bytes of whole texts; each kernel works on one slice of
concatenated UTF-8 bytes with document offsets, so no Python string is made for a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Blocks of 8 bytes of a span that are hashed side by side with those of other spans; longer spans go one by one.
_SIDE = 64
#: Masks of the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Factors of the words of a window.
PLACE = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words made of ASCII letters, digits and any non-ASCII character.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(first: int, last: int) -> np.ndarray:
    """Odd factors of the blocks first to last - 1 of a span."""
    return mix(np.arange(first + 1, last + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


@dataclass
class Slice:
    """Whole texts of rows first to last: concatenated bytes and offsets from 0."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def __len__(self) -> int:
        return self.last - self.first

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag or number per byte, by text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Slice]:
    """Cut a string column into slices; null texts have no bytes. A longer single text is a slice of its own."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice: byte ranges, 64-bit hashes, and first[i]:first[i + 1], the words of text i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left(self) -> np.ndarray:
        """By word: words from it to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: each block of 8 bytes is mixed with its place, and the sum is mixed once more.

    A polynomial modulo 2**64 would be cheaper, but lines built on the Thue-Morse sequence collide in it
    whatever the base; here each block passes a bijection that isn't linear first.
    """
    size = end - start
    blocks = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = np.zeros(len(start), np.uint64)
    todo, factors = np.flatnonzero(size > 0), _factors(0, _SIDE)
    at, left = start[todo], size[todo]
    for c in factors:
        if not len(todo):
            break
        out[todo] += mix(blocks[at] & _FIRST[np.minimum(left, 8)] ^ c) * c
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i, a, n in zip(todo.tolist(), at.tolist(), left.tolist(), strict=True):
        own = np.zeros(-(-n // 8) * 8, np.uint8)
        own[:n] = data[a : a + n]
        c = _factors(_SIDE, _SIDE + len(own) // 8)
        out[i : i + 1] += (mix(own.view("<u8") ^ c) * c).sum()
    return mix(out + size.astype(np.uint64))


def words(part: Slice, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data = LOWER[part.data] if lower else part.data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(part) + 1, np.int64))
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, span_hash(data, start, end), np.searchsorted(start, part.offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size words from each word on; only those with enough words left mean anything."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        out[: n - k] += hashes[k:] * PLACE[k]
    return mix(out + np.uint64(size))


def repeated_words(w: Words, size: int = 5) -> np.ndarray:
    """By text: words in windows of size words that its text holds twice or more, the first included."""
    n, text = len(w.start), w.text_of()
    at = np.flatnonzero(w.left() >= size)
    if not len(at):
        return np.zeros(len(w.first) - 1, np.int64)
    key = mix(windows(w.hash, size)[at] + text[at].astype(np.uint64) * _BASE)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    cover = np.zeros(n + 1, np.int64)
    cover[twice] += 1  # a word starts one window
    np.subtract.at(cover, twice + size, 1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(text[covered], minlength=len(w.first) - 1)


def shingles(w: Words, i: int, window: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct shingles of text i; window: windows(w.hash, size). Shorter texts have one, of all their words."""
    a, b = w.first[i], w.first[i + 1]
    if b - a >= size:
        return np.unique(window[a : b - size + 1])
    if b == a:
        return np.zeros(0, np.uint64)
    return windows(w.hash[a:b], int(b - a))[:1]
