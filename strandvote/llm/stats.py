"""Per-text statistics of a slice, for quality scores and rules."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as k

SYMBOLS = b"#*$%&|<>"
#: Classes of code points by their first byte.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other_ascii", "wide")


def _classes() -> np.ndarray:
    """Matrix from byte to class; continuation bytes of UTF-8 have none, so code points count once."""
    out = np.zeros((256, len(CLASSES)), np.int64)
    for b in range(256):
        if 0x80 <= b < 0xC0:
            continue
        c = bytes([b])
        if b >= 0xC0:
            name = "wide"
        elif c.islower():
            name = "lower"
        elif c.isupper():
            name = "upper"
        elif c.isdigit():
            name = "digit"
        elif k.SPACES[b]:
            name = "space"
        elif c in b".,;:'\"?()-":
            name = "stop"
        elif c in SYMBOLS:
            name = "symbol"
        else:
            name = "other_ascii"
        out[b, CLASSES.index(name)] = 1
    return out


TO_CLASS = _classes()
IN_WORD = TO_CLASS.sum(1) * ~k.SPACES
IS_SYMBOL = TO_CLASS[:, CLASSES.index("symbol")]


@dataclass
class Stats:
    words: k.Words
    bytes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_lines: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    classes: np.ndarray


def byte_histograms(part: k.Slice) -> np.ndarray:
    out = np.zeros((len(part), 256), np.int64)
    for i in range(len(part)):
        a, b = part.offsets[i], part.offsets[i + 1]
        if b > a:
            out[i] = np.bincount(part.data[a:b], minlength=256)
    return out


def lines(part: k.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the \\n-split lines that are not empty."""
    n = len(part.data)
    breaks = np.flatnonzero(part.data == 10)
    start = np.union1d(part.offsets[:-1], breaks + 1)
    start = start[start < n]
    text = np.searchsorted(part.offsets, start, "right") - 1
    at = np.searchsorted(breaks, start)
    end = np.minimum(np.append(breaks, n)[at], part.offsets[text + 1])
    some = end > start
    return start[some], end[some], text[some]


def duplicate_lines(part: k.Slice) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word, and those of them that equal an earlier line of their text."""
    start, end, text = lines(part)
    inside = np.concatenate(([0], np.cumsum(~k.SPACES[part.data], dtype=np.int64)))
    some = inside[end] > inside[start]
    start, end, text = start[some], end[some], text[some]
    all_lines = np.bincount(text, minlength=len(part))
    if not len(start):
        return all_lines, np.zeros(len(part), np.int64)
    key = k.mix(k.span_hash(part.data, start, end) + text.astype(np.uint64) * k._BASE)
    _, first = np.unique(key, return_index=True)
    return all_lines, all_lines - np.bincount(text[first], minlength=len(part))


def measure(part: k.Slice) -> Stats:
    w, hist = k.words(part), byte_histograms(part)
    n_lines, n_dup_lines = duplicate_lines(part)
    return Stats(w, hist, w.count, hist @ IN_WORD, hist @ IS_SYMBOL, n_lines, n_dup_lines, k.repeated_words(w), hist @ TO_CLASS)
