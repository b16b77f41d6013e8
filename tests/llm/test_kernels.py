from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strandvote.llm import kernels as k
from strandvote.llm import line_dedup, near_dedup, stats

TEXTS = st.lists(st.text(alphabet="ab \n\té#A9.", max_size=60), max_size=8)


def split(s: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", s)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_counts(texts):
    for part in k.slices(pa.array(texts, pa.string()), 50):
        own = texts[part.first : part.last]
        w, s = k.words(part), stats.measure(part)
        for i, text in enumerate(own):
            want = split(text)
            got = [part.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert got == want
            assert s.word_chars[i] == sum(map(len, want)) and s.n_symbols[i] == sum(c in "#*$%&|<>" for c in text)
            lines = [x for x in text.split("\n") if split(x)]
            assert s.n_lines[i] == len(lines) and s.n_dup_lines[i] == len(lines) - len(set(lines))
            grams = [tuple(want[j : j + 5]) for j in range(len(want) - 4)]
            covered = {j + d for j, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
            assert s.n_repeat_words[i] == len(covered)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_lines(texts):
    for part in k.slices(pa.array(texts, pa.string()), 50):
        text, number, hashes, n = line_dedup.line_table(part)
        want = [(i, j, line) for i, t in enumerate(texts[part.first : part.last]) for j, line in enumerate(t.split("\n")) if split(line)]
        assert [(a, b) for a, b, _ in want] == list(zip(text.tolist(), number.tolist(), strict=True))
        assert n.tolist() == [len(split(line)) for _, _, line in want]
        same = {}
        for h, (_, _, line) in zip(hashes.tolist(), want, strict=True):
            assert same.setdefault(line, h) == h
        assert len(set(same.values())) == len(same)


def test_slices_of_views_nulls_and_large_offsets():
    array = pa.array(["aa", None, "é b", "c" * 100], pa.string())
    for column in (array, array.slice(1), array.cast(pa.large_string())):
        got = [p.text(i).decode() for p in k.slices(column, 4) for i in range(len(p))]
        assert got == [x or "" for x in column.to_pylist()]
    assert list(k.slices(array.slice(0, 0))) == []


def test_set_hash_and_signature():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    other = np.unique(np.concatenate((base[:3600], rng.integers(0, 1 << 63, 400, dtype=np.uint64))))
    true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
    assert abs((near_dedup.signature(base) == near_dedup.signature(other)).mean() - true) < 0.08
    assert near_dedup.set_hash(base) == near_dedup.set_hash(base[np.random.default_rng(1).permutation(len(base))])
    assert near_dedup.set_hash(base) != near_dedup.set_hash(base[1:])
