"""Phrases against a plain count in Python."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest

from strandvote.llm import phrases


def plain(rows, least, most=2000):
    """The contract, word for word."""
    f, n = Counter(), Counter()
    for row in rows:
        text, lang = row[1] or "", (row[2] if len(row) > 2 else "en") or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for lang in n:
        found = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(100 * b >= 50 * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            cuts = [(int(Fraction(1000000 * a * a, f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, name.decode(), -a, left, right, n[lang], -score) for i, (score, a, name, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def result(docs, **more):
    return sorted(tuple(r) for r in phrases.top(*phrases.collocations(docs, **more)).collect())


TEXTS = [
    (1, "New York city. new  york City!\tnew york, city new\nyork"), (2, "NEW york city of the sea; of the land: of the é É", "fr"), (3, None), (4, ""), (5, " \t.,;", None),
    (6, "aa aa aa aa aa aa aa aa aa aa aa aa", None), (6, "aa aa aa aa aa aa aa aa aa aa aa aa", None), (None, "new york city", None), (7, "new york city of the city of the city", "und"), (8, "x" * 3000 + " " + "x" * 3000),
]


@pytest.mark.parametrize("moduli", [phrases.MODULI, (11, 13), (3, 3)])
def test_equals_a_plain_count(make, moduli):
    """With small moduli most runs collide in their fingerprint, and are counted by their text."""
    rows = TEXTS + [(100 + i, "the old sea and the old land " * (i % 5)) for i in range(12)]
    assert result(make(rows), least=3, moduli=moduli) == plain(rows, 3)


def test_odd_rows_and_empty_tables(make, odd, nothing):
    assert phrases.top(*phrases.collocations(nothing)).count() == 0
    got = phrases.top(*phrases.collocations(odd, least=2)).collect()
    assert {r["lang"] for r in got} <= {"en", "und"} and any(r["phrase"] == "word1 word2 word3" for r in got)


def test_runs_across_blocks(make):
    """Many documents of one phrase, in many batches, and one language with most rows."""
    rows = [(i, "alpha beta gamma " + f"word{i % 40}", "en" if i % 3 else "fr") for i in range(600)]
    assert result(make(rows)) == plain(rows, 10)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_999_989, 999_999_999_999_991, 999_999_999_999_997
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.score("a", "l", "r")).first()[0]
    assert got == 1000000 * a * a // (left * right)


def test_powers():
    assert phrases.powers(7, 101, 10).tolist() == [pow(7, i, 101) for i in range(10)]


def test_most_per_language(make):
    rows = [(i, f"a{i % 9} b{i % 9}, c d") for i in range(120)]
    assert len(phrases.top(*phrases.collocations(make(rows)), most=4).collect()) == 4
    assert result(make(rows)) == plain(rows, 10)


def test_packed_runs_take_some_ten_bytes_each():
    """Disk: fingerprints, check values and texts only; a place beside them took an eighth more of what is shuffled."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(300)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(range(100), pa.int64()), pa.array(["en"] * 100), pa.array(texts)], names=["a", "b", "lang", "text"])
    out = list(phrases._packer(1, phrases.MODULI)([batch]))
    packed = [(n, x) for o in out for n, x in zip(o.column("n").to_pylist(), o.column("packed").to_pylist(), strict=True) if x]
    assert sum(n for n, _ in packed) > 80_000
    assert sum(len(x) for _, x in packed) < 10.2 * sum(n for n, _ in packed)
