"""The manifest against a plain tree, and ranks against a sort."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandvote.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    parts = [doc_id, source, lang, n_chars, text]
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for at, (s, t) in enumerate(zip(names, trees, strict=True)):
        for i, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = way(t, i) + way(top, at)
            start = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None:
                start = leaf_of(row, row[1].replace("\n", ""))
            for before, after in path:
                start = h(before + start + after)
            out.append((row[0], leaf, t[-1][0], top[-1][0], h("".join(b + a for b, a in path)), start, start == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, rows, tmp_path, name):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({"gid": F.lit("x"), "place": F.lit("x"), "row": F.lit("x"), "leaf": F.lit("x")}).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    out = merkle.op13_bitmap_rank_merkle(spark, f"{tmp_path}/{name}")
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_equals_a_plain_tree(spark, tmp_path):
    """A source of several blocks, lone leaves, sparse and negative ids, and 30 sources."""
    rng = random.Random(3)
    rows = [(i, f"a\ntext {i}" * (i % 3), "en", "hot", i) for i in range(700)]
    rows += [(rng.randint(-(2**63), 2**63 - 1), f"sparse\n{i}", None, "wide", None) for i in range(90)]
    rows += [(5000 + i, "x" if i % 2 else "x\ny", "de", f"s{i % 30}", 1) for i in range(60)] + [(2**63 - 1, "last", "en", "wide", 4), (-(2**63), "first", "en", "wide", 4)]
    assert result(spark, rows, tmp_path, "a") == plain(rows)


def test_nulls_repeats_and_ties(spark, tmp_path):
    """Null ids, sources and texts; one id with many texts; rows alike in all columns, a third of all."""
    rows = [(None, f"n{i % 4}", "en", "s", 1) for i in range(12)] + [(7, f"tie\n{i}", "en", "s", 1) for i in range(100)] + [(9, "same\nrow", "en", "s", 1)] * 60
    rows += [(i, None, None, None, None) for i in range(5)] + [(8, "", "en", "s", 0), (10, "é\n", "fr", None, 2), (11, "z" * 100_000 + "\n", "fr", "", 2)]
    assert result(spark, rows, tmp_path, "a") == plain(rows)


def test_one_row_and_none(spark, tmp_path):
    one = [(4, "a\nb", "en", "s", 3)]
    got = result(spark, one, tmp_path, "one")
    assert got == plain(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert result(spark, one[:0], tmp_path, "none") == []


@pytest.mark.parametrize("kind", ["dense", "sparse", "repeated"])
def test_ranks_equal_a_sort(spark, kind):
    rng = random.Random(5)
    keys = {"dense": list(range(-70_000, 70_000, 7)), "sparse": [rng.randint(-(2**63), 2**63 - 1) for _ in range(3000)], "repeated": [rng.randint(0, 400) for _ in range(3000)]}[kind]
    df = spark.createDataFrame([(g, k) for k in keys for g in (1, 2) if g == 1 or k % 3], "g long, k long").repartition(4)
    got = merkle.ranked(df, ["g"], "k").collect()
    for g in (1, 2):
        own = sorted(r["k"] for r in got if r["g"] == g)
        first = {}
        for i, k in enumerate(own):
            first.setdefault(k, i)
        assert all(r["rank"] == first[r["k"]] and r["_tied"] == (own.count(r["k"]) > 1 if kind == "repeated" else False) for r in got if r["g"] == g)
