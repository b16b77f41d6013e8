"""Near-duplicates (5), repeated lines (2) and components."""

from __future__ import annotations

import random
import re

import pytest

from strandvote.llm import components, line_dedup, near_dedup


def sets_of(rows):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    return out


def brute(rows):
    """component_id by comparing every two rows."""
    sets, up = sets_of(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(rows))]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def family(rng, rows, size, edits, start, length=120):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for i in range(size):
        rows.append((start + i, " ".join(edited(base, rng.choice(edits), rng))))


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_equal_brute_force(make, seed):
    """Groups with copies far inside, at and beyond the limit; the larger ones go through shared differences."""
    rng, rows = random.Random(seed), []
    family(rng, rows, 90, [0, 1, 2, 3], 0)
    family(rng, rows, 70, [1, 2, 6], 200)
    family(rng, rows, 40, [4, 5], 400)
    # variants of variants share edits
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for g in range(4):
        shared = edited(base, 4, rng)
        rows += [(600 + g * 50 + i, " ".join(edited(shared, rng.choice([1, 2, 3]), rng))) for i in range(35)]
    rows += [(900 + i, " ".join(f"r{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 40)))) for i in range(30)]
    rng.shuffle(rows)
    want = dict(zip([d for d, _ in rows], brute(rows), strict=True))
    got = {r["doc_id"]: r for r in near_dedup.grouped(make(rows)).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for (d, _), s in zip(rows, sets_of(rows), strict=True)}


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = near_dedup.grouped(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"] and by[3]["kept"]
    assert by[4]["n_shingles"] == 1 and (by[7]["component_id"], by[7]["kept"]) == (6, False)
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.grouped(nothing).count() == 0
    out = near_dedup.deduplicated(odd)
    ids = sorted((r["doc_id"] or 0) for r in out.collect())
    assert out.columns == odd.columns and ids == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert near_dedup.deduplicated(nothing).count() == 0


def test_one_id_with_two_texts(make):
    docs = make([(1, "a b c d e f g"), (1, "completely different words stand in this other text"), (2, "a b c d e f g")])
    assert sorted(r["text"][:3] for r in near_dedup.deduplicated(docs).collect()) == ["a b", "com"]


def test_bayes_rule_rarely_misses():
    rule = dict(near_dedup.least_matches())
    assert set(rule) == set(range(near_dedup.BATCH, near_dedup.HASHES + 1, near_dedup.BATCH)) and rule[near_dedup.HASHES] > 0.7 * near_dedup.HASHES
    from math import comb

    for n, least in rule.items():
        assert sum(comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(least)) < 1e-4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100, 200} and got[40] == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def least_reachable(edges):
    """Label of every node, by passing the least label along until nothing changes."""
    label = {x: x for edge in edges for x in edge}
    while True:
        moved = False
        for a, b in edges:
            least = min(label[a], label[b])
            moved |= label[a] != label[b]
            label[a] = label[b] = least
        if not moved:
            return label


def test_components_of_random_graphs_and_more_edges(spark):
    rng = random.Random(8)
    for nodes, n, more in ((60, 30, 12), (200, 150, 40), (30, 5, 0), (40, 0, 9)):
        one, two = ([tuple(rng.sample(range(nodes), 2)) for _ in range(m)] for m in (n, more))
        frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
        found = components.components(frame(one))
        assert {r["node"]: r["label"] for r in found.collect()} == least_reachable(one)
        want = least_reachable(one + two)
        assert {r["node"]: r["label"] for r in components.grown(found, frame(two)).collect()} == want


def passage(rng, lines, words=12):
    return ["\n".join(" ".join(f"p{rng.randrange(10**9)}" for _ in range(words)) for _ in range(lines))]


def test_lines_repeat_across_and_inside(make):
    rng = random.Random(1)
    long, short = passage(rng, 6)[0], passage(rng, 3)[0]
    rows = [(1, f"intro one\n{long}\nend one"), (2, f"{long}\nother"), (3, f"a\n{short}\nb"), (4, f"c\n{short}\nd"), (5, f"{long}\n\nmiddle\n{long}"), (6, long), (7, "same\n" * 60 + "tail")]
    got = {r["doc_id"]: r for r in line_dedup.cleaned(make(rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["text"] == "other" and got[2]["words_removed"] == 72
    assert got[3]["n_removed"] == got[4]["n_removed"] == 0  # under the least number of words
    assert got[5]["text"] == "\nmiddle" and got[6]["text"] == "" and got[7]["n_removed"] > 0 and got[7]["text"].endswith("tail")


def test_run_extends_beyond_its_window(make):
    rng = random.Random(2)
    long = passage(rng, 9)[0]
    cut = "\n".join(long.split("\n")[1:8])
    got = {r["doc_id"]: r for r in line_dedup.cleaned(make([(1, long), (2, f"x\n{cut}\ny")])).collect()}
    assert got[2]["text"] == "x\ny" and got[1]["n_removed"] == 0


def test_lines_of_odd_rows(odd, nothing):
    rows = line_dedup.cleaned(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[1]["n_lines"] == 1 and by[10]["n_lines"] == 4 and by[5]["n_removed"] == 0
    assert line_dedup.cleaned(nothing).count() == 0


def test_repeated_row_keeps_its_first(make):
    text = passage(random.Random(3), 6)[0]
    got = sorted(r["n_removed"] for r in line_dedup.cleaned(make([(1, text), (1, text), (1, text)])).collect())
    assert got == [0, 6, 6]


def test_long_repeated_texts(make):
    """Half of 60,000 lines repeat; cost is by line, not by pairs of lines."""
    half = [f"line {i} of the part that stands twice" for i in range(30_000)]
    text = "\n".join([*half, "between", *half])
    got = line_dedup.cleaned(make([(1, text), (2, "some other line")])).where("doc_id = 1").first()
    assert got["n_removed"] == 30_000 and got["text"] == "\n".join([*half, "between"])
