"""Rows that earlier versions of the training-data operators left out."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from strandvote.llm import decontamination, line_dedup, near_dedup, surrogates
from strandvote.llm import kernels as k


@pytest.mark.parametrize(("n", "least"), [(15, 1.0), (16, 1.0), (19, 1.0), (24, 1.0), (27, 0.96), (40, 0.96)])
def test_edited_copies_are_found_at_every_length(n, least):
    """Copies with as many edits as allowed, of items that share an index with long ones."""
    rng = np.random.default_rng(n)
    word = lambda m: [f"w{x}" for x in rng.integers(0, 10**9, m)]
    index = decontamination.build(list(range(40)), [" ".join(word(n if i < 8 else 50)) for i in range(40)])
    noise = lambda: rng.integers(1, 1 << 63, 20, dtype=np.uint64)
    parts = [np.concatenate((noise(), decontamination._edited(index.items[i % 8], decontamination.allowed(n), rng), noise())) for i in range(240)]
    hashes, first = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
    found = decontamination.leaks(index, k.Words(np.arange(len(hashes)), np.arange(len(hashes)), hashes, first))
    assert np.mean([i % 8 in x for i, x in enumerate(found)]) >= least


def test_short_items_are_found(spark, make):
    """One of 8 words doesn't weaken the search of others; 5 to 7 words allow one edit, fewer none."""
    items = [(1, "zeta"), (2, "alpha beta gamma"), (3, "k l m n o p q"), (4, "one two three four five six seven eight"), (5, "?!"), (6, " ".join(f"v{i}" for i in range(60)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(1, "x Zeta y"), (2, "alpha, beta gamma"), (3, "alpha beta x gamma"), (4, "a k l m x o p q b"), (5, "k l x n y p q"), (6, "one two three four five six seven nine"), (7, "?!"), (8, items[5][1])])
    hits = {r["doc_id"]: [(h["item_id"], h["edits"]) for h in r["hits"]] for r in decontamination.find(docs, benchmark).collect()}
    assert hits == {1: [(1, 0)], 2: [(2, 0)], 3: [], 4: [(3, 1)], 5: [], 6: [(4, 1)], 7: [], 8: [(6, 0)]}


def test_stage_links_from_80_hundredths_on(spark, make):
    """Pairs of similarity 0.80 to 0.85 are one document for the stage and two for op5; those below 0.8 are two."""
    rng, rows, similar = random.Random(4), [], []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = 18 + i % 6  # of 200 shingles each, 200 - cut are shared
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[cut:] + [f"n{rng.randrange(10**9)}" for _ in range(cut)]))]
        similar.append(100 * (200 - cut) >= 80 * (200 + cut))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, make(rows), "").collect()}
    assert 0 < sum(similar) < 40 and kept == {d for d in range(80) if d % 2 == 0 or not similar[d // 2]}
    assert near_dedup.deduplicated(make(rows)).count() == 80


def removed_by_brute_force(rows, least=50):
    """Line numbers in a run of at least so many words that stands in an earlier place too."""
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if x.split()] for _, t in rows]
    out = {}
    for d, own in enumerate(lines):
        gone = set()
        for e in range(d + 1):
            for shift in range(-len(lines[e]) + 1, len(own)):
                if e == d and shift <= 0:
                    continue
                run = []
                for i in range(max(0, shift), len(own) + 1):
                    if i < len(own) and i - shift < len(lines[e]) and own[i][1] == lines[e][i - shift][1]:
                        run.append(own[i])
                        continue
                    if sum(len(x.split()) for _, x in run) >= least:
                        gone |= {j for j, _ in run}
                    run = []
        out[rows[d][0]] = sorted(gone)
    return out


def test_a_later_holder_has_the_tail(make):
    """The first holder of the only whole window holds just the head of the run."""
    head, tail = " ".join(f"h{i}" for i in range(82)), "\n".join(" ".join(f"t{j}x{i}" for i in range(n)) for j, n in enumerate((10, 9, 1, 10)))
    last = tail.rsplit("\n", 1)[0] + "\nanother last line"
    rows = [(1, f"{head}\n{last}"), (2, f"{head}\n{tail}"), (3, f"{head}\n{tail}")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeats(make(rows)).collect()}
    assert got == {1: [], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("seed", [0, 1])
def test_removed_lines_equal_brute_force(make, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"p{i}w{j}" for j in range(rng.choice([1, 5, 12, 30, 60]))) for i in range(12)]
    rows = []
    for d in range(60):
        at = rng.randrange(12)
        some = [pool[(at + i) % 12] for i in range(rng.randrange(0, 9))]
        some = [rng.choice(pool) if rng.random() < 0.15 else x for x in some]
        rows.append((d, "\n".join(x for line in some for x in ([line, ""] if rng.random() < 0.2 else [line]))))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeats(make(rows)).collect()}
    assert got == removed_by_brute_force(rows) and any(got.values())


def test_long_secrets_are_replaced(make):
    old = ["sk-" + "a1B2" * 40, "0123456789abcdef" * 16, "Qx7!" * 60]
    texts = [f"key {old[0]} end", f"key {old[1]} end", f'token = "{old[2]}" end']
    got = {r["doc_id"]: r for r in surrogates.replaced(make(list(enumerate(texts)))).collect()}
    assert all(got[i]["n_entities"] == 1 and x not in got[i]["text"] and len(got[i]["text"]) == len(texts[i]) for i, x in enumerate(old))


def test_every_form_of_a_shape_is_used(spark, monkeypatch):
    """26 one-letter addresses of one domain have 26 surrogates, although random draws seldom end so."""
    monkeypatch.setattr(surrogates, "ROUNDS", 3)
    rows = [(f"{chr(97 + i)}@big-domain.com",) for i in range(26)]
    out = surrogates.cores(surrogates.entities(spark.createDataFrame(rows, "mention string"))).toPandas()
    assert len(out) == 26 and out["core"].nunique() == 26 and not set(out["core"]) & set(out["canon"])
    assert set(out["core"].str[1:]) == {out["core"][0][1:]} and set(out["core"].str[0]) == set("abcdefghijklmnopqrstuvwxyz")
