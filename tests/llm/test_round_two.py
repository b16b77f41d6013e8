"""Cases that earlier versions got wrong: colliding lines, tails held by later copies, clashing columns, template heads."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline
from strandvote.llm import kernels as k
from strandvote.llm import licenses, line_dedup, stats


def thue_morse(n, letters):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join(letters[x] for x in out[:n])


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_lines_of_thue_morse_differ(n):
    one, two = thue_morse(n, "ab"), thue_morse(n, "ba")
    (part,) = k.slices(pa.array([f"{one}\n{two}\n{one}"]))
    assert len(set(k.words(part).hash.tolist())) == 2 and stats.duplicate_lines(part)[1].tolist() == [1]


def test_long_spans_depend_on_each_byte():
    base = bytes(range(65, 91)) * 60
    texts = [base, base[:700] + b"!" + base[701:], base[:-1], base[8:] + base[:8]]
    (part,) = k.slices(pa.array([b" ".join(texts).decode()]))
    assert len(set(k.words(part).hash.tolist())) == 4


def test_a_tail_in_the_second_holder(make):
    five = "\n".join(" ".join(f"a{i}b{j}" for j in range(10)) for i in range(5))
    rows = [(1, five), (2, f"{five}\ntail of three"), (3, f"{five}\ntail of three")]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeats(make(rows)).collect()}
    assert got == {1: [], 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3, 4, 5]}


def test_regions_at_a_template_head():
    a = licenses.compile_template("x", "[[the]] {{2}} mit license")
    assert a.before == 3 and len(a.head) == 2 and a.run(licenses.hashes("the one two mit license"))[0] == 5
    with pytest.raises(ValueError, match="mandatory"):
        licenses.compile_template("x", "[[the]] {{2}}")


def test_columns_named_like_internal_ones(spark, make, sf_dir):
    docs = make([(1, "one two three four five six seven eight"), (2, "a text of other words that stands alone here")], extra=False)
    names = ("_node", "_wording", "wording", "_copies", "_copy", "copies", "uid", "UID_", "whole", "cut", "_salt", "prefix", "documents", "row", "h")
    for name in names:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.benchmark_leaks, corpus_pipeline.source_mix):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {r["_node"] for r in out.collect()} <= {"x"}
