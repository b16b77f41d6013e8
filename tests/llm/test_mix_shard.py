"""Mixing (4), sharding (8) and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandvote.llm import mixing, sharding
from strandvote.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by repeated resharing."""
    total, out, free = share * sum(sizes), {}, list(range(len(sizes)))
    while free:
        left, w = total - sum(out.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w >= most * sizes[i]]
        if not over:
            return [out.get(i, left * weights[i] / w) for i in range(len(sizes))]
        out |= {i: most * sizes[i] for i in over}
        free = [i for i in free if i not in over]
    return [out[i] for i in range(len(sizes))]


def test_targets_and_thresholds(spark, make):
    rng = np.random.default_rng(0)
    rows, sizes = [], []
    for s, n in enumerate((400, 30, 90, 5, 60, 1)):
        words = rng.integers(1, 40, n)
        sizes.append(int(words.sum()))
        rows += [(len(rows) + i, "w " * int(k), "en", f"s{s}" if s < 5 else None) for i, k in enumerate(words)]
    base = mixing.sizes(make(rows)).cache()
    got = mixing.mix(base).toPandas()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    want = fill(sizes, [5, 2, 1, 5, 2, 1])
    assert by["target"].to_numpy() == pytest.approx(want)
    assert ((by["taken"] - by["target"]).abs() <= by["most"] / 2 + 1e-9).all() and (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(mixing.sizes(make(rows).repartition(11))).toPandas()
    assert_same(got.drop(columns="h"), again.drop(columns="h"))


def test_budgets_are_nested(make):
    rows = [(i, "w " * (1 + i % 7), "en", "s") for i in range(300)]
    base = mixing.sizes(make(rows)).cache()
    goal = lambda t: base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.lit(float(t)))
    cuts = [mixing.thresholds(base, goal(t)).first() for t in (10, 100, 600, 1000)]
    assert all(c["whole"] == 0 for c in cuts) and [c["cut"] for c in cuts] == sorted(c["cut"] for c in cuts)


def test_mix_of_odd_rows(odd, nothing):
    got = mixing.mix(mixing.sizes(odd)).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] and r["target"] is not None for r in got)
    assert mixing.mix(mixing.sizes(nothing)).count() == 0
    assert mixing.mix(mixing.sizes(odd.where("doc_id < 4"))).agg(F.sum("taken")).first()[0] == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 24, 97, 1000])
def test_permutation_round_trip(n):
    x = np.arange(n)
    p = sharding.permute(x, n)
    assert sorted(p) == list(x) and (sharding.permute(p, n, inverse=True) == x).all()
    assert n < 20 or (p != sharding.permute(x, n, key=5)).any()
    a, b = sharding.sides(n)
    assert a * b >= n and a * b - n < max(2, n**0.5 + 1)


def test_permutation_mixes():
    p = sharding.permute(np.arange(10_000), 10_000)
    assert abs(np.corrcoef(np.arange(10_000), p)[0, 1]) < 0.05 and (np.diff(p) == 1).sum() < 20


def test_shards_of_odd_rows(odd, nothing):
    got = sharding.sharded(odd, shards=5).toPandas()
    counts = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    assert got[got["doc_id"] == 1]["size"].tolist() == [8] and got[got["doc_id"] == 1]["text_crc32"].tolist() == [0]
    again = sharding.sharded(odd.repartition(9), shards=5).toPandas()
    assert_same(got, again)
    assert sharding.sharded(nothing).count() == 0


def test_pipeline_stages(spark, sf_dir):
    corpus = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "source mix", "shards"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for i, (name, stage) in enumerate(corpus.STAGES):
        docs = corpus.written(stage(spark, docs, sf_dir), f"test-{i}")
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0.7 * before < docs.count() <= before and docs.select("doc_id").distinct().count() == docs.count(), name
    assert_same(docs.toPandas(), corpus.run(spark, sf_dir).toPandas())
