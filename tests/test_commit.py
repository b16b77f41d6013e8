"""Stages committed by a manifest that is written last."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandvote.plans import commit


def test_unfinished_changed_and_unreadable_stages(spark, tmp_path):
    made = []

    def make(n):
        return lambda: made.append(n) or spark.range(n)

    todo = commit.Stages(spark, str(tmp_path))
    first = todo.once("a", make(3), {"x": 1}, ("in",))
    assert first.df.count() == 3 and todo.once("a", make(4), {"x": 1}, ("in",)).id == first.id and made == [3]
    # a stopped attempt: rows, but no manifest
    spark.range(9).write.parquet(str(tmp_path / "b" / "data-left"))
    assert todo.once("b", make(5)).df.count() == 5 and not (tmp_path / "b" / "data-left").exists()
    with pytest.raises(commit.StaleStage, match="settings"):
        todo.once("a", make(6), {"x": 2}, ("in",))
    with pytest.raises(commit.StaleStage, match="inputs"):
        todo.once("a", make(6), {"x": 1}, ("other",))
    again = commit.Stages(spark, str(tmp_path), "rerun").once("a", make(7), {"x": 2}, ("in",))
    assert again.df.count() == 7 and again.id != first.id and made == [3, 5, 7]
    assert len(list((tmp_path / "a").glob("data-*"))) == 1
    # a manifest whose table is gone is an error and is not overwritten
    manifest = json.loads((tmp_path / "a" / "manifest.json").read_text())
    (tmp_path / "a" / manifest["data"]).rename(tmp_path / "gone")
    with pytest.raises(PySparkException):
        todo.once("a", make(8), {"x": 2}, ("in",)).df.count()
    assert made == [3, 5, 7]
    with pytest.raises(ValueError, match="stale"):
        commit.Stages(spark, str(tmp_path), "never")


def test_a_stage_that_fails_is_not_committed(spark, tmp_path):
    todo = commit.Stages(spark, str(tmp_path))
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("stopped")).cast("long")).alias("id"))
    with pytest.raises(PySparkException, match="stopped"):
        todo.once("c", lambda: bad)
    assert not (tmp_path / "c" / "manifest.json").exists()
    assert todo.once("c", lambda: spark.range(2)).df.count() == 2
    with pytest.raises(ValueError, match="no rows"):
        todo.once("d", lambda: spark.range(0), strict=True)
    assert not (tmp_path / "d" / "manifest.json").exists() and todo.once("d", lambda: spark.range(0)).df.count() == 0


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "pos long, seq string")
    same = df.select("seq", "pos").repartition(3)
    assert commit.fingerprint(df) == commit.fingerprint(same)
    others = [df.limit(2), df.withColumn("pos", F.col("pos") + 1), df.withColumnRenamed("seq", "s"), df.unionByName(df), df.limit(0)]
    assert len({commit.fingerprint(x) for x in [df, *others]}) == 6
