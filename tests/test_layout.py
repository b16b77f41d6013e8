"""Bucketed tables meet without an exchange."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strandvote import storage
from strandvote.operators import recompile, voting
from strandvote.plans import layout


@pytest.fixture(scope="module")
def tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    members = spark.range(3000).select((F.col("id") % 100).alias("g"), (F.col("id") % 37).cast("string").alias("header"), F.col("id").alias("pos"))
    bins = spark.range(90).select(F.col("id").alias("g"), (F.col("id") % 5).cast("int").alias("bin_1"))
    source = spark.range(30).select(F.col("id").cast("string").alias("header"))
    yield members, bins, source, layout.bucketed(members, ["g"], 4), layout.bucketed(bins, ["g"], 4), layout.bucketed(source, ["header"], 4)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_of_groups_need_no_exchange(tables):
    members, bins, _, m, b, _ = tables
    pairs = [
        (voting.pair_groups_structures(m, b, ["g"]), voting.pair_groups_structures(members, bins, ["g"])), (voting.cast_votes(m, b, None, ["g"], ["bin_1"]), voting.cast_votes(members, bins, None, ["g"], ["bin_1"])),
        (recompile.groups_of_kept(m, b, ["g"]), recompile.groups_of_kept(members, bins, ["g"])), (recompile.missing_predictions(m.select("g"), b, ["g"]), recompile.missing_predictions(members.select("g"), bins, ["g"])),
    ]
    for one, two in pairs:
        assert exchanges(one) == 0 and exchanges(two) > 0
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


def test_votes_are_dealt_by_header_only(tables):
    members, bins, source, m, b, s = tables
    got = voting.consensus_bin(voting.vote_counts(voting.cast_votes(m, b, s, ["g"], ["bin_1"]), ["bin_1"]), ["bin_1"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" not in plan and "hashpartitioning(header" in plan
    want = voting.consensus_bin(voting.vote_counts(voting.cast_votes(members, bins, source, ["g"], ["bin_1"]), ["bin_1"]), ["bin_1"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_partitions_of_votes_grow_with_them(tables, monkeypatch):
    """One task held the votes of all headers of a fixed number of partitions."""
    monkeypatch.setattr(storage, "DEALT", 100)
    members, bins, source, *_ = tables
    got = voting.consensus_bin(voting.vote_counts(voting.cast_votes(members, bins, source, ["g"], ["bin_1"]), ["bin_1"]), ["bin_1"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(header#\d+, 30\)", plan)) == 2 and not re.search(r"hashpartitioning\(header#\d+, (?!30\))", plan)
    monkeypatch.undo()
    want = voting.consensus_bin(voting.vote_counts(voting.cast_votes(members, bins, source, ["g"], ["bin_1"]), ["bin_1"]), ["bin_1"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
