"""Exact quantiles by brackets: values equal numpy's, and no bracket holds more than it may."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandvote.operators import filters, selection


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(2)
    return {
        "even": rng.normal(size=20_000), "wide": 10.0 ** rng.uniform(-200, 200, 20_000), "ties": rng.integers(0, 3, 20_000).astype(float), "two": np.repeat([1.0, 2.0], 5_000),
        "mixed": np.concatenate([np.zeros(9_000), rng.normal(size=9_000), np.full(2_000, 7.0)]), "few": rng.normal(size=7), "one": np.array([4.0]), "same": np.full(3_000, 2.5),
    }


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = pd.concat([pd.DataFrame({"k": k, "m": v, "w": -v}) for k, v in groups.items()])
    more = spark.createDataFrame([("none", None, None), ("none", float("nan"), 1.0), (None, 3.0, 1.0), (None, 5.0, 1.0)], "k string, m double, w double")
    return spark.createDataFrame(rows).union(more).repartition(5)


@pytest.mark.parametrize("held", [50, 3_000, 1_000_000])
def test_groups_and_columns_together_equal_numpy(frame, groups, held):
    asks = {"low": ("m", 0.2), "mid": ("w", 0.5), "high": ("m", 0.8), "last": ("m", 1.0), "first": ("w", 0.0)}
    got = {r["k"]: r for r in selection.quantiles(frame, asks, ["k"], held).collect()}
    assert set(got) == {*groups, "none", None}
    for k, v in groups.items():
        for name, (c, p) in asks.items():
            assert got[k][name] == pytest.approx(np.quantile(v if c == "m" else -v, p), rel=1e-12, abs=1e-300), (k, name)
    assert got["none"]["low"] is None and got["none"]["mid"] == 1.0 and got[None]["last"] == 5.0 and got[None]["low"] == pytest.approx(3.4)


def test_brackets_hold_few_values(frame):
    """All open brackets end under the limit, and what is summed in order is no more than they hold."""
    rows, targets, held = frame.select("k", F.nanvl("m", F.lit(None).cast("double")).alias("m")), {"a": ("m", 0.5, 0), "b": ("m", 0.37, 1)}, 60
    state = selection.brackets(rows, targets, ["k"], held)
    for r in state.collect():
        for t in targets:
            assert r[f"value_{t}"] is not None or r[f"in_{t}"] <= held
    counts = selection._between(rows, state, targets, ["k"]).groupBy("k", "_t").agg(F.sum("_c").alias("c")).collect()
    assert counts and max(r["c"] for r in counts) <= held


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in [-inf] * 40 + [1.0] * 30 + [inf] * 30], "m double")
    got = selection.quantiles(df, {"a": ("m", 0.1), "b": ("m", 0.5), "c": ("m", 0.9)}, held=5).first()
    assert tuple(got) == (-inf, 1.0, inf)


def test_no_rows(spark, frame):
    assert selection.quantiles(frame.limit(0), {"a": ("m", 0.5)}, ["k"]).count() == 0
    assert selection.quantiles(frame.limit(0), {"a": ("m", 0.5), "b": ("w", 0.1)}).first() == (None, None)


def test_criteria_share_their_passes(frame, monkeypatch):
    """The rounds of six criteria are those of one."""
    calls = []
    monkeypatch.setattr(selection, "stored", lambda df, tag, real=selection.stored: calls.append(tag) or real(df, tag))
    one = [{"name": "m", "method": "above"}]
    many = [*one, {"name": "w", "method": "below"}]
    filters.quantile_thresholds(frame, one, 0.3)
    first = len(calls)
    filters.quantile_thresholds(frame, many, 0.3)
    assert len(calls) == 2 * first
