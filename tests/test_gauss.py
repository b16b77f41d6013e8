"""The fast Gauss transform against the sum over all values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from strandvote.operators import distributions


@pytest.mark.parametrize("kind", ["normal", "two", "outlier", "ties", "uniform"])
def test_equals_the_direct_sum(spark, kind):
    rng = np.random.default_rng(8)
    v = {
        "normal": rng.normal(70, 9, 3000), "two": np.array([1.0, 2.0]), "outlier": np.append(rng.normal(size=2000), 1e5), "ties": rng.integers(0, 4, 3000).astype(float), "uniform": rng.uniform(-1e-9, 1e-9, 500),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"m": v})).union(spark.createDataFrame([(None,)], "m double"))
    got = distributions.kde_marginals(df, "m", 200).orderBy("point").toPandas()
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], x, rtol=1e-12, atol=1e-12 * np.abs(x).max())
    assert np.abs(got["density"] - want).max() <= 1e-13 / h


def test_no_values_meet_the_grid(spark):
    """Cost is values and cells: neither a cross join of values nor a sort of them is in the plan."""
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS m")
    plan = distributions.kde_marginals(df, "m")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Generate explode(sequence(_from")  # grid points are met by cells, which are sums already
    assert plan.index("Aggregate [_cell", at) > at and "Generate explode" not in plan[plan.index("Aggregate [_cell", at) :].replace("explode([", "")
    assert distributions.kde_marginals(df.limit(1), "m").count() == 0 and distributions.kde_marginals(df.where("m = 5"), "m").count() == 0
