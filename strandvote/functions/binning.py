"""Bins by edges (B1-B4): the number of edges not above a value, as an expression.

Edges are computed as the value of each position, with the last one set to the upper bound itself, so
values on an edge fall where they should; width_bucket rounds otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def edges(lo: float | Column, hi: float | Column, n: int) -> Column:
    """n + 1 evenly spaced edges from lo to hi."""
    lo, hi = _d(lo), _d(hi)
    step = (hi - lo) / F.lit(float(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.when(k == n, hi).otherwise(k * step + lo))


def digitize(value: str | Column, edge_array: Column) -> Column:
    """How many edges are at or below value; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNotNull(), F.size(F.filter(edge_array, lambda e: e <= v)))


def _bounds(df: DataFrame, metrics: list[str], lo: float | None, hi: float | None) -> DataFrame:
    """One row with lo_i and hi_i of each metric, given or from the data."""
    out = []
    for i, m in enumerate(metrics, 1):
        out += [(F.min(m) if lo is None else F.lit(float(lo))).cast("double").alias(f"lo_{i}"), (F.max(m) if hi is None else F.lit(float(hi))).cast("double").alias(f"hi_{i}")]
    return df.agg(*out) if lo is None or hi is None else df.sparkSession.range(1).select(*out)


def bounds(df: DataFrame, metric: str) -> DataFrame:
    """Least and largest value of a metric."""
    return df.agg(F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi"))


def bin_even(df: DataFrame, metrics: list[str], n: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Columns bin_1.. from 0; the largest value lands in bin n. With given bounds a value outside them is an error."""
    limits = _bounds(df, metrics, lo, hi)
    out = df.crossJoin(F.broadcast(limits))  # one row
    for i, m in enumerate(metrics, 1):
        b = digitize(m, edges(F.col(f"lo_{i}"), F.col(f"hi_{i}"), n)) - 1
        if lo is not None or hi is not None:
            outside = F.col(m).isNotNull() & ((F.col(m) < F.col(f"lo_{i}")) | (F.col(m) > F.col(f"hi_{i}")))
            b = F.when(outside, F.raise_error(F.lit(f"{m} has a value outside the given bounds")).cast("int")).otherwise(b)
        out = out.withColumn(f"bin_{i}", b)
    return out.drop(*limits.columns)


def bin_1d(df: DataFrame, metric: str, n: int = 20, lo: float | None = None, hi: float | None = None, strict: bool = False) -> DataFrame:
    """B1. strict: no rows are an error."""
    if strict and df.isEmpty():
        raise ValueError(f"no rows to bin by {metric}")
    return bin_even(df, [metric], n, lo, hi)


def bin_2d(df: DataFrame, metrics: list[str], n: int = 10) -> DataFrame:
    """B3."""
    return bin_even(df, metrics[:2], n)


def bin_3d(df: DataFrame, metrics: list[str], n: int = 10) -> DataFrame:
    """B4."""
    return bin_even(df, metrics[:3], n)


def bin_focused(df: DataFrame, metric: str, n: int, lo: float | None = None, hi: float | None = None, strict: bool = False) -> DataFrame:
    """B2: bin_1 from 1 to n inside [lo, hi); 0 below, n + 1 from hi on. strict: no rows are an error."""
    if strict and df.isEmpty():
        raise ValueError(f"no rows to bin by {metric}")
    limits = _bounds(df, [metric], lo, hi)
    inside = digitize(metric, edges(F.col("lo_1"), F.col("hi_1"), n))
    b = F.when(F.col(metric) < F.col("lo_1"), 0).when(F.col(metric) > F.col("hi_1"), n + 1).otherwise(inside)
    return df.crossJoin(F.broadcast(limits)).withColumn("bin_1", b).drop(*limits.columns)


def histogram_bin(value: str | Column, edge_array: Column, n: int) -> Column:
    """1 to n with the last bin closed; null outside the edges."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.least(digitize(v, edge_array), F.lit(n))
    return F.when((at >= 1) & (v <= F.element_at(edge_array, -1)), at)
