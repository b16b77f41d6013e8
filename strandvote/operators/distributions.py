"""Tables behind the distribution plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import edges, histogram_bin
from ..functions.text import seed_of
from .filters import confidence, exact_quantile


def _grid(df: DataFrame, edge_array: Column, n: int) -> DataFrame:
    """bin, bin_lo, bin_hi of n bins, from one row that edge_array may use."""
    e = df.select(edge_array.alias("e"))
    return e.select("e", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("bin")).select("bin", F.element_at("e", F.col("bin")).alias("bin_lo"), F.element_at("e", F.col("bin") + 1).alias("bin_hi"))


def step_edges(lo: float, hi: float, step: float) -> Column:
    """lo, lo + step, ... up to and around hi."""
    n = math.ceil((hi + step - lo) / step)
    return F.array(*[F.lit(lo + i * step) for i in range(n)])


def hist_by_iteration(df: DataFrame, metric: str, lo: float, hi: float, step: float, kind: str = "", key: str = "iteration") -> DataFrame:
    """Key, bin, bin_lo, bin_hi and n of every bin of every iteration; kind tmscore fixes 0 to 1 by 0.02."""
    lo, hi, step = (0.0, 1.0, 0.02) if kind == "tmscore" else (lo, hi, step)
    n = math.ceil((hi + step - lo) / step) - 1
    e = step_edges(lo, hi, step)
    counts = df.groupBy(key, histogram_bin(metric, e, n).alias("bin")).agg(F.count("*").alias("n"))
    grid = _grid(df.sparkSession.range(1), e, n)
    every = df.select(key).distinct().crossJoin(F.broadcast(grid))  # n rows
    return every.join(counts, [key, "bin"], "left").select(key, "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"))


def hist_1d(df: DataFrame, metric: str, n: int = 50, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Bin, bin_lo, bin_hi and n; values outside the bounds aren't counted."""
    limits = df.agg((F.min(metric) if lo is None else F.lit(float(lo))).cast("double").alias("_lo"), (F.max(metric) if hi is None else F.lit(float(hi))).cast("double").alias("_hi"))
    e = edges(F.col("_lo"), F.col("_hi"), n)
    counts = df.crossJoin(F.broadcast(limits)).groupBy(histogram_bin(metric, e, n).alias("bin")).agg(F.count("*").alias("n"))
    return _grid(limits, e, n).join(counts, "bin", "left").select("bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("n"))


def bin_distribution(results: DataFrame, n: int | None = None, column: str = "Bin_Assignment") -> DataFrame:
    """D3: bin and sequences of bins 1 to n (by default the largest bin); bin n + 1 counts as n, bin 0 not at all."""
    most = results.agg((F.max(column) if n is None else F.lit(n)).cast("int").alias("_n"))
    rows = results.crossJoin(F.broadcast(most)).where(F.col(column).between(1, F.col("_n") + 1))
    counts = rows.groupBy(F.least(F.col(column), F.col("_n")).alias("bin")).agg(F.count("*").alias("sequences"))
    grid = most.where("_n >= 1").select(F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("sequences", F.lit(0)).alias("sequences"))


def vote_ratios(votes: DataFrame, headers: DataFrame, n: int) -> DataFrame:
    """Header, bin and ratio of bins 1 to n, of all its votes, for the listed headers that have votes."""
    own = votes.join(headers.select("header").distinct(), "header", "left_semi")
    counts = own.groupBy("header", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("header").agg(F.sum("n").alias("total"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return grid.join(counts, ["header", "bin"], "left").select("header", "bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("ratio"))


def scatter_table(df: DataFrame, m1: str, m2: str) -> DataFrame:
    """The two metrics and the confidence that colours them, in its order."""
    return df.select(F.col(m1).alias("m1"), F.col(m2).alias("m2"), confidence(df).alias("confidence")).orderBy("confidence")


#: Width of a cell and farthest distance at which it counts, in bandwidths; terms of an expansion.
CELL, REACH, TERMS = 0.5, 9.0, 16


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the probabilists' Hermite polynomials, from the constant on."""
    out = [[1], [0, 1]]
    for k in range(2, terms):
        up, down = [0, *out[-1]], [(k - 1) * c for c in out[-2]] + [0, 0]
        out.append([a - b for a, b in zip(up, down, strict=True)])
    return out


def kde_marginals(df: DataFrame, metric: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Point, x and density of a Gaussian kernel estimate with Scott's bandwidth on an even grid; no spread gives no curve.

    A fast Gauss transform: values are summed by cells half a bandwidth wide, as moments around the cell's middle,
    and a cell counts at the grid points within nine bandwidths. With t the distance from the middle and u that of
    a grid point, exp(-(u - t)^2 / 2) is exp(-u^2 / 2) times the sum of t^k / k! He_k(u). By Cramer's bound on He_k
    what follows 16 terms is under 1e-16 of a value's weight, and what lies beyond nine bandwidths under 3e-18.
    """
    stats = df.where(F.col(metric).isNotNull()).agg(F.count("*").alias("_n"), F.stddev_samp(metric).alias("_sd"), F.min(metric).cast("double").alias("_lo"), F.max(metric).cast("double").alias("_hi"))
    stats = stats.where("_n > 1 AND _sd > 0").withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    first, last = F.col("_lo") - cut * F.col("_h"), F.col("_hi") + cut * F.col("_h")
    stats = stats.select("_n", "_h", "_lo", first.alias("_first"), ((last - first) / (points - 1)).alias("_step"))
    at = (F.col(metric).cast("double") - F.col("_lo")) / F.col("_h")
    placed = df.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(stats)).select(F.floor(at / CELL).cast("long").alias("_cell"), at.alias("_at"))  # one row
    t = F.col("_at") - (F.col("_cell") + 0.5) * CELL
    moments, power = [], F.lit(1.0)
    for k in range(TERMS):
        moments.append((F.sum(power) / math.factorial(k)).alias(f"_m{k}"))
        power = power * t
    cells = placed.groupBy("_cell").agg(*moments)
    table = _hermite(TERMS)
    factors = [sum((F.col(f"_m{k}") * float(table[k][j]) for k in range(j, TERMS) if table[k][j]), F.lit(0.0)).alias(f"_a{j}") for j in range(TERMS)]
    middle = F.col("_lo") + (F.col("_cell") + 0.5) * CELL * F.col("_h")
    cells = cells.crossJoin(F.broadcast(stats)).select("_h", "_first", "_step", middle.alias("_middle"), *factors)  # one row
    reach = lambda side: (F.col("_middle") + side * REACH * F.col("_h") - F.col("_first")) / F.col("_step")
    near = cells.withColumn("_from", F.greatest(F.lit(0), F.ceil(reach(-1)).cast("int"))).withColumn("_to", F.least(F.lit(points - 1), F.floor(reach(1)).cast("int")))
    near = near.where("_from <= _to").withColumn("_k", F.explode(F.sequence("_from", "_to")))
    x = F.col("_first") + F.col("_k") * F.col("_step")
    near = near.withColumn("_u", (x - F.col("_middle")) / F.col("_h"))
    value = F.col(f"_a{TERMS - 1}")
    for j in range(TERMS - 2, -1, -1):
        value = value * F.col("_u") + F.col(f"_a{j}")
    total = near.groupBy("_k").agg(F.sum(F.exp(-0.5 * F.col("_u") * F.col("_u")) * value).alias("_s"))
    grid = stats.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    density = F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return grid.join(total, "_k", "left").select(F.col("_k").alias("point"), x.alias("x"), density.alias("density"))


def quantile_marker(df: DataFrame, metric: str, kind: str, key: str = "iteration") -> DataFrame:
    """By iteration the 0.2 quantile of an rmsd, else the 0.8 quantile."""
    return df.select(key).distinct().join(exact_quantile(df, metric, 0.2 if kind == "rmsd" else 0.8, [key], "marker"), key, "left")


def summary(df: DataFrame, metric: str) -> DataFrame:
    """A12."""
    return df.agg(F.avg(metric).alias("mean")).crossJoin(F.broadcast(exact_quantile(df, metric, 0.5, name="median")))  # one row


def arm_metrics(pred: DataFrame, control: DataFrame, m1: str, m2: str | None, threshold: float = 0.0) -> DataFrame:
    """Arm, bin_label, PDB, seed, m1, m2 and plddt of both arms above the confidence threshold.

    An arm of a bin is left out if all of its second metrics are null; without a second metric there is nothing to compare.
    """
    if m2 is None:
        return arm_metrics(pred, control, m1, m1, threshold).limit(0)
    arm = lambda df, name: df.withColumn("arm", F.lit(name))
    both = arm(pred, "prediction").unionByName(arm(control, "control"), allowMissingColumns=True).where(F.col("plddt") > threshold)
    some = both.groupBy("arm", "bin_label").agg(F.count(m2).alias("_some")).where("_some > 0")  # a row a bin
    both = both.join(some, ["arm", "bin_label"], "left_semi")
    return both.select("arm", "bin_label", "PDB", seed_of(F.col("PDB").cast("string")).alias("seed"), F.col(m1).alias("m1"), F.col(m2).alias("m2"), "plddt")
