"""Filters (F1-F8; F6 is with the structure listings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gap_fraction
from .selection import quantiles


def some_rows(df: DataFrame, what: str, strict: bool = True) -> DataFrame:
    """df; if strict, an error if it has no row. It runs a job that ends at the first row."""
    if strict and df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def filter_by_coverage(msa: DataFrame, threshold: float = 0.8, gap: str = "-", keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """rows whose share of columns without a gap, by the length of the first row, is at least threshold. 0 or less keeps all.

    keys: columns that tell alignments apart; by default there is one. An empty alignment stays empty, or is an
    error if strict.
    """
    msa = some_rows(msa, "coverage filter", strict)
    if threshold <= 0:
        return msa
    keys = keys or []
    first = msa.groupBy(*keys).agg(F.min_by(F.length("seq"), F.col("pos")).alias("_length"))
    both = msa.join(first, keys) if keys else msa.crossJoin(F.broadcast(first))  # one row
    return both.where(1 - gap_fraction("seq", "_length", gap) >= threshold).drop("_length")


def filter_plddt(metrics: DataFrame, threshold: float, column: str = "plddt", drop_zero: bool = False) -> DataFrame:
    """strictly above the threshold; drop_zero also drops 0, as a missing value does."""
    out = metrics.where(F.col(column) > threshold)
    return out.where(F.col(column) != 0) if drop_zero else out


def confidence(metrics: DataFrame) -> Column:
    """The local confidence where there is one, else the global one."""
    return F.coalesce("local_plddt", "plddt") if "local_plddt" in metrics.columns else F.col("plddt")


def exact_quantile(df: DataFrame, metric: str, p: float, keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """keys and name, the p quantile of metric by linear interpolation; null without values. Without keys one row."""
    return quantiles(df, {name: (metric, p)}, keys)


def quantile_thresholds(df: DataFrame, criteria: list[dict], q: float, exact: bool = True) -> DataFrame:
    """One row: for each usable criterion t_<name>, its quantile 1 - q (above) or q (below), by linear interpolation; all in one selection."""
    usable = {c["name"]: 1 - q if c["method"] == "above" else q for c in criteria if c["name"] in df.columns and c.get("method") in ("above", "below")}
    if not usable:
        return df.sparkSession.range(1).select()
    if not exact:
        return df.agg(*[F.percentile_approx(F.col(name), F.lit(p)).alias(f"t_{name}") for name, p in usable.items()])
    return quantiles(df, {f"t_{name}": (name, p) for name, p in usable.items()})


def apply_filters(threshold_df: DataFrame, operate_df: DataFrame, criteria: list[dict], q: float, exact: bool = True) -> DataFrame:
    """rows of operate_df strictly beyond the thresholds that threshold_df sets, for all criteria.

    Criteria without a known method or a column are skipped. exact=False takes the sketch's own quantiles, in
    one pass.
    """
    usable = [c for c in criteria if c["name"] in threshold_df.columns and c["name"] in operate_df.columns and c.get("method") in ("above", "below")]
    if not usable:
        return operate_df
    limits = quantile_thresholds(threshold_df, usable, q, exact)
    out = operate_df.crossJoin(F.broadcast(limits))  # one row
    for c in usable:
        t = F.col(f"t_{c['name']}")
        out = out.where(F.col(c["name"]) > t if c["method"] == "above" else F.col(c["name"]) < t)
    return out.drop(*limits.columns)


def combine_by_threshold(metrics: DataFrame, criterion: dict, threshold: float) -> DataFrame:
    """tmscore above, rmsd below the threshold; other types keep nothing."""
    col = F.col(criterion["name"])
    keep = {"tmscore": col > threshold, "rmsd": col < threshold}.get(criterion["type"], F.lit(False))
    return metrics.where(keep)


def select_metrics(df: DataFrame, names: list[str], keys: list[str], missing: str = "all") -> DataFrame:
    """keys and the named metrics that exist. None of them: all columns, an error or no metric, as missing says."""
    have = [n for n in names if n in df.columns]
    if not have and missing == "error":
        raise ValueError(f"none of {names} is a column")
    return df if not have and missing == "all" else df.select(*keys, *[n for n in have if n not in keys])


def vote_threshold(votes: DataFrame, threshold: float) -> DataFrame:
    """consensus rows whose share of votes is at least threshold."""
    return votes.where(F.col("Vote_Count") / F.col("Total_Votes") >= threshold)


def select_bins(results: DataFrame, bins: int | list[int], column: str = "Bin_Assignment") -> DataFrame:
    """F8."""
    return results.where(F.col(column).isin([bins] if isinstance(bins, int) else list(bins)))
