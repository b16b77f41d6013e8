"""Stages (C1-C6, C9; C8 is commit.py), unions (U1, U2, U4) and arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import bin_1d, bin_focused
from ..functions.text import bin_label, iteration_of, round_of
from ..operators import distributions, filters, recompile, sampling, voting
from .params import Comparison, Enrichment, Recompile, Splits, Voting


def union_rounds(metrics: DataFrame, path: str = "PDB") -> DataFrame:
    """Metrics of all rounds with their round, from the path."""
    return metrics.withColumn("round", round_of(path)).where("round IS NOT NULL")


def union_iterations(metrics: DataFrame, path: str = "PDB", metric: str | None = None) -> DataFrame:
    """Metrics of all iterations with their iteration, from the path. metric: iterations without any value of it are left out."""
    rows = metrics.withColumn("iteration", iteration_of(path)).where("iteration IS NOT NULL")
    if metric is None:
        return rows
    some = rows.groupBy("iteration").agg(F.count(metric).alias("_some")).where("_some > 0")  # a row an iteration
    return rows.join(some, "iteration", "left_semi")


def concat_groups(groups: list[DataFrame]) -> DataFrame:
    """U4: members of several group tables, each entry once; no table is an error."""
    if not groups:
        raise ValueError("no group tables")
    ranked = [g.select("header", "seq", F.lit(i).alias("file_rank"), "pos") for i, g in enumerate(groups)]
    return recompile.distinct_entries(reduce(DataFrame.unionByName, ranked), order=("file_rank", "pos"))


def prepare_iteration(msa: DataFrame, params: Enrichment, first: bool = True, strict: bool = False) -> DataFrame:
    """Groups of an iteration; the first one filters by coverage and may take a random part. strict: nothing to shuffle is an error."""
    if first:
        msa = filters.filter_by_coverage(msa, params.coverage, strict=strict)
        if params.select is not None:
            msa = sampling.random_select(msa, params.select, params.seed)
    return sampling.make_shuffles(msa, params.shuffles, params.group_size, params.seed, strict=strict)


def kept_groups(metrics: DataFrame, criteria: list[dict], params: Enrichment) -> DataFrame:
    """Metrics of the structures that pass confidence and the quantiles of the criteria that params name (F5); none of them: all."""
    criteria = [c for c in criteria if c["name"] in params.criteria] or criteria
    sure = filters.filter_plddt(metrics, params.plddt)
    return filters.apply_filters(sure, sure, criteria, params.quantile)


def enrich_step(members: DataFrame, metrics: DataFrame, criteria: list[dict], params: Enrichment, keys: list[str]) -> DataFrame:
    """The next iteration's alignment, the members of the kept groups, each entry once."""
    return recompile.distinct_entries(recompile.groups_of_kept(members, kept_groups(metrics, criteria, params), keys))


def gather(members: DataFrame, metrics: DataFrame, criterion: dict, threshold: float, keys: list[str]) -> DataFrame:
    """The members of all groups of all iterations beyond the threshold of the first criterion, each entry once."""
    return recompile.distinct_entries(recompile.groups_of_kept(members, filters.combine_by_threshold(metrics, criterion, threshold), keys))


def m_fold(msa: DataFrame, params: Splits, strict: bool = False) -> DataFrame:
    """C4: splits of all rounds. strict: nothing to split is an error."""
    covered = filters.some_rows(filters.filter_by_coverage(msa, params.coverage, strict=strict), "splits", strict)
    if params.select is not None:
        covered = sampling.random_select(covered, params.select, params.seed)
    return sampling.make_rounds(covered, params.rounds, params.group_size, params.seed)


def structure_bins(metrics: DataFrame, metric: str, params: Voting, strict: bool = False) -> DataFrame:
    """B1 or B2 of the structures above the confidence threshold. strict: no structure to bin is an error."""
    make = bin_focused if params.focused else bin_1d
    return make(filters.filter_plddt(metrics, params.plddt) if params.plddt else metrics, metric, params.bins, params.lo, params.hi, strict)


def vote(members: DataFrame, metrics: DataFrame, source: DataFrame | None, metric: str, params: Voting, keys: list[str], strict: bool = False) -> DataFrame:
    """The consensus bin of every header by one metric. strict: no structure to bin is an error."""
    cast = voting.cast_votes(members, structure_bins(metrics, metric, params, strict), source, keys, ["bin_1"])
    out = voting.consensus_bin(voting.vote_counts(cast, ["bin_1"]), ["bin_1"])
    return filters.vote_threshold(out, params.threshold) if params.threshold > 0 else out


def recompile_bins(results: DataFrame, source: DataFrame, params: Recompile) -> DataFrame:
    """Arm, bin_label, pos, header and seq of the chosen bins and of controls of equal size.

    All bins go in one job. A control takes the first rows of a permutation of the whole source, as many
    as its bin has, so larger controls hold smaller ones of the same seed.
    """
    chosen = filters.select_bins(results, list(params.bins))
    label = bin_label(F.array(*map(F.lit, params.bins))) if params.combine else F.concat(F.lit("bin_"), F.col("Bin_Assignment"))
    chosen = chosen.select(F.col("Sequence_Header").alias("header"), label.alias("bin_label"))
    rows = source.select("pos", "header", "seq")
    target = rows.join(chosen, "header").select(F.lit("prediction").alias("arm"), "bin_label", "pos", "header", "seq")
    sizes = target.groupBy("bin_label").agg(F.count("*").alias("_size"))
    ranked = sampling.shuffle_rank(rows, [], params.seed)
    control = ranked.join(F.broadcast(sizes), F.col("rank") <= F.col("_size"))  # a row a bin
    return target.unionByName(control.select(F.lit("control").alias("arm"), "bin_label", "pos", "header", "seq"))


def pair_arms(pred: DataFrame, control: DataFrame) -> DataFrame:
    """Every bin label of either arm, with the structures of each."""
    count = lambda df, name: df.groupBy("bin_label").agg(F.count("*").alias(name))
    both = count(pred, "n_prediction").join(count(control, "n_control"), "bin_label", "full_outer")
    return both.select("bin_label", F.coalesce("n_prediction", F.lit(0)).alias("n_prediction"), F.coalesce("n_control", F.lit(0)).alias("n_control"))


def compare_arms(pred: DataFrame, control: DataFrame, m1: str, m2: str | None, params: Comparison) -> tuple[DataFrame, DataFrame]:
    """The paired labels and the metrics of both arms."""
    return pair_arms(pred, control), distributions.arm_metrics(pred, control, m1, m2, params.plddt)
