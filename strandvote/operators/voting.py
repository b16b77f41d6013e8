"""Votes (J2, J3, A5-A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dealt


def pair_groups_structures(groups: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that have a structure, with its columns."""
    return groups.join(structures, keys)


def cast_votes(members: DataFrame, structure_bins: DataFrame, source: DataFrame | None, keys: list[str], bins: list[str], header: str = "header") -> DataFrame:
    """One vote, header and bins, for each row of a group whose structure has a bin; headers outside source don't vote.

    Groups meet their bins first, so tables bucketed by keys are joined as they lie. (A semi join would be moved
    below that join, and members dealt by header and then by their keys.) With a source, votes are dealt by header as
    their number needs, on both sides alike, and are counted where they then lie.
    """
    voted = structure_bins.where(" AND ".join(f"{b} IS NOT NULL" for b in bins)).select(*keys, *bins)
    rows = members.select(*keys, header).join(voted, keys)
    if source is not None:
        n = members.count()
        rows = dealt(rows, n, header).join(dealt(source.select(header), n, header).distinct(), header)
    return rows.select(header, *bins)


def vote_counts(votes: DataFrame, bins: list[str], header: str = "header") -> DataFrame:
    """A5: header, bins, n."""
    return votes.groupBy(header, *bins).agg(F.count("*").alias("n"))


def consensus_bin(counts: DataFrame, bins: list[str], header: str = "header") -> DataFrame:
    """The most frequent bin of a header, the smallest one in a tie, its votes and all votes.

    One aggregate decides: the largest of (n, -bin, ..).
    """
    top = F.max(F.struct("n", *[(-F.col(b)).alias(b) for b in bins])).alias("top")
    names = ["Bin_Assignment"] if len(bins) == 1 else [f"Bin_Assignment_{i}" for i in range(1, len(bins) + 1)]
    out = counts.groupBy(F.col(header).alias("Sequence_Header")).agg(top, F.sum("n").alias("Total_Votes"))
    return out.select("Sequence_Header", *[(-F.col(f"top.{b}")).cast("int").alias(n) for b, n in zip(bins, names, strict=True)], F.col("top.n").alias("Vote_Count"), "Total_Votes")


def raw_votes(votes: DataFrame, header: str = "header", column: str = "bin") -> DataFrame:
    """Header and the sorted list of its bins."""
    return votes.groupBy(header).agg(F.sort_array(F.collect_list(column)).alias("bins"))
