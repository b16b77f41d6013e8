"""All stages in turn, each committed under one folder, so that a run that was stopped goes on where it ended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, recompile
from . import stages
from .arrival import missing_groups
from .commit import Stage, Stages, fingerprint
from .params import Pipeline

#: (members with their sequences, keys of a group, models, seeds) -> keys, plddt and the metrics of each group's structures.
Predict = Callable[[DataFrame, list[str], int, int], DataFrame]
#: Keys of a group -> keys, plddt and metrics of structures that are there already; None: there are none.
Arrived = Callable[[list[str]], DataFrame | None]


def predicted(members: DataFrame, keys: list[str], models: int, seeds: int, predict: Predict, arrived: Arrived | None) -> DataFrame:
    """The metrics of all groups; only groups without a structure go to the predictor."""
    have = arrived(keys) if arrived else None
    if have is None:
        return predict(members, keys, models, seeds)
    groups = members.select(*keys).distinct()
    own = have.join(groups, keys, "left_semi")
    rest = missing_groups(groups, own, keys)
    if rest.isEmpty():
        return own
    return own.unionByName(predict(members.join(rest, keys, "left_semi"), keys, models, seeds))


def run(msa: DataFrame, settings: Pipeline, criteria: list[dict], predict: Predict, path: str, stale: str = "raise", arrived: Arrived | None = None) -> dict[str, DataFrame]:
    """Enrichment, splits, votes, recompiled sets and the comparison of arms, by the first criterion (and the second one).

    msa has pos, header and seq; of a repeated header the first place and the last sequence count. predict stands
    for the structure predictor and the metrics of its structures; PDB, a path, is among its columns in the last
    stage. arrived gives structures that a stopped predictor left. A stage without rows is an error, and so are
    stored stages that were made with other settings, criteria or alignments, unless stale is 'rerun'.
    """
    part, keys = settings.enrichment, ["iteration", "shuffle", "group"]
    alignment = recompile.last_wins(filters.some_rows(msa, "alignment").select("pos", "header", "seq"), ["header"])
    todo = Stages(msa.sparkSession, path, stale)
    source = fingerprint(alignment)
    own = asdict(part)
    own.pop("iterations"), own.pop("combine_threshold")  # more iterations, or another threshold, leave those that are done as they are
    groups: list[Stage] = []
    scored: list[Stage] = []
    now = Stage(alignment, source)
    for i in range(1, part.iterations + 1):
        at = f"enrichment/iteration_{i}"

        def grouped(i: int = i, now: Stage = now) -> DataFrame:
            made = stages.prepare_iteration(now.df, part, first=i == 1, strict=True).withColumn("iteration", F.lit(i))
            return made.join(now.df.select("header", "seq"), "header")

        members = todo.once(f"{at}/members", grouped, own, (now.id,), strict=True)
        scores = todo.once(f"{at}/metrics", lambda members=members: predicted(members.df, keys, 1, 1, predict, arrived), None, (members.id,), strict=True)
        groups, scored = [*groups, members], [*scored, scores]
        now = todo.once(f"{at}/alignment", lambda members=members, scores=scores: stages.enrich_step(members.df, scores.df, criteria, part, keys), [own, criteria], (members.id, scores.id), strict=True)
    every, scores = (reduce(DataFrame.unionByName, [s.df for s in some]) for some in (groups, scored))
    # an entry is placed by iteration, then by its place there
    every = every.withColumn("pos", F.col("iteration").cast("long") * (1 << 40) + F.col("pos"))
    sources = tuple(s.id for s in [*groups, *scored])
    gathered = todo.once("gathered", lambda: stages.gather(every, scores, criteria[0], part.combine_threshold, keys), [part.combine_threshold, criteria[0]], sources, strict=True)
    split_keys = ["round", "sampling", "group"]
    splits = todo.once("splits", lambda: stages.m_fold(gathered.df, settings.splits, strict=True).join(gathered.df.select("header", "seq"), "header"), settings.splits, (gathered.id,), strict=True)
    split_scores = todo.once("split-metrics", lambda: predicted(splits.df, split_keys, 1, 1, predict, arrived), None, (splits.id,), strict=True)
    votes = todo.once("votes", lambda: stages.vote(splits.df, split_scores.df, gathered.df, criteria[0]["name"], settings.voting, split_keys, strict=True), [asdict(settings.voting), criteria[0]], (splits.id, split_scores.id), strict=True)
    sets = todo.once("recompiled", lambda: stages.recompile_bins(votes.df, gathered.df, settings.recompile), settings.recompile, (votes.id, gathered.id), strict=True)
    last = todo.once("arm-metrics", lambda: predicted(sets.df, ["arm", "bin_label"], settings.recompile.models, settings.recompile.seeds, predict, None), settings.recompile, (sets.id,), strict=True)
    arm = lambda name: last.df.where(F.col("arm") == name).drop("arm")
    second = criteria[1]["name"] if len(criteria) > 1 else None
    paired, compared = stages.compare_arms(arm("prediction"), arm("control"), criteria[0]["name"], second, settings.comparison)
    return {
        "enrichment": scores, "gathered": gathered.df, "sampling": filters.filter_plddt(split_scores.df, settings.splits.plddt), "votes": votes.df, "sets": sets.df, "arms": paired, "comparison": compared,
    }
