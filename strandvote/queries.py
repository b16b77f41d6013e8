"""Registered queries: the operators on the driver's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views as v
from .functions import binning, text
from .operators import distributions as dist
from .operators import filters, recompile, sampling, structure, tm_search, voting
from .plans import arrival, commit, layout, run, stages
from .plans.params import Comparison, Enrichment, Recompile, Splits, Voting
from .sources import alignments, named, structures, tables, votes_json
from .storage import shared_dir

KEYS = ["structure_id"]
BINS = 20
ABOVE_BELOW = [{"name": "metric1", "type": "tmscore", "method": "above"}, {"name": "metric2", "type": "rmsd", "method": "below"}]
ALL, HALF = list(range(1, v.RESIDUES + 1)), list(range(1, 12))
#: Rounds taken of the queries on few large groups.
GROUP = 200


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def vote_1d(s: SparkSession, d: str) -> DataFrame:
    return stages.vote(v.members(s, d), v.metrics(s, d), v.source(s, d), "metric1", Voting(bins=BINS), KEYS)


def vote_focused(s: SparkSession, d: str) -> DataFrame:
    return stages.vote(v.members(s, d), v.metrics(s, d), v.source(s, d), "metric1", Voting(bins=BINS, lo=50_000, hi=300_000, focused=True), KEYS)


def vote_threshold(s: SparkSession, d: str) -> DataFrame:
    return stages.vote(v.members(s, d), v.metrics(s, d), v.other_source(s, d), "metric1", Voting(bins=BINS, threshold=0.15, plddt=40.0), KEYS)


def _vote_nd(s: SparkSession, d: str, names: list[str], binned: DataFrame) -> DataFrame:
    bins = [f"bin_{i}" for i in range(1, len(names) + 1)]
    cast = voting.cast_votes(v.members(s, d), binned, v.source(s, d), KEYS, bins)
    return voting.consensus_bin(voting.vote_counts(cast, bins), bins)


def vote_2d(s: SparkSession, d: str) -> DataFrame:
    return _vote_nd(s, d, ["metric1", "metric2"], binning.bin_2d(v.metrics(s, d), ["metric1", "metric2"]))


def vote_3d(s: SparkSession, d: str) -> DataFrame:
    return _vote_nd(s, d, ["metric1", "metric2", "plddt"], binning.bin_3d(v.metrics(s, d), ["metric1", "metric2", "plddt"]))


def _votes(s: SparkSession, d: str) -> DataFrame:
    binned = binning.bin_focused(v.metrics(s, d), "metric1", BINS, 50_000, 300_000)
    return voting.cast_votes(v.members(s, d), binned, v.source(s, d), KEYS, ["bin_1"]).withColumnRenamed("bin_1", "bin")


def raw_votes(s: SparkSession, d: str) -> DataFrame:
    return voting.raw_votes(_votes(s, d)).select("header", F.array_join("bins", ",").alias("bins"))


def vote_ratios(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dist.vote_ratios(_votes(s, d), sampling.limit_headers(v.source(s, d), 100), BINS), "ratio")


def bin_distribution(s: SparkSession, d: str) -> DataFrame:
    return dist.bin_distribution(vote_focused(s, d), BINS)


def pair_groups(s: SparkSession, d: str) -> DataFrame:
    groups = v.members(s, d).groupBy(*KEYS).agg(F.count("*").alias("n_members"))
    return voting.pair_groups_structures(groups, v.metrics(s, d).where("plddt > 50").select("structure_id", "metric1"), KEYS)


def metric_bounds(s: SparkSession, d: str) -> DataFrame:
    return binning.bounds(v.metrics(s, d), "metric1")


def coverage_filter(s: SparkSession, d: str) -> DataFrame:
    return filters.filter_by_coverage(v.msa(s, d), 0.5, gap=" ").select("pos", F.length("seq").cast("long").alias("n_chars"))


def gap_fraction(s: SparkSession, d: str) -> DataFrame:
    return _rounded(v.msa(s, d).select("pos", text.gap_fraction("seq", F.length("seq"), " ").alias("gaps")), "gaps")


def header_key(s: SparkSession, d: str) -> DataFrame:
    return v.msa(s, d).select("pos", text.header_key("line").alias("header"))


def strip_insertions(s: SparkSession, d: str) -> DataFrame:
    return v.msa(s, d).select("pos", text.strip_insertions("seq").alias("seq"))


def strict_residues(s: SparkSession, d: str) -> DataFrame:
    return v.msa(s, d).select("pos", text.strict_residues("seq").alias("seq"))


def parse_a3m(s: SparkSession, d: str) -> DataFrame:
    return alignments.parse_a3m_text(v.a3m_files(s, d))


def last_wins(s: SparkSession, d: str) -> DataFrame:
    rows = v.table(s, d, "lineitem").select(F.col("l_partkey").alias("header"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long").alias("pos"))
    return recompile.last_wins(rows.withColumn("seq", F.col("pos") % 97), ["header"])


def distinct_entries(s: SparkSession, d: str) -> DataFrame:
    rows = v.msa(s, d).select("pos", F.concat(F.lit("d"), (F.col("pos") % 50).cast("string")).alias("header"), "seq")
    return recompile.distinct_entries(rows, query="d7")


def header_set(s: SparkSession, d: str) -> DataFrame:
    return recompile.header_set(v.msa(s, d).select(F.regexp_replace("line", r"^>d\d+ ", ">").alias("header")))


def _chosen(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "part").where("p_retailprice > 950").select(F.col("p_partkey").alias("header"), (-F.col("p_partkey")).alias("pos"))


def map_and_extract(s: SparkSession, d: str) -> DataFrame:
    return recompile.map_and_extract(_chosen(s, d), v.other_source(s, d)).select("pos", "header", "seq")


def missing_headers(s: SparkSession, d: str) -> DataFrame:
    return recompile.missing_headers(_chosen(s, d), v.other_source(s, d)).select("header")


def compile_sequences(s: SparkSession, d: str) -> DataFrame:
    return recompile.compile_sequences(v.other_source(s, d), _chosen(s, d)).select("pos", "header", "seq")


def control_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.control_sample(v.source(s, d), 300, seed=7).select("pos", "header")


def random_select(s: SparkSession, d: str) -> DataFrame:
    return sampling.random_select(v.source(s, d), 500, seed=3).select("header")


def shuffle_groups(s: SparkSession, d: str) -> DataFrame:
    return stages.prepare_iteration(v.source(s, d), Enrichment(shuffles=4, group_size=16, seed=42), first=False).select("shuffle", "group", "rank", "header")


def merge_tail_groups(s: SparkSession, d: str) -> DataFrame:
    return sampling.initial_groups(v.source(s, d), 50, seed=5)


def leave_one_out(s: SparkSession, d: str) -> DataFrame:
    return sampling.leave_one_out(sampling.initial_groups(v.source(s, d), GROUP, seed=5))


def make_splits(s: SparkSession, d: str) -> DataFrame:
    return sampling.make_splits(v.source(s, d), GROUP, seed=5).select("sampling", "group", "rank", "header")


def m_fold_rounds(s: SparkSession, d: str) -> DataFrame:
    return stages.m_fold(v.source(s, d), Splits(group_size=2 * GROUP, rounds=2, coverage=0.0, seed=9)).select("round", "sampling", "group", "rank", "header")


def plddt(s: SparkSession, d: str) -> DataFrame:
    lines = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("structure_id"), F.col("l_linenumber").alias("res_seq"), F.col("l_quantity").alias("b_factor"), F.lit("ATOM").alias("record"), F.lit("CA").alias("atom_name"))
    return _rounded(structure.plddt(lines, list(range(1, 6)), [2, 3]), "plddt", "local_plddt")


def seq_count(s: SparkSession, d: str) -> DataFrame:
    return structure.seq_count(v.members(s, d), KEYS)


def filter_plddt(s: SparkSession, d: str) -> DataFrame:
    return filters.filter_plddt(v.metrics(s, d), 50.0, drop_zero=True).select("structure_id", "plddt")


def quantile_filter(s: SparkSession, d: str) -> DataFrame:
    m = v.metrics(s, d)
    return filters.apply_filters(m, m, ABOVE_BELOW, 0.4).select("structure_id", "metric1", "metric2")


def combine_by_threshold(s: SparkSession, d: str) -> DataFrame:
    return filters.combine_by_threshold(v.metrics(s, d), ABOVE_BELOW[0], 200_000).select("structure_id")


def combine_by_rmsd(s: SparkSession, d: str) -> DataFrame:
    return filters.combine_by_threshold(v.metrics(s, d), ABOVE_BELOW[1], 100_000).select("structure_id")


def select_metrics(s: SparkSession, d: str) -> DataFrame:
    return filters.select_metrics(v.metrics(s, d), ["metric2", "absent"], KEYS)


def order_by_confidence(s: SparkSession, d: str) -> DataFrame:
    return sampling.order_by_confidence(v.metrics(s, d)).select("structure_id", "plddt")


def prepare_iteration(s: SparkSession, d: str) -> DataFrame:
    """The first iteration with its coverage filter; the gaps of the alignment are spaces."""
    msa = v.msa(s, d).select("pos", F.concat(F.lit("d"), "pos").alias("header"), F.replace("seq", F.lit(" "), F.lit("-")).alias("seq"))
    return stages.prepare_iteration(msa, Enrichment(shuffles=2, group_size=16, coverage=0.5, seed=3)).select("shuffle", "group", "rank", "header")


def _entries(s: SparkSession, d: str) -> DataFrame:
    return v.members(s, d).select("structure_id", F.concat(F.lit("p"), F.col("header")).alias("header"), F.concat(F.lit("S"), F.lpad((F.col("header") % 13).cast("string"), 2, "0")).alias("seq"), (F.col("structure_id") * 10 + F.col("pos")).alias("pos"))


def enrich_step(s: SparkSession, d: str) -> DataFrame:
    return stages.enrich_step(_entries(s, d), v.metrics(s, d), ABOVE_BELOW[:1], Enrichment(plddt=50.0, quantile=0.2), KEYS)


def concat_groups(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d)
    return stages.concat_groups([e.where("structure_id % 3 = 0"), e.where("structure_id % 3 = 1")])


def gather(s: SparkSession, d: str) -> DataFrame:
    return stages.gather(_entries(s, d), v.metrics(s, d), ABOVE_BELOW[0], 250_000, KEYS)


def hist_by_iteration(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dist.hist_by_iteration(v.metrics(s, d), "plddt", 0.0, 100.0, 2.5), "bin_lo", "bin_hi")


def hist_1d(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dist.hist_1d(v.metrics(s, d), "metric1", 50), "bin_lo", "bin_hi")


def quantile_marker(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dist.quantile_marker(v.metrics(s, d), "metric1", "tmscore"), "marker")


def summary(s: SparkSession, d: str) -> DataFrame:
    return _rounded(dist.summary(v.metrics(s, d), "plddt"), "mean", "median")


def kde_marginals(s: SparkSession, d: str) -> DataFrame:
    return dist.kde_marginals(v.metrics(s, d), "plddt", 200).select("point", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def scatter_table(s: SparkSession, d: str) -> DataFrame:
    return dist.scatter_table(v.metrics(s, d), "metric1", "metric2")


def _reference(atoms: DataFrame) -> DataFrame:
    return atoms.where("structure_id = 0")


def center_of_mass(s: SparkSession, d: str) -> DataFrame:
    return _rounded(structure.center_of_mass(v.backbone_atoms(s, d), [1, 2, 3]), "x", "y", "z")


def residue_distance(s: SparkSession, d: str) -> DataFrame:
    return _rounded(structure.residue_distance(v.backbone_atoms(s, d), [1, 2], [5, 6, 7]), "distance")


def domain_angle(s: SparkSession, d: str) -> DataFrame:
    return _rounded(structure.domain_angle(v.backbone_atoms(s, d), [1, 2], [6, 7], [4]), "angle")


def rmsd(s: SparkSession, d: str) -> DataFrame:
    atoms = v.ca_atoms(s, d)
    return _rounded(structure.rmsd(structure.match_atoms(_reference(atoms), atoms)), "rmsd")


def ca_rmsd(s: SparkSession, d: str) -> DataFrame:
    atoms = v.ca_atoms(s, d).where("structure_id <> 0 OR res_seq > 2")
    return _rounded(structure.ca_rmsd(v.ca_atoms(s, d), _reference(atoms), ALL), "rmsd")


def ca_rmsd_two_sets(s: SparkSession, d: str) -> DataFrame:
    atoms = v.ca_atoms(s, d)
    return _rounded(structure.ca_rmsd(atoms, _reference(atoms), HALF, ALL), "rmsd")


def all_atom_rmsd(s: SparkSession, d: str) -> DataFrame:
    atoms = v.backbone_atoms(s, d)
    return _rounded(structure.all_atom_rmsd(atoms, _reference(atoms), list(range(1, 8)), list(range(2, 7))), "all_atom_rmsd")


def tm_score_paired(s: SparkSession, d: str) -> DataFrame:
    atoms = v.ca_atoms(s, d)
    return _rounded(structure.tm_score_paired(atoms, _reference(atoms)), "tm_paired")


def all_metrics(s: SparkSession, d: str) -> DataFrame:
    criteria = {
        "basics": {"full_index": {"start": 1, "end": 7}, "local_index": {"start": 2, "end": 3}},
        "filter_criteria": [
            {"name": "gap", "type": "distance", "method": "above", "indices": {"set1": [1, 2], "set2": [{"start": 5, "end": 7}]}},
            {"name": "bend", "type": "angle", "method": "above", "indices": {"domain1": [1, 2], "domain2": [6, 7], "hinge": [4]}},
            {"name": "unknown", "type": "other"},
        ],
    }
    return _rounded(structure.all_metrics(v.backbone_atoms(s, d), {}, criteria, threshold=30.0), "plddt", "local_plddt", "gap", "bend")


def superposed_metrics(s: SparkSession, d: str) -> DataFrame:
    criteria = {
        "basics": {"full_index": {"start": 1, "end": 21}},
        "filter_criteria": [
            {"name": "fit", "type": "rmsd", "method": "below", "ref_pdb": "first", "superposition_indices": {"start": 1, "end": 11}},
            {"name": "tm", "type": "tmscore", "method": "above", "ref_pdb": "first"},
        ],
    }
    atoms = v.ca_atoms(s, d)
    return _rounded(structure.all_metrics(atoms, {"first": _reference(atoms)}, criteria, threshold=30.0), "plddt", "fit", "tm")


def pdb_atoms(s: SparkSession, d: str) -> DataFrame:
    atoms = structures.parse_atoms(v.pdb_lines(s, d))
    return atoms.select("structure_id", "line_no", "model", "atom_name", "res_name", "chain", "res_seq", "x", "y", "z", "b_factor", "element")


def protein_sequence(s: SparkSession, d: str) -> DataFrame:
    return structure.protein_sequence(v.backbone_atoms(s, d))


def path_keys(s: SparkSession, d: str) -> DataFrame:
    return structures.structure_keys(v.paths(s, d)).select("structure_id", "group_file", "seed", "round", "sampling", "group")


def missing_predictions(s: SparkSession, d: str) -> DataFrame:
    return recompile.missing_predictions(v.table(s, d, "orders").select(F.col("o_orderkey").alias("structure_id")), v.members(s, d), KEYS)


def prediction_manifest(s: SparkSession, d: str) -> DataFrame:
    return recompile.prediction_manifest(vote_focused(s, d), [1, 5, 9, 40])


def recompile_bins(s: SparkSession, d: str) -> DataFrame:
    return stages.recompile_bins(vote_focused(s, d), v.source(s, d), Recompile(bins=(1, 5, 9), seed=11)).select("arm", "bin_label", "pos", "header")


def combined_manifest(s: SparkSession, d: str) -> DataFrame:
    return recompile.prediction_manifest(vote_focused(s, d), [9, 5, 1], combine=True)


def recompile_combined(s: SparkSession, d: str) -> DataFrame:
    return stages.recompile_bins(vote_focused(s, d), v.source(s, d), Recompile(bins=(9, 5, 1), combine=True, seed=11)).select("arm", "bin_label", "pos", "header")


def _arm(s: SparkSession, d: str, name: str) -> DataFrame:
    m = v.metrics(s, d).where(F.col("arm") == name).join(v.paths(s, d), "structure_id")
    return m.select(F.concat(F.lit("bin_"), (F.col("structure_id") % (9 if name == "control" else 8)).cast("string")).alias("bin_label"), F.col("path").alias("PDB"), "metric1", "metric2", "plddt")


def arm_metrics(s: SparkSession, d: str) -> DataFrame:
    return stages.compare_arms(_arm(s, d, "prediction"), _arm(s, d, "control"), "metric1", "metric2", Comparison(plddt=50.0))[1]


def pair_arms(s: SparkSession, d: str) -> DataFrame:
    return stages.pair_arms(_arm(s, d, "prediction"), _arm(s, d, "control"))


def union_rounds(s: SparkSession, d: str) -> DataFrame:
    m = v.metrics(s, d).drop("round", "iteration").join(v.paths(s, d), "structure_id")
    return stages.union_rounds(m, "path").groupBy("round").agg(F.count("*").alias("structures"), F.max("metric1").alias("top"))


def union_iterations(s: SparkSession, d: str) -> DataFrame:
    """Iterations by year; those after 1996 have no value of metric1."""
    m = v.metrics(s, d).select(F.concat(F.lit("run/Iteration_"), "iteration", F.lit("/x.pdb")).alias("PDB"), F.when(F.col("iteration") <= 1996, F.col("metric1")).alias("metric1"))
    return stages.union_iterations(m, metric="metric1").groupBy("iteration").agg(F.count("*").alias("structures"), F.max("metric1").alias("top"))


def merge_metric_files(s: SparkSession, d: str) -> DataFrame:
    lines = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("PDB"), F.concat(F.lit("file_"), F.col("l_linenumber").cast("string")).alias("source"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("double")).alias("m1"), F.when(F.col("l_linestatus") == "O", F.col("l_linenumber") * 2.0).alias("m2"))
    return tables.merge_metric_files(lines, ["m1", "m2"])


def job_log_status(s: SparkSession, d: str) -> DataFrame:
    lines = v.table(s, d, "events").select(F.concat(F.lit("job_"), F.col("user_id")).alias("dir"), F.when(F.col("event_type") == "purchase", F.lit("2024 Done")).otherwise(F.lit("running")).alias("value"))
    return structures.log_status(lines)


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def group_files(s: SparkSession, d: str) -> DataFrame:
    """Alignment files of groups, written under their names (K1) and read again."""
    path = _folder(s, "groups")
    named.write_group_files(_entries(s, d).withColumn("group", F.col("structure_id") % 40), path, ["group"], "QQ")
    back = alignments.read_a3m(s, f"{path}/*.a3m")
    return back.select(F.regexp_extract("msa_id", r"group_([0-9]+)\.a3m$", 1).cast("int").alias("grp"), "header", "seq")


def raw_votes_file(s: SparkSession, d: str) -> DataFrame:
    """Raw votes as lines of JSON (K5), read again."""
    path = _folder(s, "votes")
    tables.write_raw_votes(_votes(s, d), path)
    return votes_json.read_raw_votes(s, path).groupBy("header", "bin").agg(F.count("*").alias("n"))


def voting_results_file(s: SparkSession, d: str) -> DataFrame:
    """Voting results as CSV (K4), read again."""
    path = _folder(s, "results")
    tables.write_voting_results(vote_focused(s, d), path)
    return tables.read_voting_results(s, path)


def aligner_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of an aligner come in as a column of a metrics file (K3, S4), and are filtered as any metric."""
    path = _folder(s, "scores")
    tables.write_metrics(v.metrics(s, d).select(F.col("structure_id").alias("PDB"), "plddt", "metric1"), path)
    return filters.combine_by_threshold(tables.read_metrics(s, path, ["metric1"], 50.0), ABOVE_BELOW[0], 200_000)


def criterion_atoms(s: SparkSession, d: str) -> DataFrame:
    """Atoms and their mean confidence of each role of criteria that are read from a file."""
    path = _folder(s, "criteria")
    criteria = {
        "basics": {"full_index": {"start": 1, "end": 21}},
        "filter_criteria": [{"name": "fit", "type": "rmsd", "method": "below", "superposition_indices": {"start": 1, "end": 11}}, {"name": "gap", "type": "distance", "method": "above", "indices": {"set1": [1, 2], "set2": [{"start": 18, "end": 21}]}}],
    }
    commit.Folder(s, path).write("criteria.json", json.dumps(criteria))
    residues = tables.criterion_residues(s, f"{path}/criteria.json")
    return v.ca_atoms(s, d).join(F.broadcast(residues), "res_seq").groupBy("name", "role").agg(F.count("*").alias("atoms"), F.round(F.avg("b_factor"), 6).alias("confidence"))  # a settings file


def vote_arrivals(s: SparkSession, d: str) -> DataFrame:
    """Structures come in three files; each one's votes are added to those before."""
    path, m = _folder(s, "arrivals"), v.metrics(s, d).select("structure_id", "metric1", "plddt")
    m.repartition(3).write.parquet(f"{path}/in")
    state = arrival.VoteState(s, path, "long", Voting(bins=BINS, lo=50_000, hi=300_000, focused=True), "metric1")
    stream = s.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return arrival.absorb_votes(stream, path, state, v.members(s, d), v.source(s, d), KEYS).consensus()


def late_predictions(s: SparkSession, d: str) -> DataFrame:
    """J7 in a run: a third of the structures are there already, and only the other groups are predicted."""
    score = lambda members, keys: members.groupBy(*keys).agg(F.avg("header").alias("m1"), F.count("*").alias("seq_count"))
    members = v.members(s, d)
    return run.predicted(members, KEYS, 1, 1, lambda rest, keys, _m, _s: score(rest, keys), lambda keys: score(members.where("structure_id % 3 = 0"), keys))


def resumed_step(s: SparkSession, d: str) -> DataFrame:
    """A step of enrichment that was committed is read by the next run."""
    path, settings = _folder(s, "run"), Enrichment(plddt=50.0, quantile=0.2)
    make = lambda: enrich_step(s, d)
    first = commit.Stages(s, path).once("alignment", make, settings, strict=True)
    again = commit.Stages(s, path).once("alignment", make, settings, strict=True)
    if again.id != first.id:
        raise AssertionError("a committed stage was made again")
    return again.df


def bucketed_votes(s: SparkSession, d: str) -> DataFrame:
    """J2, J3 on tables that lie in buckets of the group."""
    n = int(s.conf.get("spark.sql.shuffle.partitions"))
    bins = stages.structure_bins(v.metrics(s, d), "metric1", Voting(bins=BINS, lo=50_000, hi=300_000, focused=True))
    cast = voting.cast_votes(layout.bucketed(v.members(s, d), KEYS, n), layout.bucketed(bins.select("structure_id", "bin_1"), KEYS, n), v.source(s, d), KEYS, ["bin_1"])
    return voting.consensus_bin(voting.vote_counts(cast, ["bin_1"]), ["bin_1"])


def tm_score_searched(s: SparkSession, d: str) -> DataFrame:
    """G6b by search; SQL can't express the rounds, so it is tested against a plain search."""
    atoms = v.ca_atoms(s, d)
    return _rounded(tm_search.tm_score_searched(atoms, _reference(atoms)), "tm_searched")


QUERIES = {
    f.__name__: f
    for f in (
        vote_1d, vote_focused, vote_threshold, vote_2d, vote_3d, raw_votes, vote_ratios, bin_distribution, pair_groups, metric_bounds, coverage_filter, gap_fraction,
        header_key, strip_insertions, strict_residues, parse_a3m, last_wins, distinct_entries, header_set, map_and_extract, missing_headers, compile_sequences, control_sample,
        random_select, shuffle_groups, merge_tail_groups, leave_one_out, make_splits, m_fold_rounds, plddt, seq_count, filter_plddt, quantile_filter, combine_by_threshold,
        enrich_step, gather, hist_by_iteration, hist_1d, quantile_marker, summary, kde_marginals, scatter_table, center_of_mass, residue_distance, domain_angle, rmsd, ca_rmsd,
        ca_rmsd_two_sets, all_atom_rmsd, tm_score_paired, all_metrics, pdb_atoms, protein_sequence, path_keys, missing_predictions, prediction_manifest, recompile_bins,
        arm_metrics, pair_arms, union_rounds, merge_metric_files, job_log_status, combine_by_rmsd, select_metrics, order_by_confidence, prepare_iteration, concat_groups,
        superposed_metrics, combined_manifest, recompile_combined, union_iterations, group_files, raw_votes_file, voting_results_file, aligner_scores, criterion_atoms,
        vote_arrivals, late_predictions, resumed_step, bucketed_votes, tm_score_searched,
    )
}
