"""Quirks, tails, ties and edges on small literal tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandvote.functions import binning, text
from strandvote.operators import distributions, filters, recompile, sampling, structure, voting
from strandvote.plans import params, stages
from strandvote.sources import alignments, structures, tables, votes_json


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(("value", "want"), [(">a b c", "a"), (">a\tb", "a"), ("> a", "a"), ("a", "a"), (">", ""), (">1012 x", "1012")])
def test_header_key(spark, value, want):
    assert col(spark, value, text.header_key) == want


def test_text_functions(spark):
    assert col(spark, "AbC-d.1*É", text.strip_insertions) == "AC-.1*É"
    assert col(spark, "AbC-d.1*É", text.strict_residues) == "AC-É"
    p = "run/round_2/02_sampling/sampling_7/group_3_unrelaxed_rank_001_alphafold2_ptm_model_1_seed_042.pdb"
    assert col(spark, p, text.group_path) == "run/round_2/02_sampling/sampling_7/group_3.a3m"
    assert col(spark, "a/group_3.a3m", text.structure_path) == "a/group_3_unrelaxed_rank_001_alphafold2_ptm_model_1_seed_042.pdb"
    assert (col(spark, p, text.seed_of), col(spark, p, text.round_of), col(spark, "x.pdb", text.seed_of)) == (42, 2, 0)
    assert col(spark, "Iteration_10/x", text.iteration_of) == 10
    assert col(spark, "x", lambda c: text.bin_label(F.array(F.lit(9), F.lit(2)))) == "bin_2_9"
    assert col(spark, " n", text.element_mass) == pytest.approx(14.007) and col(spark, "QQ", text.element_mass) is None
    assert text.expand_indices([{"start": 1, "end": 3}, {"start": 9, "end": 9}]) == [1, 2, 3, 9]
    assert text.expand_indices(None, [4]) == [4] and text.expand_indices([5, 6]) == [5, 6]


def test_bins_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    lo, hi, n = -3.3, 7.9, 20
    edges = np.linspace(lo, hi, n + 1)
    values = np.concatenate((rng.uniform(lo, hi, 300), edges))
    df = spark.createDataFrame(pd.DataFrame({"m": values}))
    got = binning.bin_1d(df, "m", n).toPandas()
    assert (got["bin_1"].to_numpy() == np.digitize(got["m"], edges) - 1).all()
    wide = spark.createDataFrame(pd.DataFrame({"m": [*values, lo - 1, hi + 1]}))
    got = binning.bin_focused(wide, "m", n, lo, hi).toPandas()
    want = np.digitize(got["m"], np.concatenate(([-np.inf], edges, [np.inf]))) - 1
    assert (got["bin_1"].to_numpy() == want).all()


def test_bins_of_nulls_ties_and_bounds(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,)], "m double")
    assert {r["bin_1"] for r in binning.bin_1d(df, "m", 5).collect()} == {5, None}
    with pytest.raises(Exception, match="outside"):
        binning.bin_1d(df, "m", 5, 2, 3).collect()
    assert binning.bin_1d(df.limit(0), "m").count() == 0


@pytest.mark.parametrize("n", [1, 7, 10, 11, 20, 25])
def test_group_tails(spark, n):
    msa = spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("header"))
    merged = sampling.initial_groups(msa, 10).groupBy("group").count().toPandas()
    assert len(merged) == max(1, n // 10) and merged["count"].sum() == n and (merged["count"].max() < 20)
    short = sampling.make_shuffles(msa, 2, 10).toPandas()
    assert short[short["shuffle"] == 1]["group"].nunique() == -(-n // 10)
    assert sorted(short[short["shuffle"] == 2]["rank"]) == list(range(1, n + 1))
    assert list(short[short["shuffle"] == 1].sort_values("rank")["header"]) != list(short[short["shuffle"] == 2].sort_values("rank")["header"]) or n < 4


def test_splits_leave_their_group_out(spark):
    msa = spark.range(57).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("header"))
    first = sampling.initial_groups(msa, 10).toPandas()
    splits = sampling.make_splits(msa, 10).toPandas()
    for k, own in splits.groupby("sampling"):
        out = set(first[first["group"] == k]["header"])
        assert set(own["header"]) == set(first["header"]) - out and len(own) == 57 - len(out)


def test_same_result_for_any_partitioning(spark):
    msa = spark.range(200).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("header"))
    a = sampling.make_rounds(msa.repartition(1), 2, 20).toPandas().sort_values(["round", "sampling", "rank"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = sampling.make_rounds(msa.repartition(9), 2, 20).toPandas().sort_values(["round", "sampling", "rank"]).reset_index(drop=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(a, b)


def test_votes_ties_and_repeats(spark):
    members = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (9, "a")], "structure_id int, header string")
    bins = spark.createDataFrame([(1, 5), (2, 3), (3, 7), (4, None)], "structure_id int, bin int")
    source = spark.createDataFrame([("a",), ("b",), ("c",)], "header string")
    votes = voting.cast_votes(members, bins, source, ["structure_id"], ["bin"])
    got = {r["Sequence_Header"]: tuple(r)[1:] for r in voting.consensus_bin(voting.vote_counts(votes, ["bin"]), ["bin"]).collect()}
    assert got == {"a": (5, 2, 3), "b": (3, 1, 2)}  # a repeated header votes twice; a tie takes the smallest bin
    assert {r["header"]: r["bins"] for r in voting.raw_votes(votes).collect()} == {"a": [3, 5, 5], "b": [3, 7]}


def test_quantile_filter_is_strict_and_like_pandas(spark):
    pdf = pd.DataFrame({"m": [1.0, 2, 3, 4, 10, None], "k": range(6)})
    df = spark.createDataFrame(pdf).withColumn("m", F.when(~F.isnan("m"), F.col("m")))
    got = {r["k"] for r in filters.apply_filters(df, df, [{"name": "m", "method": "above"}, {"name": "m"}, {"name": "other", "method": "below"}], 0.2).collect()}
    assert got == set(pdf[pdf["m"] > pdf["m"].quantile(0.8)]["k"])
    below = {r["k"] for r in filters.apply_filters(df, df, [{"name": "m", "method": "below"}], 0.4).collect()}
    assert below == set(pdf[pdf["m"] < pdf["m"].quantile(0.4)]["k"])
    assert filters.apply_filters(df, df, [], 0.2).count() == 6
    assert filters.combine_by_threshold(df, {"name": "m", "type": "rmsd"}, 3).count() == 2 and filters.combine_by_threshold(df, {"name": "m", "type": "angle"}, 3).count() == 0


def test_read_a3m(spark, tmp_path):
    (tmp_path / "x.a3m").write_text("text before\n>101 query\nACDE\n\nFG\n>b\tinfo\nAcC-\n>1012\nKK\n>b second\nTT\r\n>empty\n")
    got = {r["header"]: (r["pos"], r["seq"]) for r in alignments.read_a3m(spark, str(tmp_path)).collect()}
    assert {h: s for h, (_, s) in got.items()} == {"101": "ACDEFG", "b": "TT", "1012": "KK", "empty": ""}
    assert sorted(got, key=lambda h: got[h][0]) == ["101", "b", "1012", "empty"]


def test_a3m_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", "AC"), (1, 2, "b", "DE"), (2, 1, "a", "AC")], "group int, pos long, header string, seq string")
    alignments.write_a3m(rows, str(tmp_path / "out"), ["group"], "QQ")
    text_of = lambda g: "".join(p.read_text() for p in (tmp_path / "out" / f"group={g}").glob("*.txt"))
    assert text_of(1) == ">101\nQQ\n>a\nAC\n>b\nDE\n" and text_of(2) == ">101\nQQ\n>a\nAC\n"
    clean = recompile.distinct_entries(alignments.read_a3m(spark, str(tmp_path / "out/group=1")).drop("msa_id"))
    assert [(r["header"], r["seq"]) for r in clean.orderBy("pos").collect()] == [("a", "AC"), ("b", "DE")]


def test_distinct_entries_drop_the_query_only(spark):
    rows = spark.createDataFrame([(1, "101", "Q"), (2, "1012", "A1"), (3, "1012", "A"), (4, "1012", "B")], "pos long, header string, seq string")
    assert [tuple(r) for r in recompile.distinct_entries(rows).orderBy("pos").collect()] == [(2, "1012", "A"), (4, "1012", "B")]


PDB = """MODEL        1
ATOM      1  N   LYS A   7      12.125  -4.500  61.250  1.00140.25           N
ATOM      2  CA ALYS A   7      13.375  -5.250  61.750  0.40140.25           C
ATOM      3  CA BLYS A   7      13.500  -5.125  61.875  0.60 40.25           C
HETATM    4  O   HOH A   8      15.750   2.500  60.125  1.00140.25           O1-
ENDMDL
MODEL        2
ATOM      5  CA  GLY B   1         bad   3.125  -8.375  1.00 10.00           C
"""


def test_read_pdb(spark, tmp_path):
    (tmp_path / "non_a3m").mkdir()
    (tmp_path / "s.pdb").write_text(PDB)
    (tmp_path / "non_a3m" / "t.pdb").write_text(PDB)
    atoms = structures.read_pdb_atoms(spark, str(tmp_path / "s.pdb")).orderBy("line_no").collect()
    assert [(r["atom_name"], r["altloc"], r["model"], r["chain"], r["b_factor"]) for r in atoms] == [("N", "", 1, "A", 140.25), ("CA", "B", 1, "A", 40.25), ("O", "", 1, "A", 140.25), ("CA", "", 2, "B", 10.0)]
    assert atoms[3]["x"] is None and atoms[0]["z"] == 61.25
    assert structures.list_structures(spark, str(tmp_path)).count() == 1


def test_job_logs(spark, tmp_path):
    for name, value in (("a", "start\nDone\n"), ("b", "start\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.txt").write_text(value)
    got = {r["dir"].rsplit("/", 1)[1]: r["done"] for r in structures.job_log_status(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False}


def points(spark, sets):
    rows = [(s, 1, "ATOM", "CA", "C", "A", i, float(x), float(y), float(z), 50.0) for s, xyz in sets.items() for i, (x, y, z) in enumerate(xyz, 1)]
    return spark.createDataFrame(rows, "structure_id string, model int, record string, atom_name string, element string, chain string, res_seq int, x double, y double, z double, b_factor double")


def svd_rmsd(p, q, sup, rms):
    a, b = p[sup] - p[sup].mean(0), q[sup] - q[sup].mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ vt))])
    moved = (p[rms] - p[sup].mean(0)) @ (u @ d @ vt) + q[sup].mean(0)
    return float(np.sqrt(((moved - q[rms]) ** 2).sum(1).mean()))


def test_superposition_agrees_with_svd(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=(12, 3)) * 5
    angle = 1.1
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    sets = {"ref": ref, "self": ref, "turned": ref @ turn + 3, "half": ref * [-1, -1, 1], "mirror": ref * [1, 1, -1], "noise": ref + rng.normal(size=ref.shape), "other": rng.normal(size=ref.shape)}
    atoms = points(spark, sets)
    reference = atoms.where("structure_id = 'ref'")
    everything, some = list(range(1, 13)), list(range(1, 7))
    one = {r["structure_id"]: r["rmsd"] for r in structure.ca_rmsd(atoms, reference, everything).collect()}
    two = {r["structure_id"]: r["rmsd"] for r in structure.ca_rmsd(atoms, reference, some, everything).collect()}
    for name, p in sets.items():
        assert one[name] == pytest.approx(svd_rmsd(p, ref, slice(None), slice(None)), abs=1e-6), name
        assert two[name] == pytest.approx(svd_rmsd(p, ref, slice(0, 6), slice(None)), abs=1e-5), name


def test_degenerate_poses_and_missing_residues(spark):
    line = [(i, 0, 0) for i in range(5)]
    atoms = points(spark, {"ref": line, "line": line, "two": line[:2]})
    got = {r["structure_id"]: r["rmsd"] for r in structure.ca_rmsd(atoms, atoms.where("structure_id = 'ref'"), [1, 2, 3], [1, 2, 3, 4]).collect()}
    assert got["line"] is None and got["two"] is None
    d = {r["structure_id"]: r["distance"] for r in structure.residue_distance(atoms, [1], [5]).collect()}
    assert d["line"] == pytest.approx(4) and d["two"] is None
    angle = {r["structure_id"]: r["angle"] for r in structure.domain_angle(atoms, [1], [5, 9], [3]).collect()}
    assert angle["line"] == pytest.approx(180) and angle["two"] is None


def test_all_metrics_and_criteria(spark, tmp_path):
    criteria = {"basics": {"full_index": {"start": 1, "end": 5}}, "filter_criteria": [{"name": "d", "type": "distance", "method": "above", "indices": {"set1": [1], "set2": [5]}}, {"name": "r", "type": "rmsd", "ref_pdb": "ref"}]}
    (tmp_path / "c.json").write_text(json.dumps(criteria))
    rows = tables.criterion_residues(spark, str(tmp_path / "c.json")).collect()
    assert {(r["name"], r["role"]) for r in rows} == {("d", "set1"), ("d", "set2"), ("r", "sup"), ("r", "rms")} and len(rows) == 12
    with pytest.raises(ValueError, match="filter_criteria"):
        tables.load_criteria("{}")
    rng = np.random.default_rng(1)
    atoms = points(spark, {"ref": rng.normal(size=(5, 3)), "a": rng.normal(size=(5, 3)), "short": rng.normal(size=(3, 3))})
    refs = {"ref": atoms.where("structure_id = 'ref'")}
    got = {r["PDB"]: r for r in structure.all_metrics(atoms, refs, criteria).collect()}
    assert got["ref"]["r"] == pytest.approx(0, abs=1e-6) and got["short"]["d"] is None and got["short"]["r"] is not None
    assert structure.all_metrics(atoms, refs, criteria, threshold=50.0).count() == 0


def test_metric_files_merge_in_name_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PDB,plddt,m\nx,80,1\ny,80,2\nz,50,9\n")
    (tmp_path / "b.csv").write_text("PDB,plddt,m\nx,81,5\ny,82,\n")
    got = {r["PDB"]: (r["plddt"], r["m"]) for r in tables.read_metrics(spark, str(tmp_path), ["m"], 50).collect()}
    assert got == {"x": (81.0, 5.0), "y": (82.0, 2.0)}


def test_vote_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("sequence_id,bin,Vote_Count,Total_Votes\na,3,2,4\n")
    got = tables.read_voting_results(spark, str(tmp_path / "v.csv")).first()
    assert (got["Sequence_Header"], got["Bin_Assignment"], got["Total_Votes"]) == ("a", 3, 4)
    (tmp_path / "raw.json").write_text('{"a": [1, 1], "b": [2]}')
    assert sorted(tuple(r) for r in votes_json.read_raw_votes(spark, str(tmp_path / "raw.json")).collect()) == [("a", 1), ("a", 1), ("b", 2)]
    tables.write_raw_votes(votes_json.read_raw_votes(spark, str(tmp_path / "raw.json")), str(tmp_path / "lines"))
    assert votes_json.read_raw_votes(spark, str(tmp_path / "lines")).count() == 3


def test_histograms_close_the_last_bin(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 0.5), (2, 2.0)], "iteration int, m double")
    got = distributions.hist_1d(df, "m", 4).orderBy("bin").toPandas()
    assert list(got["n"]) == list(np.histogram([0.0, 1.0, 0.5, 2.0], 4)[0])
    by = distributions.hist_by_iteration(df, "m", 0, 1, 0.5).toPandas()
    assert by.groupby("iteration")["n"].sum().to_dict() == {1: 3, 2: 0}
    assert len(distributions.kde_marginals(df.limit(1), "m").collect()) == 0


def test_recompile_and_manifest(spark):
    results = spark.createDataFrame([("a", 1, 2, 3), ("b", 2, 2, 3), ("c", 1, 2, 3)], "Sequence_Header string, Bin_Assignment int, Vote_Count long, Total_Votes long")
    source = spark.createDataFrame([(i, h, "S") for i, h in enumerate("abcdef")], "pos long, header string, seq string")
    out = stages.recompile_bins(results, source, params.Recompile(bins=(1, 2))).toPandas()
    assert out.groupby(["arm", "bin_label"]).size().to_dict() == {("control", "bin_1"): 2, ("control", "bin_2"): 1, ("prediction", "bin_1"): 2, ("prediction", "bin_2"): 1}
    jobs = {r["job"] for r in recompile.prediction_manifest(results, [1, 5]).collect()}
    assert jobs == {"pred_bin1", "ctrl_pred_bin1"}
    assert {r["job"] for r in recompile.prediction_manifest(results, [5, 1], combine=True).collect()} == {"pred_bin_1_5", "ctrl_pred_bin_1_5"}


def test_parameters():
    made = params.from_dict({"voting": {"bins": 12}})
    assert made.voting.bins == 12 and made.enrichment.quantile == 0.2
    with pytest.raises(TypeError):
        params.from_dict({"voting": {"other": 1}})


def test_unions_by_path(spark):
    df = spark.createDataFrame([("Iteration_10/a.pdb", 1.0), ("Iteration_2/a.pdb", 2.0), ("x.pdb", 3.0)], "PDB string, m double")
    assert [r["iteration"] for r in stages.union_iterations(df).orderBy("iteration").collect()] == [2, 10]
    a = spark.createDataFrame([(1, "h", "A-")], "pos long, header string, seq string")
    assert stages.concat_groups([a, a]).count() == 1
