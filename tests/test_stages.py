"""Writers, strict inputs, exact quantiles, and all stages in one run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandvote.functions import binning
from strandvote.operators import distributions, filters, recompile, sampling
from strandvote.plans import commit, params, run, stages
from strandvote.sources import alignments, tables


def msa_of(spark, n):
    return spark.range(n).select(F.col("id").alias("pos"), F.concat(F.lit("h"), "id").alias("header"), F.lit("ACDE").alias("seq"))


def test_entries_without_a_sequence_go(spark):
    rows = spark.createDataFrame([(1, "a", "acd1"), (2, "b", "A1"), (3, "", "A")], "pos long, header string, seq string")
    assert [tuple(r) for r in recompile.distinct_entries(rows).collect()] == [(2, "b", "A")]


def test_writers(spark, tmp_path):
    msa = spark.createDataFrame([(2, "b x", "DE"), (1, "a", "AC")], "pos long, header string, seq string")
    alignments.write_combined(msa, str(tmp_path / "all"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part*.txt"))) == ">a\nAC\n>b\nDE\n"
    ranked = sampling.make_shuffles(msa_of(spark, 300), 2, 16).join(msa_of(spark, 300).select("header", "seq"), "header")
    alignments.write_shuffle_order(ranked, str(tmp_path / "order"))
    for shuffle in (1, 2):
        text = "".join(p.read_text() for p in sorted((tmp_path / "order" / f"shuffle={shuffle}").glob("part*.txt")))
        want = [r["header"] for r in ranked.where(F.col("shuffle") == shuffle).orderBy("rank").collect()]
        assert [x[1:] for x in text.split("\n") if x.startswith(">")] == want
    tables.write_metrics(spark.createDataFrame([("p", 80.0, 1.5)], "PDB string, plddt double, m double"), str(tmp_path / "m"))
    assert tuple(tables.read_metrics(spark, str(tmp_path / "m"), ["m"]).first()) == ("p", 80.0, 1.5)
    votes = spark.createDataFrame([("a", 3, 2, 4)], "Sequence_Header string, Bin_Assignment int, Vote_Count long, Total_Votes long")
    tables.write_voting_results(votes, str(tmp_path / "v"))
    assert tables.read_voting_results(spark, str(tmp_path / "v")).collect() == votes.collect()


def test_strict_inputs(spark):
    none = msa_of(spark, 0).withColumn("m", F.lit(1.0))
    for call in (lambda: filters.filter_by_coverage(none, strict=True), lambda: binning.bin_1d(none, "m", strict=True), lambda: binning.bin_focused(none, "m", 5, strict=True), lambda: sampling.make_shuffles(none, 1, 5, strict=True), lambda: stages.concat_groups([])):
        with pytest.raises(ValueError):
            call()


def test_arms_without_a_second_metric(spark):
    schema = "bin_label string, PDB string, m1 double, m2 double, plddt double"
    pred = spark.createDataFrame([("bin_1", "a_seed_001.pdb", 1.0, None, 80.0), ("bin_2", "b.pdb", 1.0, 2.0, 80.0), ("bin_2", "c.pdb", 1.0, None, 80.0)], schema)
    control = spark.createDataFrame([("bin_1", "d.pdb", 1.0, 3.0, 80.0)], schema)
    got = {(r["arm"], r["PDB"]) for r in distributions.arm_metrics(pred, control, "m1", "m2").collect()}
    assert got == {("prediction", "b.pdb"), ("prediction", "c.pdb"), ("control", "d.pdb")}
    assert distributions.arm_metrics(pred, control, "m1", None).count() == 0


def test_named_criteria_of_enrichment(spark):
    metrics = spark.createDataFrame([(i, float(i), float(-i), 90.0) for i in range(10)], "structure_id int, a double, b double, plddt double")
    criteria = [{"name": "a", "method": "above"}, {"name": "b", "method": "above"}]
    kept = lambda *names: {r["structure_id"] for r in stages.kept_groups(metrics, criteria, params.Enrichment(quantile=0.2, criteria=names)).collect()}
    assert kept() == set() and kept("a") == {8, 9} and kept("b") == {0, 1} and kept("other") == set()


def test_all_stages_run_and_resume(spark, tmp_path):
    """A stand-in predictor scores a group by its members' numbers; the second run predicts nothing anew."""
    calls = []

    def predict(members, keys, models, seeds):
        calls.append((tuple(keys), models, seeds))
        number = F.regexp_extract("header", "[0-9]+", 0).cast("double")
        out = members.groupBy(*keys).agg(F.avg(number).alias("m1"), F.max(number).alias("m2"), F.lit(90.0).alias("plddt"))
        return out.withColumn("PDB", F.concat_ws("_", *keys, F.lit("seed_001.pdb")))

    settings = params.from_dict({"enrichment": {"iterations": 2, "shuffles": 3, "group_size": 5, "quantile": 0.5, "combine_threshold": 10.0}, "splits": {"group_size": 6}, "voting": {"bins": 4}, "recompile": {"bins": (0, 1, 2, 3, 4), "models": 2, "seeds": 3}})
    criteria = [{"name": "m1", "type": "tmscore", "method": "above"}, {"name": "m2", "type": "other"}]
    out = run.run(msa_of(spark, 60), settings, criteria, predict, str(tmp_path / "run"))
    sizes = {k: v.count() for k, v in out.items()}
    assert all(sizes.values()) and len(calls) == 4 and calls[-1] == (("arm", "bin_label"), 2, 3)
    assert {r["n_prediction"] for r in out["arms"].collect()} == {1} and out["votes"].agg(F.sum("Vote_Count")).first()[0] > 0
    again = run.run(msa_of(spark, 60), settings, criteria, predict, str(tmp_path / "run"))
    assert len(calls) == 4 and {k: v.count() for k, v in again.items()} == sizes
    with pytest.raises(ValueError, match="alignment"):
        run.run(msa_of(spark, 0), settings, criteria, predict, str(tmp_path / "none"))
    # a stage without its manifest is what a stopped run left: it is made again, and so is what came from it
    stopped = tmp_path / "run" / "votes"
    (stopped / "manifest.json").unlink()
    with pytest.raises(commit.StaleStage, match="recompiled.*inputs"):
        run.run(msa_of(spark, 60), settings, criteria, predict, str(tmp_path / "run"))
    assert len(list(stopped.glob("data-*"))) == 1 and len(calls) == 4
    redone = run.run(msa_of(spark, 60), settings, criteria, predict, str(tmp_path / "run"), stale="rerun")
    assert {k: v.count() for k, v in redone.items()} == sizes and len(calls) == 5
    # another alignment is noticed; a header listed twice counts once, with its last sequence
    with pytest.raises(commit.StaleStage, match="inputs"):
        run.run(msa_of(spark, 61), settings, criteria, predict, str(tmp_path / "run"))
    twice = msa_of(spark, 60).withColumn("seq", F.lit("A")).unionByName(msa_of(spark, 60).withColumn("pos", F.col("pos") + 100))
    one = run.run(twice, settings, criteria, predict, str(tmp_path / "twice"))
    assert {k: v.count() for k, v in one.items()} == sizes


def test_a_run_without_passing_rows_is_an_error(spark, tmp_path):
    """An enrichment that filters all away, or an alignment without coverage, ends the run and commits nothing."""

    def predict(members, keys, models, seeds):
        return members.select(*keys).distinct().withColumns({"m1": F.lit(1.0), "plddt": F.lit(10.0), "PDB": F.lit("x.pdb")})

    base = {"enrichment": {"iterations": 1, "shuffles": 1, "group_size": 5}}
    with pytest.raises(ValueError, match="alignment"):
        run.run(msa_of(spark, 20), params.from_dict(base), [{"name": "m1", "type": "tmscore", "method": "above"}], predict, str(tmp_path / "low"))
    assert not (tmp_path / "low/enrichment/iteration_1/alignment/manifest.json").exists() and (tmp_path / "low/enrichment/iteration_1/metrics/manifest.json").exists()
    gaps = msa_of(spark, 20).withColumn("seq", F.lit("----"))
    with pytest.raises(ValueError, match="shuffles"):
        run.run(gaps, params.from_dict(base), [{"name": "m1", "type": "tmscore", "method": "above"}], predict, str(tmp_path / "gaps"))
    none = msa_of(spark, 0).withColumns({"m": F.lit(1.0), "plddt": F.lit(1.0), "structure_id": F.lit(1)})
    for call in (lambda: stages.m_fold(gaps, params.Splits(), strict=True), lambda: stages.prepare_iteration(gaps, params.Enrichment(), strict=True), lambda: stages.vote(none, none, None, "m", params.Voting(), ["structure_id"], strict=True)):
        with pytest.raises(ValueError):
            call()


def test_only_missing_groups_are_predicted(spark, tmp_path):
    """Structures that a stopped predictor left are taken as they are."""
    asked = []

    def score(members, keys):
        return members.groupBy(*keys).agg(F.count("*").cast("double").alias("m1"), F.lit(90.0).alias("plddt"), F.lit("a.pdb").alias("PDB"))

    def predict(members, keys, models, seeds):
        asked.append({tuple(r) for r in members.select(*keys).distinct().collect()})
        return score(members, keys)

    members = spark.createDataFrame([(g, f"h{i}") for i, g in enumerate([1, 1, 2, 2, 3])], "grp int, header string")
    got = run.predicted(members, ["grp"], 1, 1, predict, lambda keys: score(members.where("grp <> 2"), keys))
    assert asked == [{(2,)}] and got.orderBy("grp").select("grp", "m1").collect() == score(members, ["grp"]).orderBy("grp").select("grp", "m1").collect()
    run.predicted(members, ["grp"], 1, 1, predict, lambda keys: score(members, keys))
    assert len(asked) == 1
