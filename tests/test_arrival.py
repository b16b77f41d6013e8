"""Structures that come between two runs, and votes that grow with them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandvote.operators import structure, voting
from strandvote.plans import arrival, params, stages

ATOM = "ATOM  {n:5d}  CA  GLY A{r:4d}    {x:8.3f}   0.000   0.000  1.00{b:6.2f}           C"


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.pdb").write_text("\n".join(ATOM.format(n=i, r=i, x=value * i, b=50.0 + value) for i in (1, 2)))


def score(atoms):
    metric = structure.residue_distance(atoms, [1], [2]).join(structure.plddt(atoms, [1, 2]), "structure_id")
    return metric.withColumn("structure_id", F.regexp_extract("structure_id", r"(\w+)\.pdb$", 1))


def test_late_structures_are_added_once(spark, tmp_path):
    root, path, schema = tmp_path / "in", str(tmp_path / "out"), "structure_id string, distance double, plddt double"
    put(root / "x", "a", 1.0)
    put(root, "b", 2.0)
    rows = lambda: sorted((r["structure_id"], round(r["distance"], 9)) for r in arrival.absorb_structures(spark, str(root), path, score, schema).all().collect())
    assert rows() == [("a", 1.0), ("b", 2.0)]
    assert rows() == [("a", 1.0), ("b", 2.0)]  # nothing new
    put(root / "y", "c", 3.0)
    both = rows()
    assert both == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    other = arrival.absorb_structures(spark, str(root), str(tmp_path / "at-once"), score, schema).all()
    assert sorted((r["structure_id"], round(r["distance"], 9)) for r in other.collect()) == both


def test_a_batch_that_fails_is_taken_again(spark, tmp_path):
    root, path, tries = tmp_path / "in", str(tmp_path / "out"), []
    put(root, "a", 1.0)

    def handle(lines, number):
        tries.append(number)
        parts.put(lines.select("structure_id").distinct(), number)
        if len(tries) == 1:
            raise RuntimeError("stopped after its rows were written")

    parts = arrival.Batches(spark, f"{path}/names", "structure_id string, batch long")
    with pytest.raises(Exception, match="stopped"):
        arrival.absorb(arrival.structure_stream(spark, str(root)), path, handle)
    assert arrival.absorb(arrival.structure_stream(spark, str(root)), path, handle) == 1
    assert tries == [0, 0] and parts.all().count() == 1
    assert arrival.Batches(spark, f"{path}/none", "a int, batch long").all().count() == 0


@pytest.fixture(scope="module")
def ballots(spark):
    metrics = spark.range(40).select(F.col("id").alias("g"), (F.col("id") % 11 / 10.0).alias("m"), F.lit(90.0).alias("plddt"))
    metrics = metrics.withColumn("m", F.when(F.col("g") % 13 != 5, F.col("m")))
    members = spark.range(40).select(F.col("id").alias("g"), F.explode(F.array(*[((F.col("id") * k) % 9).cast("string") for k in (1, 2, 5)])).alias("header"))
    return metrics, members


@pytest.mark.parametrize("focused", [True, False])
def test_votes_after_each_batch_equal_a_recount(spark, tmp_path, ballots, focused):
    metrics, members = ballots
    how = params.Voting(bins=5, lo=0.0, hi=1.0, focused=focused)
    state = arrival.VoteState(spark, str(tmp_path / "state"), params=how, metric="m")
    source = members.where("header <> '3'")
    assert state.consensus().count() == 0
    so_far = None
    for number, part in enumerate((metrics.where("g < 7"), metrics.where("g BETWEEN 7 AND 8"), metrics.where("g > 30"), metrics.where("g BETWEEN 9 AND 30"))):
        for _ in range(2):  # a batch that is written twice counts once
            state.add(part, members, source, ["g"], number)
        so_far = part if so_far is None else so_far.unionByName(part)
        want = stages.vote(members, so_far, source, "m", how, ["g"])
        assert sorted(map(tuple, state.consensus().collect())) == sorted(map(tuple, want.collect()))


def test_a_stream_of_metrics_votes(spark, tmp_path, ballots):
    metrics, members = ballots
    how = params.Voting(bins=5, lo=0.0, hi=1.0, focused=True)
    state = arrival.VoteState(spark, str(tmp_path / "state"), params=how, metric="m")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(metrics.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (metrics.where("g % 2 = 0"), metrics.where("g % 2 = 1")):
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        arrival.absorb_votes(stream, str(tmp_path / "state"), state, members, None, ["g"])
    want = voting.vote_counts(voting.cast_votes(members, stages.structure_bins(metrics, "m", how), None, ["g"], ["bin_1"]), ["bin_1"])
    assert sorted(map(tuple, state.counts().collect())) == sorted(map(tuple, want.collect()))


def test_bounds_are_needed(spark, tmp_path):
    with pytest.raises(ValueError, match="bounds"):
        arrival.VoteState(spark, str(tmp_path), params=params.Voting(bins=5), metric="m")


def test_missing_groups(spark):
    groups = spark.createDataFrame([(1,), (2,), (3,), (4,)], "g int")
    jobs = spark.createDataFrame([(2, False), (3, True)], "g int, done boolean")
    here = groups.where("g = 1")
    assert sorted(r["g"] for r in arrival.missing_groups(groups, here, ["g"]).collect()) == [2, 3, 4]
    assert sorted(r["g"] for r in arrival.missing_groups(groups, here, ["g"], jobs).collect()) == [3, 4]
