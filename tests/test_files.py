"""Single named files, and raw votes read by splits."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandvote import storage
from strandvote.operators import sampling
from strandvote.sources import alignments, named, votes_json


@pytest.fixture(scope="module")
def ranked(spark):
    msa = spark.range(70).select(F.col("id").alias("pos"), F.concat(F.lit("h"), "id", F.lit(" é")).alias("header"), F.concat(F.lit("AC-"), F.col("id").cast("string")).alias("seq"))
    return sampling.make_shuffles(msa, 3, 16).join(msa.select("header", "seq"), "header")


def plain(rows, query):
    """File contents as a plain writer makes them."""
    out = {}
    for shuffle in {r["shuffle"] for r in rows}:
        own = sorted((r for r in rows if r["shuffle"] == shuffle), key=lambda r: r["rank"])
        out[f"shuffle_{shuffle}/shuffle_{shuffle}.shuf"] = "".join(f">{r['header']}\n{r['seq']}\n" for r in own)
        for group in {r["group"] for r in own}:
            members = sorted((r for r in own if r["group"] == group), key=lambda r: r["rank"])
            out[f"shuffle_{shuffle}/group_{group}.a3m"] = f">101\n{query}\n" + "".join(f">{r['header']}\n{r['seq']}\n" for r in members)
    return {k: v.encode() for k, v in out.items()}


def test_files_are_those_of_a_plain_writer(spark, ranked, tmp_path):
    groups = ranked.select("shuffle", "group", F.col("rank").alias("pos"), "header", "seq")
    for _ in range(2):  # written again, files replace themselves
        named.write_group_files(groups, str(tmp_path / "out"), ["shuffle", "group"], "QQ")
        named.write_shuffle_files(ranked, str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == plain(ranked.collect(), "QQ")
    again = alignments.read_a3m(spark, str(tmp_path / "out/shuffle_1/group_2.a3m"))
    assert again.count() == 17 and again.orderBy("pos").first()["header"] == "101"


def test_a_failed_task_leaves_no_file(spark, ranked, tmp_path):
    rows = ranked.select(F.concat(F.lit("f_"), "group").alias("file"), "rank", F.when(F.col("rank") < 60, F.col("header")).otherwise(F.raise_error(F.lit("stopped")).cast("string")).alias("value"))
    with pytest.raises(PySparkException):
        named.write_named(rows, str(tmp_path / "out"), ["rank"])
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    named.write_named(ranked.limit(0).select(F.lit("x").alias("file"), "rank", F.col("header").alias("value")), str(tmp_path / "none"), ["rank"])
    assert not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]


ODD = ["", "a", ":", ",", '"', "\\", '\\"', '], "', '": [1], "', "{", "}", "[", "é\n", "x" * 300, 'a\\\\"]', "[1], [2]"]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("split", [7, 64, 10_000_000])
def test_objects_are_read_by_splits(spark, tmp_path, indent, split, monkeypatch):
    rng = random.Random(split)
    votes = {f"{rng.choice(ODD)}{i if i >= len(ODD) else ''}" if i >= len(ODD) else ODD[i]: [rng.randint(0, 30) for _ in range(rng.randint(0, 4))] for i in range(60)}
    (tmp_path / "v.json").write_text(json.dumps(votes, indent=indent, ensure_ascii=False))
    size = (tmp_path / "v.json").stat().st_size
    got = votes_json.read_raw_votes(spark, str(tmp_path / "v.json"), max(split, size // 40))
    want = sorted((h, b) for h, bins in votes.items() for b in bins)
    assert sorted((r["header"], r["bin"]) for r in got.collect()) == want
    if split == 7:
        tasks = got.select("header", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count()
        assert tasks > 10


def test_pieces_inside_a_split(tmp_path, monkeypatch):
    """Chunks that end anywhere, between backslashes too."""
    import pyarrow as pa

    votes = {f"{'\\' * (i % 5)}{i}\"": [i] for i in range(50)}
    text = json.dumps(votes).encode()
    (tmp_path / "v.json").write_bytes(text)
    for chunk in (1, 2, 3, 5, 11, 1000):
        monkeypatch.setattr(votes_json, "CHUNK", chunk)
        with pa.OSFile(str(tmp_path / "v.json")) as file:
            assert [(h, b) for h, b in votes_json._entries(file, len(text), 0, len(text), False)] == list(votes.items())


def test_folders_of_lines_and_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"header": "a", "bins": [1, 1]}\n{"header": "b", "bins": []}\n')
    (tmp_path / "in/b.json").write_text('{"c": [2],\n "a": [3]}')
    (tmp_path / "in/c.json").write_text("{}")
    (tmp_path / "in/_SUCCESS").write_text("")
    got = votes_json.read_raw_votes(spark, str(tmp_path / "in"), 8)
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 1), ("a", 3), ("c", 2)]
    with pytest.raises(FileNotFoundError):
        votes_json.read_raw_votes(spark, str(tmp_path / "absent"))


def test_records_are_dealt_as_their_number_needs(spark, tmp_path, monkeypatch):
    """A file in many splits and batches is numbered as it is read: no window, and as many partitions as its records need."""
    path = tmp_path / "long.a3m"
    path.write_text("".join(f">h{i % 700}\nS{i}\n" for i in range(1000)))
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    monkeypatch.setattr(storage, "DEALT", 100)
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        got = alignments.read_a3m(spark, str(path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and re.search(r"hashpartitioning\(msa_id#\d+, header#\d+, 10\)", plan)
        found = [(r["header"], r["seq"]) for r in got.orderBy("pos").collect()]
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert found == [(f"h{i}", f"S{i + 700 if i < 300 else i}") for i in range(700)]


def test_a_long_file_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """One task sorted and wrote all rows of a file."""
    seen = []
    monkeypatch.setattr(storage, "DEALT", 100)
    monkeypatch.setattr(storage, "stored", lambda df, tag, real=storage.stored: seen.append((tag, real(df, tag))) or seen[-1][1])
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, "b/short").otherwise("long").alias("file"), (-F.col("id")).alias("at"), F.col("id").cast("string").alias("value"))
    named.write_named(rows, str(tmp_path), ["at"])
    assert [int(x) for x in (tmp_path / "long").read_text().split()] == [i for i in range(2999, -1, -1) if i % 10]
    assert [int(x) for x in (tmp_path / "b/short").read_text().split()] == [i for i in range(2999, -1, -1) if i % 10 == 0]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b", "long"]
    assert dict(seen)["pieces"].where("file = 'long'").count() > 10
