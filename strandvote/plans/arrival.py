"""Structures that arrive bit by bit: which groups are still to be predicted, and votes that grow with what has come.

Structures are read by a file stream that takes what is there and stops. Each of its batches has a number that
its checkpoint remembers; all that a batch makes is written under that number, in place of what an earlier
attempt at it left, so every structure counts exactly once, however often a run is stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recompile, voting
from ..sources.structures import parse_atoms
from .commit import Folder
from .params import Voting
from .stages import structure_bins


def structure_stream(spark: SparkSession, root: str) -> DataFrame:
    """S2 as a stream: structure_id (the file), line_no and value of the lines of structure files under root, new ones only in each run."""
    files = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdb").text(root)
    return files.select(F.col("_metadata.file_path").alias("structure_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long") + 1)


def absorb(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None]) -> int:
    """Give handle every batch of what has come since the last call, by its number, and return the number of batches so far."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len([n for n in Folder(stream.sparkSession, f"{path}/checkpoint/commits").names() if n.isdigit()])


class Batches:
    """A table in parts, one a batch; a part written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def all(self) -> DataFrame:
        """All rows so far; none at all before the first batch."""
        some = any(n.startswith("batch=") for n in Folder(self.spark, self.path).names())
        return self.spark.read.schema(self.schema).parquet(self.path) if some else self.spark.createDataFrame([], self.schema)


def missing_groups(groups: DataFrame, arrived: DataFrame, keys: list[str], jobs: DataFrame | None = None) -> DataFrame:
    """The groups to predict, those without a structure whose job isn't at work.

    jobs: keys and done, as job logs tell; a job that is done and left no structure is to run again, one
    that isn't done is waited for.
    """
    rest = recompile.missing_predictions(groups, arrived, keys)
    return rest if jobs is None else rest.join(jobs.where("NOT done").select(*keys), keys, "left_anti")


class VoteState:
    """A5, A6, C5 by increments: votes counted by header and bin, part by part, equal to one count of all.

    Bins need bounds that don't depend on the structures still to come, so params names both. The state is a
    table of header, bin_1 and n; counts of parts add up, in any order.
    """

    def __init__(self, spark: SparkSession, path: str, header: str = "string", params: Voting | None = None, metric: str = ""):
        params = params or Voting()
        if params.lo is None or params.hi is None:
            raise ValueError("votes by increments need bounds of the bins, lo and hi")
        self.params, self.metric, self.spark, self.path = params, metric, spark, path
        self.parts = Batches(spark, f"{path}/votes", f"header {header}, bin_1 int, n long, batch long")

    def add(self, metrics: DataFrame, members: DataFrame, source: DataFrame | None, keys: list[str], number: int) -> None:
        """Count the votes of the structures of a batch; again with the same number, they take the place of the first attempt."""
        cast = voting.cast_votes(members, structure_bins(metrics, self.metric, self.params), source, keys, ["bin_1"])
        self.parts.put(voting.vote_counts(cast, ["bin_1"]), number)

    def counts(self) -> DataFrame:
        return self.parts.all().groupBy("header", "bin_1").agg(F.sum("n").alias("n"))

    def consensus(self) -> DataFrame:
        """A6 of all votes so far."""
        return voting.consensus_bin(self.counts(), ["bin_1"])


def absorb_structures(spark: SparkSession, root: str, path: str, score: Callable[[DataFrame], DataFrame], schema: str) -> Batches:
    """Score the structure files that have come under root since the last call (atoms -> metrics of schema), and return all metrics so far."""
    metrics = Batches(spark, f"{path}/metrics", f"{schema}, batch long")
    absorb(structure_stream(spark, root), path, lambda lines, number: metrics.put(score(parse_atoms(lines)), number))
    return metrics


def absorb_votes(stream: DataFrame, path: str, state: VoteState, members: DataFrame, source: DataFrame | None, keys: list[str]) -> VoteState:
    """Let the structures of a stream of metrics vote as they come."""
    absorb(stream, path, lambda metrics, number: state.add(metrics, members, source, keys, number))
    return state
