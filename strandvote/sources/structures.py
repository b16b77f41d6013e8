"""Structures: atom tables from fixed-width files (S2), listings (S3), job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import group_path, iteration_of, number_after, round_of, seed_of


def _field(first: int, last: int) -> Column:
    return F.trim(F.substring("value", first, last - first + 1))


def parse_atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of lines (structure_id, line_no, value) in the fixed columns of the PDB format.

    MODEL records number the atoms after them (1 without any). Of alternative locations of an atom the
    one of the highest occupancy stays, the earlier one in a tie.
    """
    number = F.when(F.col("value").startswith("MODEL "), F.trim(F.substring("value", 11, 4)).try_cast("int"))
    lines = lines.withColumn("model", F.coalesce(F.max(number).over(W.partitionBy("structure_id").orderBy("line_no")), F.lit(1)))
    double = lambda a, b: _field(a, b).try_cast("double")
    atoms = lines.where(F.substring("value", 1, 6).isin("ATOM  ", "HETATM")).select(
        "structure_id", "line_no", "model", _field(1, 6).alias("record"), _field(13, 16).alias("atom_name"), _field(17, 17).alias("altloc"), _field(18, 20).alias("res_name"),
        _field(22, 22).alias("chain"), _field(23, 26).try_cast("int").alias("res_seq"), _field(27, 27).alias("icode"), double(31, 38).alias("x"), double(39, 46).alias("y"),
        double(47, 54).alias("z"), double(55, 60).alias("occupancy"), double(61, 66).alias("b_factor"), _field(77, 78).alias("element"),
    )
    same = W.partitionBy("structure_id", "model", "chain", "res_seq", "icode", "atom_name").orderBy(F.col("occupancy").desc_nulls_last(), "line_no")
    several = atoms.where("altloc <> ''").withColumn("at", F.row_number().over(same)).where("at = 1").drop("at")
    return atoms.where("altloc = ''").unionByName(several)


def read_pdb_atoms(spark: SparkSession, path: str) -> DataFrame:
    """The atom table of all structure files under path; structure_id is the file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdb").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("structure_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    at = F.row_number().over(W.partitionBy("structure_id").orderBy("block", "id")).cast("long")
    return parse_atoms(raw.select("structure_id", at.alias("line_no"), "value"))


def structure_keys(paths: DataFrame, path: str = "path") -> DataFrame:
    """Keys that folder and file names hold, beside the path; folders named non_a3m are left out."""
    p = F.col(path)
    return exclude_path(paths, path).select(
        *paths.columns, group_path(p).alias("group_file"), seed_of(p).alias("seed"), round_of(p).alias("round"), iteration_of(p).alias("iteration"),
        number_after(p, "shuffle").alias("shuffle"), number_after(p, "sampling").alias("sampling"), number_after(p, "group").alias("group"),
    )


def exclude_path(paths: DataFrame, path: str = "path", token: str = "non_a3m") -> DataFrame:
    """drop paths whose parent folder's path has the token."""
    parent = F.regexp_replace(F.col(path), "[^/]*$", "")
    return paths.where(~F.contains(parent, F.lit(token)))


def list_structures(spark: SparkSession, root: str) -> DataFrame:
    """S3: all structure files under root with their keys; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdb").option("recursiveFileLookup", True).load(root).select("path")
    return structure_keys(files)


def job_log_status(spark: SparkSession, root: str) -> DataFrame:
    """Dir and done, whether its log says Done."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "log.txt").text(root)
    return log_status(lines.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("dir"), "value"))


def log_status(lines: DataFrame) -> DataFrame:
    """dir and done from log lines (dir, value)."""
    return lines.groupBy("dir").agg(F.coalesce(F.bool_or(F.contains("value", F.lit("Done"))), F.lit(False)).alias("done"))
