"""Metrics, votes and criteria on disk (S4-S6, K3-K5; raw votes are read by votes_json)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import expand_indices

#: Column names that voting results may have on disk.
ALIASES = {"bin": "Bin_Assignment", "sequence_id": "Sequence_Header"}


def merge_metric_files(rows: DataFrame, names: list[str], key: str = "PDB", order: str = "source") -> DataFrame:
    """One row a structure; of each metric the value of the last file, by name, that has one."""
    last = [F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in names]
    return rows.groupBy(key).agg(*last)


def read_metrics(spark: SparkSession, path: str, names: list[str], plddt_threshold: float = 0.0) -> DataFrame:
    """PDB and the named metrics of one CSV file or a folder of them; rows of plddt at or below the threshold go."""
    wanted = list(dict.fromkeys(["plddt", *names]))
    files = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    have = [n for n in wanted if n in files.columns]
    if not any(n in have for n in names):
        raise ValueError(f"no metric of {names} in {path}")
    rows = files.select("PDB", *[F.col(n).try_cast("double").alias(n) for n in have], F.col("_metadata.file_name").alias("source"))
    rows = rows.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in have})
    out = merge_metric_files(rows, have)
    return out.where(F.col("plddt") > plddt_threshold) if "plddt" in have else out


def read_voting_results(spark: SparkSession, path: str) -> DataFrame:
    """Voting results with their columns' usual names and types."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})
    ints = [c for c in df.columns if c.startswith("Bin_Assignment")]
    return df.withColumns({c: F.col(c).cast("int") for c in ints} | {c: F.col(c).cast("long") for c in ("Vote_Count", "Total_Votes") if c in df.columns})


def load_criteria(text: str) -> dict:
    """The criteria of a JSON text; without filter_criteria it is an error."""
    out = json.loads(text)
    if not out.get("filter_criteria"):
        raise ValueError("filter_criteria is missing")
    return out


def criterion_residues(spark: SparkSession, path: str) -> DataFrame:
    """Name, type, method, role and res_seq of every residue that a criterion names. Roles: sup, rms, set1, set2, domain1, domain2, hinge."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # a settings file
    return spark.createDataFrame(criterion_rows(load_criteria(text)), "name string, type string, method string, role string, res_seq int")


def criterion_rows(criteria: dict) -> list[tuple]:
    whole = expand_indices(criteria.get("basics", {}).get("full_index"))
    out = []
    for c in criteria["filter_criteria"]:
        roles = dict(c.get("indices") or {})
        if c["type"] in ("rmsd", "all_atom_rmsd", "tmscore"):
            roles = {"sup": c.get("superposition_indices") or whole, "rms": c.get("rmsd_indices") or whole}
        out += [(c["name"], c["type"], c.get("method"), role, n) for role, spec in roles.items() for n in expand_indices(spec)]
    return out


def write_metrics(df: DataFrame, path: str) -> None:
    """K3."""
    df.write.option("header", True).csv(path)


def write_voting_results(df: DataFrame, path: str) -> None:
    """K4."""
    df.write.option("header", True).csv(path)


def write_raw_votes(votes: DataFrame, path: str) -> None:
    """K5: a JSON line of header and bins for each header."""
    from ..operators.voting import raw_votes

    raw_votes(votes).write.json(path)
