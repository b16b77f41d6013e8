"""The engine's tables, made from the star-schema tables: which columns stand for groups, headers, metrics and atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESIDUES = 21
BACKBONE = (("N", "N"), ("CA", "C"), ("C", "C"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id (the group), header and pos."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("structure_id"), F.col("l_partkey").alias("header"), F.col("l_linenumber").alias("pos"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id, metric1, metric2, plddt, seq_count, iteration, round and arm."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("metric2"), F.round(2 * F.avg("l_quantity"), 6).alias("plddt"), F.count("*").alias("seq_count")
    )
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(
        F.col("o_orderkey").alias("structure_id"), F.col("o_totalprice").alias("metric1"), "metric2", "plddt", "seq_count",
        F.year("o_orderdate").alias("iteration"), (F.col("o_orderkey") % 3).cast("int").alias("round"),
        F.when(F.col("o_orderkey") % 2 == 0, "prediction").otherwise("control").alias("arm"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, header and seq of the source alignment."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("header"), F.concat_ws("-", F.upper("p_brand"), "p_type").alias("seq"))


def other_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that lacks some headers of the groups, for the queries that show what becomes of those."""
    return source(spark, sf_dir).where("header % 5 <> 0")


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, line (a header with a description) and seq of an alignment of texts; its gap character is a space."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit(">d"), F.col("doc_id"), F.lit(" "), F.col("source")).alias("line"), F.col("text").alias("seq"))


def a3m_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id and text of one alignment file a document: a record a line of it, in pieces of 40 characters with empty lines between."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit(">d"), (i % 7).cast("string"), F.lit(" x\n"), F.regexp_replace(F.replace(s, F.lit(">"), F.lit(")")), "(.{40})", "$1\n\n")))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("before\n"), F.array_join(lines, "\n")).alias("text"))


def ca_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CA trace of 21 residues from each embedding."""
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), F.col("embedding").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(RESIDUES))).alias("res_seq"))
    at = lambda i: F.element_at("v", (F.col("res_seq") - 1) * 3 + i).cast("double")
    return points.select(
        "structure_id", F.lit(1).alias("model"), F.lit("ATOM").alias("record"), F.lit("CA").alias("atom_name"), F.lit("C").alias("element"), F.lit("A").alias("chain"), F.lit("GLY").alias("res_name"),
        "res_seq", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), (F.col("structure_id") % 100).cast("double").alias("b_factor"),
    )


def backbone_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven residues of N, CA and C from each embedding, in the order of lines."""
    atoms = ca_atoms(spark, sf_dir).withColumn("line_no", F.col("res_seq").cast("long"))
    kind = (F.col("line_no") - 1) % 3
    pick = lambda j: F.element_at(F.array(*[F.lit(a[j]) for a in BACKBONE]), (kind + 1).cast("int"))
    letter = F.element_at(F.array(*[F.lit(x) for x in ("GLY", "ALA", "SER")]), (F.col("structure_id") % 3 + 1).cast("int"))
    return atoms.withColumns({"atom_name": pick(0), "element": pick(1), "res_seq": (F.floor((F.col("line_no") - 1) / 3) + 1).cast("int"), "res_name": letter})


def pdb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id, line_no and value: backbone atoms in fixed columns."""
    a = backbone_atoms(spark, sf_dir)
    value = F.format_string(
        "ATOM  %5d  %-3s %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", "line_no", "atom_name", "res_name", "res_seq",
        F.col("x") * 10, F.col("y") * 10, F.col("z") * 10, F.lit(1.0), "b_factor", "element",
    )
    return a.select("structure_id", "line_no", value.alias("value"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """structure_id and path of a structure file."""
    k = F.col("o_orderkey")
    folder = F.when(k % 10 == 0, "/non_a3m").otherwise("")
    path = F.concat(F.lit("run/round_"), k % 3, F.lit("/02_sampling/sampling_"), k % 7, folder, F.lit("/group_"), k % 11, F.lit("_unrelaxed_rank_001_model_1"), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("_seed_"), F.lpad((k % 8).cast("string"), 3, "0"))), F.lit(".pdb"))
    return table(spark, sf_dir, "orders").select(k.alias("structure_id"), path.alias("path"))
