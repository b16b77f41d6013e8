"""Sequences by header, duplicates and recompiled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bin_label, header_key, strict_residues


def last_wins(rows: DataFrame, keys: list[str], order: str = "pos", value: str = "seq") -> DataFrame:
    """Of a repeated key the first place and the last value."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(value, order).alias(value))


def distinct_entries(rows: DataFrame, query: str = "101", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """A10: distinct (header, cleaned sequence) at the first place of each; rows of the query, without a header or with nothing left of their sequence go."""
    clean = rows.where((F.col("header") != "") & (header_key("header") != query)).withColumn("seq", strict_residues("seq")).where("seq <> ''")
    return clean.groupBy("header", "seq").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*", "header", "seq")


def header_set(msa: DataFrame) -> DataFrame:
    """Distinct header keys."""
    return msa.select(header_key("header").alias("header")).distinct()


def map_and_extract(headers: DataFrame, msa: DataFrame) -> DataFrame:
    """The sequences of a list of headers (pos, header), in its order."""
    return headers.select("pos", "header").join(last_wins(msa, ["header"]).select("header", "seq"), "header")


def missing_headers(headers: DataFrame, msa: DataFrame) -> DataFrame:
    """The listed headers that the alignment lacks."""
    return headers.join(msa.select("header"), "header", "left_anti")


def compile_sequences(msa: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of the alignment whose header is chosen; pos keeps their order."""
    return msa.join(headers.select("header"), "header", "left_semi")


def missing_predictions(groups: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose structure hasn't come."""
    return groups.join(structures.select(*keys), keys, "left_anti")


def groups_of_kept(members: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the groups whose structure was kept."""
    return members.join(kept.select(*keys), keys, "left_semi")


def prediction_manifest(results: DataFrame, bins: list[int], combine: bool = False) -> DataFrame:
    """M1: arm, bin_label and job of each set that isn't empty; combine makes one set of all bins."""
    chosen = results.where(F.col("Bin_Assignment").isin(bins))
    if combine:
        label = bin_label(F.array(*map(F.lit, bins)))
        labels = chosen.limit(1).select(label.alias("bin_label"), F.regexp_replace(label, "^bin_", "bin_").alias("part"))
    else:
        labels = chosen.select("Bin_Assignment").distinct().select(F.concat(F.lit("bin_"), "Bin_Assignment").alias("bin_label"), F.concat(F.lit("bin"), "Bin_Assignment").alias("part"))
    arm = F.explode(F.array(F.struct(F.lit("prediction").alias("arm"), F.lit("pred_").alias("p")), F.struct(F.lit("control").alias("arm"), F.lit("ctrl_pred_").alias("p"))))
    return labels.select("bin_label", "part", arm.alias("a")).select("a.arm", "bin_label", F.concat("a.p", "part").alias("job"))
