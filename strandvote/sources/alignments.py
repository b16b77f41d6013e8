"""Alignments in A3M form (S1, S1b) and their export (K1, K2, K6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import header_key, strip_insertions
from ..operators.recompile import last_wins
from ..storage import dealt

QUERY = "101"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number in their split, from 1: a task reads the rows of a split one after the other."""
    last, before = None, 0
    for b in (b for b in batches if b.num_rows):
        file, block = b.column("msa_id").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy()
        starts = np.r_[0, np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1]
        lengths = np.diff(np.r_[starts, b.num_rows])
        number = np.arange(1, b.num_rows + 1) - np.repeat(starts, lengths)
        if (b.column("msa_id")[0].as_py(), block[0]) == last:
            number[: lengths[0]] += before
        last, before = (b.column("msa_id")[b.num_rows - 1].as_py(), block[-1]), int(number[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], [*b.schema.names, "number"])


def read_a3m(spark: SparkSession, path: str) -> DataFrame:
    """msa_id (the file), pos, header, seq of all records.

    Records are split by Spark's reader at '\\n>', so one file is read by many tasks. Text before the
    first header is left out; of a repeated header the first place and the last sequence count. pos
    orders the records of a file and has gaps: it is the first byte of the record's split plus its number in
    that split, whose records have two bytes or more each. Records are numbered as they are read and dealt once, by
    file and header, as their number needs.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("msa_id"), F.col("_metadata.file_block_start").alias("block"))
    text = F.regexp_replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), r"^\n+", "")
    ranked = raw.mapInArrow(_numbered, "value string, msa_id string, block long, number long").withColumn("pos", F.col("block") + F.col("number"))
    # the reader leaves the '>' of a file's first record only; a first record without it is text before any header
    records = ranked.withColumn("record", text).where((F.col("pos") > 1) | F.col("record").startswith(">"))
    lines = F.split(F.regexp_replace("record", "^>", ""), "\n")
    seq = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    out = records.select("msa_id", "pos", header_key(F.element_at(lines, 1)).alias("header"), strip_insertions(seq).alias("seq")).where("header <> ''")
    return last_wins(dealt(out.select("msa_id", "pos", "header", "seq"), raw.count(), "msa_id", "header"), ["msa_id", "header"])


def parse_a3m_text(files: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """file_id, pos, header, seq from whole files as rows. pos counts the records of a file from 1."""
    lines = files.select(F.col(file_id).alias("file_id"), F.posexplode(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")).alias("line", "value"))
    is_header = F.col("value").startswith(">")
    record = F.sum(is_header.cast("long")).over(W.partitionBy("file_id").orderBy("line"))
    lines = lines.withColumn("pos", record).where("pos > 0").withColumn("is_header", is_header)
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_header"), F.struct("line", F.regexp_replace("value", r"\s", "").alias("value")))))
    whole = lines.groupBy("file_id", "pos").agg(F.max(F.when(F.col("is_header"), F.col("value"))).alias("line"), F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("seq"))
    out = whole.select("file_id", "pos", header_key("line").alias("header"), strip_insertions("seq").alias("seq")).where("header <> ''")
    return last_wins(out, ["file_id", "header"])


def _records(df: DataFrame, header: Column) -> DataFrame:
    return df.withColumn("value", F.concat(F.lit(">"), header, F.lit("\n"), F.col("seq")))


def write_a3m(groups: DataFrame, path: str, keys: list[str], query_seq: str | None = None, query_header: str = QUERY) -> None:
    """K1: one folder a group (columns keys), one text file in it: the query record first, then members by pos."""
    rows = groups.select(*keys, "pos", "header", "seq")
    if query_seq is not None:
        query = rows.select(*keys).distinct().select(*keys, F.lit(-1).cast("long").alias("pos"), F.lit(query_header).alias("header"), F.lit(query_seq).alias("seq"))
        rows = rows.withColumn("pos", F.col("pos").cast("long")).unionByName(query)
    rows = _records(rows, F.col("header")).repartition(*keys).sortWithinPartitions(*keys, "pos")
    rows.select(*keys, "value").write.partitionBy(*keys).text(path)


def write_combined(msa: DataFrame, path: str) -> None:
    """K2: all records in order, without a query record."""
    _records(msa.orderBy("pos"), header_key("header")).select("value").write.text(path)


def write_shuffle_order(ranked: DataFrame, path: str) -> None:
    """K6: the whole alignment of each shuffle in shuffled order: a folder a shuffle, whose files follow each other by name."""
    rows = _records(ranked, F.col("header")).repartitionByRange("shuffle", "rank").sortWithinPartitions("shuffle", "rank")
    rows.select("shuffle", "value").write.partitionBy("shuffle").text(path)
