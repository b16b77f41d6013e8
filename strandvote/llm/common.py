"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is set, a local master gets a temporary one; on a cluster, whose machines have no folder in
    common unless one is named, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    It cuts the lineage and outlives executors: a lost task rereads the table, not the whole job.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that written made, when all that is computed from them is written too."""
    for df in tables:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(modulus)


def internal(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those that an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null equals null; the keys come once, from left."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    cond = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_right_{k}`")) for k in on]
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{k}" for k in on])


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashes(rows: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """Distinct by and key of most of the keys of rows at most, those of the least hash; by: so many for each value of that column.

    A share of the hash range that holds 4 * most keys or so is taken by a plain filter, and only what
    passes is ranked; so no task sees more, however many rows there are. The values of by are told to all
    tasks; a model that is fitted for each of them holds more than that.
    """
    groups = [by] if by else []
    counts = rows.groupBy(*groups).agg(F.approx_count_distinct(key).alias("_n"))
    place = (F.xxhash64(key) / F.lit(2.0**64)) + F.lit(0.5)
    near = rows.join(F.broadcast(counts), by) if by else rows.crossJoin(F.broadcast(counts))  # one row
    near = near.where(place <= F.lit(4.0 * most) / F.greatest("_n", F.lit(1))).select(key, *groups).distinct()
    order = W.partitionBy(*groups, F.lit(0)).orderBy(F.xxhash64(key), key)
    return near.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


#: A key with over 1 / PARTS of all rows, and LEAST rows at least, is hot; its one partner is repeated SALTS times.
PARTS, LEAST, SALTS = 300, 64, 32


def spread(left: DataFrame, right: DataFrame, on: list[str], by: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and in column weight the rows that left has for it; weight goes.

    So that no hot key lands in one task, its rows are dealt by the hash of column by to SALTS copies of its
    partner. Hot keys are PARTS at most, whatever the input, so the list of them may be broadcast. Null keys
    meet null keys.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.where(F.col(weight) > max(LEAST, total / PARTS)).select(*on).withColumn("_hot", F.lit(True))
    cond = lambda one, two: [F.col(f"{one}.`{k}`").eqNullSafe(F.col(f"{two}.`{k}`")) for k in on]
    marked = left.alias("l").join(F.broadcast(hot).alias("h"), cond("l", "h"), "left")
    marked = marked.select("l.*", F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(f"l.`{by}`")), F.lit(SALTS)).cast("int")).otherwise(0).alias("_salt"))
    salts = F.when(F.col(weight) > max(LEAST, total / PARTS), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    partners = right.withColumn("_salt", F.explode(salts)).drop(weight)
    return joined(marked, partners, [*on, "_salt"], how).drop("_salt")
