"""Sharding by a Feistel permutation, with cycle walking, over global row numbers.

Rows are numbered in the order of (doc_id, text crc32, size): range partitions are sorted side by
side and shifted by the counts of those before them, so no task sees all rows. A keyed permutation of
0..n-1 gives each row its place in a shuffle; place p goes to shard p mod shards, slot p div shards.
Shard, slot and their inverse are computable from the row number alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import internal, table, written

SHARDS, KEY, ROUNDS, PRIME = 24, 20240229, 6, (1 << 31) - 1


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Multiplier, addend and second addend of each round, from a Lehmer generator."""
    out, x = [], key % PRIME or 1
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = x * 48271 % PRIME
            row.append(x)
        out.append(tuple(row))
    return out


def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square rectangle of at least n cells; it has under sqrt(n) cells more."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Places of row numbers x under the permutation of 0..n-1; inverse: row numbers of places x.

    The Feistel network runs on the two digits of a number in a rectangle of a * b >= n cells. A place
    of n or more is put through again until it is below n (cycle walking), which keeps the map one to one.
    """
    a, b = sides(n)
    keys = list(enumerate(round_keys(key)))
    if inverse:
        keys.reverse()
    out = np.asarray(x, np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for i, (m, c, d) in keys:
            source, size = (right, a) if i % 2 == 0 else (left, b)
            t = (source * m + c) % PRIME
            t = (t * t + d) % PRIME % size
            t = -t if inverse else t
            if i % 2 == 0:
                left = (left + t) % a
            else:
                right = (right + t) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def numbered(rows: DataFrame, order: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """rows with row_number from 0 in the given order (equal rows in any order), and their count.

    The sorted ranges are written once, so that numbers and offsets come from the same ranges.
    """
    spark = rows.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "rows")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = ranged.count()
    out = ranged.join(before.select("_part", "_before"), "_part")
    return out.withColumn("row_number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), total


def sharded(docs: DataFrame, shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, with place, the row's place in the shuffle.

    Counts of shards differ by one at most. A null text has no bytes (size 8, crc32 of nothing: 0);
    null ids come first; repeated rows get places of their own. More shards deal all rows anew, so
    grown_shard is null. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, key))

    rows = rows.withColumn("place", place("row_number"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "place",
    )


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(internal(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("place")


#: crc32 by its 256-entry table, as DuckDB has no such function.
_CRC = """
entries AS (
  SELECT list(c ORDER BY i) AS entry FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crc AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda c, b: xor(entry[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM rows, entries)"""


def _sql_round(i: int, m: int, c: int, d: int) -> str:
    source, size = ("y", "a") if i % 2 == 0 else ("x", "b")
    t = f"((({source} * {m} + {c}) % {PRIME}) * (({source} * {m} + {c}) % {PRIME}) + {d}) % {PRIME} % {size}"
    return f"SELECT id, (x + {t}) % a AS x, y, a, b, n" if i % 2 == 0 else f"SELECT id, x, (y + {t}) % b AS y, a, b, n"


def op8_sql() -> str:
    """The same numbers in SQL: six rounds, and two more turns of the network for places of n or more."""
    steps, last = [], "start"
    for turn in range(3):
        for i, keys in enumerate(round_keys(KEY)):
            steps.append(f"t{turn}r{i} AS ({_sql_round(i, *keys)} FROM {last})")
            last = f"t{turn}r{i}"
        before = "start" if turn == 0 else f"w{turn - 1}"
        pick = "r.x AS x, r.y AS y" if turn == 0 else "CASE WHEN p.x * p.b + p.y >= p.n THEN r.x ELSE p.x END AS x, CASE WHEN p.x * p.b + p.y >= p.n THEN r.y ELSE p.y END AS y"
        steps.append(f"w{turn} AS (SELECT p.id, {pick}, p.a, p.b, p.n FROM {before} p JOIN {last} r ON p.id = r.id)")
        last = f"w{turn}"
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, coalesce(text, '') AS text FROM documents),
{_CRC},
numbered AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS id, count(*) OVER () AS n FROM crc),
squared AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered),
start AS (SELECT id, id // b AS x, id % b AS y, a, b, n FROM (SELECT id, a, CAST((n + a - 1) // a AS BIGINT) AS b, n FROM squared)),
{", ".join(steps)}
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((x * b + y) % {SHARDS} AS INTEGER) AS shard, (x * b + y) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM {last} JOIN numbered USING (id)
"""
