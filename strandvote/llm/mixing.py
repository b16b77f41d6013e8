"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a hash of its id. A source takes its documents in hash order, so a larger budget
takes a superset of a smaller one. The threshold at which a source's budget is met is found without
a sort: sum sizes by source and hash bucket, find the bucket in which the budget is met, and refine
that bucket alone. The first two levels have 256 buckets a source, so no source has many rows in one
window; the rows that a level leaves over, those of one bucket a source, are written for the next one.
Documents below the threshold are then taken by a plain filter on their own hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, forget, joined, spread, table, written
from .sharding import numbered

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: First hex digit of the hash, and digits, that each level refines.
LEVELS = ((1, 2), (3, 2), (5, 4), (9, 4), (13, 4))


def id_hash(doc_id: str, seed: str = "") -> Column:
    """64 bits of md5 of the id as hex. Rows with one id share it."""
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))), 1, 16)


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, size (words; null text: 0) and h, the hash of the id."""
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        id_hash("doc_id", seed).alias("h"),
    )


def targets(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """By source: source_size, documents and target.

    Sources in code point order, null last, weigh as weights, repeating, and share share times all
    sizes by weight; none gets over most times its size, and what is cut off is shared again. The level
    that the rest shares is found by aggregates over one row a source: each turn sets the level by the
    sources not yet at their limit, until no further one reaches it. Sources are ranked by range, so
    there may be as many as hosts.
    """
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    ranked, _ = numbered(by_source.withColumn("none", F.col("source").isNull()), ["none", "source"])
    w = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("row_number") % len(weights) + 1).cast("int")).cast("double"))
    w = written(w.select("source", "source_size", "documents", "weight", (F.col("source_size") * float(most)).alias("limit")), "mix-sources")
    total = float(w.agg(F.sum("source_size")).first()[0] or 0) * share
    level, at_limit = 0.0, -1
    while True:
        full = F.col("limit") <= F.lit(level) * F.col("weight") if at_limit >= 0 else F.lit(False)
        taken, rest, n = w.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("int"))).first()
        if rest is None or n == at_limit:
            break
        level, at_limit = (total - (taken or 0.0)) / rest, n
    return w.select("source", "source_size", "documents", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


#: Rows (one a source, of a few numbers) up to which a table of sources is broadcast.
BROADCAST_ROWS = 100_000


def beside(rows: DataFrame, by_source: DataFrame, by: str) -> DataFrame:
    """rows with the columns of their source, but documents: a broadcast if that table is small, else a join that spreads hot sources by column by."""
    if by_source.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return joined(rows, F.broadcast(by_source.drop("documents")), ["source"])
    return spread(rows, by_source, ["source"], by, "documents")


def thresholds(base: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (source, source_size, target) with whole, passes over all documents of the source, and cut: those with h < cut are taken once more.

    The document at the budget is taken if that brings the sum nearer to it (ties: not taken). Documents
    with one h go together.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    if "documents" not in goals.columns:
        goals = joined(goals, base.groupBy("source").agg(F.count("*").alias("documents")), ["source"], "left")
    goals = goals.withColumn("whole", whole)
    state = written(goals.select("source", "documents", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit("").alias("prefix")), "mix-level")
    open_rows = base.select("source", "size", "h")
    for start, digits in LEVELS:
        goal = state.where("left > 0 AND prefix IS NOT NULL")
        bucket = F.substring("h", start, digits)
        hist = open_rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        hist = joined(hist, goal, ["source"]).withColumn("upto", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")))
        at = hist.where("upto >= left").groupBy("source").agg(F.min(F.struct("bucket", "upto", "in_bucket")).alias("b"))
        state = joined(state, at, ["source"], "left")
        state = state.select("source", "documents", (F.col("left") - (F.col("b.upto") - F.col("b.in_bucket"))).alias("left"), F.concat("prefix", "b.bucket").alias("prefix"), F.col("b.in_bucket").alias("held"))
        state = written(state, "mix-level")
        if start < LEVELS[-1][0]:  # the next level reads one bucket a source
            found = beside(open_rows, state.where("prefix IS NOT NULL").select("source", "documents", "prefix"), "h")
            open_rows = written(found.where(F.substring("h", 1, start + digits - 1) == F.col("prefix")).select("source", "size", "h"), "mix-open")
    # the boundary bucket is one document, or several with one hash
    take = F.col("held") - F.col("left") < F.col("left")
    return joined(goals, state.select("source", _cut(F.col("prefix"), take).alias("cut")), ["source"])


def _cut(prefix: Column, take: Column) -> Column:
    """h < cut holds for all before prefix, and for prefix itself if take; null: nothing."""
    return F.when(prefix.isNotNull(), F.concat(prefix, F.when(take, F.lit("~")).otherwise(F.lit(""))))


def cuts(base: DataFrame) -> DataFrame:
    """By source: source_size, documents, target, whole and cut."""
    goals = written(targets(base), "mix-targets")
    return written(thresholds(base, goals), "mix-cuts")


def _copies(h: str) -> Column:
    return F.col("whole") + F.coalesce((F.col(h) < F.col("cut")).cast("long"), F.lit(0))


def mix(base: DataFrame) -> DataFrame:
    """base, as sizes() makes it and best written, with source_size, target and taken.

    A null source is a source of its own. Documents without words are taken 0 words. With no words at
    all, every target is 0.
    """
    out = beside(base, cuts(base), "h").withColumn("copies", _copies("h"))
    return out.select("doc_id", "source", "h", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as the mix takes it, none that it takes no word of.

    Copies are rows with the same values. Columns are those of docs. A row is kept or left by its own hash
    and its source's cut, so documents stay where they are.
    """
    base = written(sizes(docs), "mix-sizes")
    by_source = cuts(base).select("source", "documents", "whole", "cut")
    forget(base)
    rows = docs.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).select(F.struct("*").alias("row"), F.col("source"), id_hash("doc_id").alias("h"))
    out = beside(rows, by_source, "h").withColumn("copies", _copies("h")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op4_mix_source_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = written(sizes(table(spark, sf_dir, "documents")), "mix-sizes")
    return mix(base).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM base GROUP BY source),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(2.0 * source_size, weight * first_value(CASE WHEN level * weight < 2.0 * source_size THEN level END IGNORE NULLS)
           OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target
  FROM l),
r AS (
  SELECT b.*, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS whole,
         t.target - floor(t.target / nullif(t.source_size, 0)) * t.source_size AS budget,
         sum(size) OVER (PARTITION BY b.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY b.source, h) AS tied
  FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, coalesce(target, 0.0) AS target,
       CAST(size * (coalesce(whole, 0) + CASE WHEN budget > 0 AND (upto < budget OR (upto - tied < budget AND upto - budget < budget - (upto - tied))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
