"""TM-scores by iterated superposition from fragments.

One superposition over all pairs is dominated by what doesn't fit. Here poses begin with fragments, runs of
consecutive pairs: all of them, halves, quarters and so on, each overlapping the next by half. Every pose is made
anew over the pairs that it brings within a cut, until these stay the same; the best sum met on the way counts. All
poses of all structures move on together: a round is one aggregate of cross sums by structure and fragment and one
look at the pairs, and fragments that are stable drop out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import superpose as sp
from ..storage import stored
from .structure import KEY, _is_ca, _tm_sum, match_atoms

#: Pairs of the shortest fragment, and rounds after which a fragment that isn't stable is left.
LEAST, ROUNDS = 6, 20


def _fragments(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs with their place from 0, once for every fragment of their structure; chosen: inside it."""
    order = W.partitionBy(KEY)
    placed = pairs.withColumn("_at", F.row_number().over(order.orderBy("res_seq")) - 1).withColumn("_n", F.count("*").over(order).cast("int"))
    counts = placed.where("_at = 0").select(KEY, "_n")
    halvings = F.when(F.col("_n") > least, F.floor(F.log2(F.col("_n") / least)).cast("int")).otherwise(0)
    sized = counts.withColumn("_size", F.explode(F.transform(F.sequence(F.lit(0), halvings), lambda k: F.floor(F.col("_n") / F.pow(F.lit(2.0), k)).cast("int"))))
    last = F.col("_n") - F.col("_size")
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.greatest(F.lit(1), F.floor(F.col("_size") / 2).cast("int"))), last))
    fragments = sized.withColumn("_start", F.explode(starts)).select(KEY, "_size", "_start")
    return placed.join(fragments, KEY).withColumn("chosen", (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_size")))


def tm_score_searched(atoms: DataFrame, ref: DataFrame, chain: str = "A", name: str = "tm_searched", least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """structure_id and name, the best TM sum over residues paired by number, by the reference's length; no less than that of all pairs at once.

    The cut is the score's own distance, kept between 4.5 and 8, and no less than that of the third-nearest pair. A
    structure without a pose that its pairs determine has null.
    """
    own = _is_ca(ref).where((F.col("chain") == chain) & (F.col("model") == 1))
    length = own.agg(F.countDistinct("res_seq").cast("double").alias("_l"))
    d0 = F.when(F.col("_l") > 15, F.greatest(F.lit(0.5), 1.24 * F.cbrt(F.col("_l") - 15) - 1.8)).otherwise(0.5)
    pairs = match_atoms(_is_ca(ref), _is_ca(atoms), chain).crossJoin(F.broadcast(length.withColumn("_cut", F.greatest(F.lit(4.5), F.least(F.lit(8.0), d0)))))  # one row
    keys, best = [KEY, "_size", "_start"], None
    state = stored(_fragments(pairs, least).drop("_n", "atom_name"), "tm-pairs")
    square = sum(((c - F.col(f"r{a}")) ** 2 for a, c in sp.rotated("t", "r").items()), F.lit(0.0))
    for _ in range(rounds):
        sums = state.where("chosen").groupBy(*keys).agg(*sp.cross_sums("t", "r"))
        pose = sums.withColumns(sp.polynomial()).withColumn("root", sp.largest_root()).withColumn("q", sp.quaternion())
        # stored before q is looked at: a condition on q would be moved below the roots and repeat them for each of their uses
        pose = stored(pose.select(*keys, "q", *[f"m_{p}{a}" for p in "tr" for a in sp.AXES]), "tm-pose").where("q IS NOT NULL")
        moved = state.join(pose, keys).withColumn("_d2", square)
        whole = W.partitionBy(*keys)
        third = F.element_at(F.array_sort(F.collect_list("_d2").over(whole)), F.least(F.lit(3), F.count("*").over(whole).cast("int")))  # a protein's residues
        near = F.col("_d2") <= F.greatest(F.col("_cut") * F.col("_cut"), third)
        moved = moved.withColumn("_near", near).withColumn("_changed", F.max(F.col("chosen") != F.col("_near")).over(whole))
        moved = stored(moved.select(*state.columns, "_d2", "_near", "_changed"), "tm-round")
        scores = moved.groupBy(*keys).agg((F.sum(_tm_sum(F.col("_l"), F.col("_d2"))) / F.max("_l")).alias("value")).groupBy(KEY).agg(F.max("value").alias("value"))
        best = stored(scores if best is None else best.unionByName(scores).groupBy(KEY).agg(F.max("value").alias("value")), "tm-best")
        left = moved.where("_changed").withColumn("chosen", F.col("_near")).select(*state.columns)
        if left.isEmpty():
            break
        state = left
    return pairs.select(KEY).distinct().join(best, KEY, "left").select(KEY, F.col("value").alias(name))
