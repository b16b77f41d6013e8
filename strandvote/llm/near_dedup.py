"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents with one shingle set (told apart by two 64-bit hashes) form a class, so exact copies cost one row
each; a class is a node, numbered when the classes are written. A class has min-hashes; bands of some rows of
them propose candidates. Within a band's bucket each class first meets two members only, which links nearly
all of a group of near copies; then only classes of different components meet, and those of a bucket's
largest component don't meet each other. A candidate pair is dropped as soon as the posterior probability of
a similarity of the limit falls below MISS, looking at BATCH hashes at a time; survivors are verified on their
full shingle sets.

That second step pairs the few classes of a small bucket directly and compares those of a larger one by their
differences from a common set (_across_large); both ways are exact, and SMALL only sets where the first one,
which takes less work for few classes, ends. Joins with one row a group, component or class are spread, so no
hot group lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as k
from .common import forget, fresh, joined, spread, table, written
from .components import components, grown

WORDS = 5


@dataclass(frozen=True)
class Rule:
    """Similarity, in hundredths, from which documents are linked, and the bands and rows that find them."""

    limit: int
    bands: int
    rows: int

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


#: 40 bands of 8 rows miss a pair at 0.85 with probability (1 - 0.85 ** 8) ** 40 = 3e-6, and few pairs far below it
#: meet; 54 of 7 miss one at 0.8, the limit of a pipeline's stage on word shingles, as rarely.
OP5, STAGE = Rule(85, 40, 8), Rule(80, 54, 7)
#: Pivots of a bucket, and the sets of masks that choose them, which bands use in turn.
PIVOTS, MASKS = 2, 8
HASHES, BATCH, MISS = OP5.hashes, 32, 1e-6
#: Classes of a bucket that are paired with each other directly.
SMALL = 24
#: Members of a group, by hash, that choose its common set.
VOTERS = 64

_MASKS = np.random.default_rng(31).integers(0, 1 << 32, max(HASHES, STAGE.hashes), dtype=np.uint32)
_FACTORS = np.random.default_rng(32).integers(0, 1 << 32, max(HASHES, STAGE.hashes), dtype=np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """So many minima over the set, 16 bits of each; the halves of the shingles' hashes feed one half of them each.

    Two unlike minima agree in 16 bits once in 65,536 times, which only lets a few more pairs be verified.
    """
    low, high = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    half, out = hashes // 2, np.full(hashes, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        for words, own in ((low, slice(0, half)), (high, slice(half, hashes))):
            part = ((words[a : a + 4096] ^ _MASKS[own][:, None]) * _FACTORS[own][:, None]).min(1)
            out[own] = np.minimum(out[own], part)
    return (out ^ (out >> np.uint32(16))).astype(np.uint16)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        one = k.mix(np.array([k.mix(shingles).sum() + np.uint64(len(shingles))], np.uint64))
        two = k.mix(np.array([k.mix(shingles ^ k.PLACE[40]).sum()], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


_SIGNED = "uid long, doc_id long, n_shingles long, one long, two long, sig binary"


def signed(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """uid, doc_id, n_shingles, one and two (hashes of the shingle set) and sig, of every whole text of docs (uid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch.column("text")):
                w = k.words(part, lower=True)
                window = k.windows(w.hash, WORDS)
                sets = [k.shingles(w, i, window, WORDS) for i in range(len(part))]
                pairs = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2)
                sigs = [signature(s, rule.hashes).tobytes() if len(s) else None for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(sigs, pa.binary())]
                ids = [batch.column(c).slice(part.first, len(part)) for c in ("uid", "doc_id")]
                yield pa.RecordBatch.from_arrays([*ids, *columns], [x.split()[0] for x in _SIGNED.split(", ")])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, _SIGNED)


def classes(rows: DataFrame) -> DataFrame:
    """One row a distinct, not empty shingle set, with its documents' number and least doc_id. node is a number, so write it once."""
    out = rows.where("n_shingles > 0").groupBy("one", "two").agg(
        F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    return out.withColumn("node", F.monotonically_increasing_id())


def bands(reps: DataFrame, rule: Rule = OP5) -> DataFrame:
    """node, n and key of the bands in which the class shares a bucket with another one, with the bucket's pivots.

    A pivot is the member nearest to a mask, by exclusive or. A band uses one of MASKS sets of masks, so a group
    of near copies meets some of its members, but not other ones in each bucket.
    """
    width = 2 * rule.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(rule.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    rows = reps.select("node", "n", F.posexplode(keys).alias("band", "key")).withColumn("band", F.col("band") % MASKS)
    mask = [F.xxhash64("band", F.lit(i)) for i in range(PIVOTS)]
    nearest = [F.min(F.col("node").bitwiseXOR(m)).alias(f"_p{i}") for i, m in enumerate(mask)]
    buckets = rows.groupBy("key").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.min("band").alias("band"), *nearest).where("_lo <> _hi")
    buckets = buckets.select("key", F.array_distinct(F.array(*[F.col(f"_p{i}").bitwiseXOR(m) for i, m in enumerate(mask)])).alias("pivots"))
    return rows.drop("band").join(buckets, "key")


def least_matches(limit: float = OP5.limit / 100, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    """(hashes seen, least matches) by batch: with fewer matches, P(similarity >= limit) < miss.

    The prior is uniform, so the posterior is a beta distribution and its tail a binomial sum.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            # P(Beta(m + 1, n - m + 1) > limit) = P(Binomial(n + 1, limit) <= m)
            tail += math.comb(n + 1, m) * limit**m * (1 - limit) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _likely(one: Column, two: Column, rule: Rule) -> Column:
    least_by_batch = least_matches(rule.limit / 100, hashes=rule.hashes)

    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        left = np.frombuffer(b"".join(a), np.uint16).reshape(-1, rule.hashes)
        right = np.frombuffer(b"".join(b), np.uint16).reshape(-1, rule.hashes)
        alive, seen, before = np.arange(len(left)), np.zeros(len(left), np.int64), 0
        for n, least in least_by_batch:
            seen = seen + (left[alive, before:n] == right[alive, before:n]).sum(1)
            alive, seen, before = alive[seen >= least], seen[seen >= least], n
        out = np.zeros(len(left), bool)
        out[alive] = True
        return pd.Series(out)

    return likely(one, two)


class Sets:
    """Full shingle sets of classes, read again from one document of each; those read once are kept as tables."""

    def __init__(self, docs: DataFrame, reps: DataFrame) -> None:
        self.docs, self.reps, self.read = docs.select("doc_id", "text"), reps, []

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and set of nodes (distinct)."""
        known = [x.join(nodes, "node", "left_semi") for x in self.read]
        missing = nodes
        for x in self.read:
            missing = missing.join(x.select("node"), "node", "left_anti")
        missing = written(missing, "wanted")
        if not self.read or not missing.isEmpty():
            self.read.append(written(self._again(self.reps.join(missing, "node").select("node", "one", "two", "doc_id")), "sets"))
            known.append(self.read[-1])
        forget(missing)
        out = known[0]
        for x in known[1:]:
            out = out.union(x)
        return out

    def _again(self, wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in k.slices(batch.column("text")):
                    w = k.words(part, lower=True)
                    window = k.windows(w.hash, WORDS)
                    sets = [k.shingles(w, i, window, WORDS) for i in range(len(part))]
                    pairs = np.array([set_hash(s) for s in sets], np.int64).reshape(-1, 2)
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), lists], ["one", "two", "set"])

        texts = joined(self.docs, wanted.select("doc_id").distinct(), ["doc_id"], "left_semi")
        found = texts.mapInArrow(run, "one long, two long, set array<long>")
        return found.join(wanted.select("one", "two", "node"), ["one", "two"]).groupBy("node").agg(F.first("set").alias("set"))


def verified(sets: Sets, pairs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    one = sets.reps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = sets.reps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    # sets whose sizes differ too much can't be similar
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= rule.limit * F.greatest("n_a", "n_b"))
    near = written(near.where(_likely(F.col("sig_a"), F.col("sig_b"), rule)).select("a", "b", "n_a", "n_b"), "survivors")
    found = sets.of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    both = near.join(found.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(found.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= rule.limit * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def _open_rows(live: DataFrame, labels: DataFrame) -> DataFrame:
    """node, n, key, label, and the bucket's largest label and rows, of the buckets that hold several components."""
    of = written(live.select("node", "n", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "bucket-labels")
    sizes = of.groupBy("key", "label").agg(F.count("*").alias("n_label"))
    mixed = sizes.groupBy("key").agg(F.max_by("label", F.struct("n_label", "label")).alias("largest"), F.count("*").alias("labels"), F.sum("n_label").alias("members"))
    return of.join(mixed.where("labels > 1").drop("labels"), "key")


def _across_small(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of a small bucket, of sizes that can be similar, whose classes are in different components."""
    few = rows.where("label <> largest").select("key", F.col("node").alias("x"), F.col("label").alias("label_x"), F.col("n").alias("n_x"))
    every = rows.select("key", F.col("node").alias("y"), F.col("label").alias("label_y"), F.col("n").alias("n_y"), "largest")
    fit = 100 * F.least("n_x", "n_y") >= rule.limit * F.greatest("n_x", "n_y")
    pairs = few.join(every, "key").where(F.expr("label_x <> label_y AND (x < y OR label_y = largest)") & fit)
    return _ordered(pairs.select("x", "y"))


def _symmetric(one: str, two: str) -> Column:
    return F.concat(F.array_except(one, two), F.array_except(two, one))


def _across_large(sets: Sets, rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links (a, b), and pairs still to verify, of the classes of large buckets.

    Buckets with one largest component form a group. D(x) is the difference of x's set from a common set:
    first that of one member, then corrected by the elements that over half of VOTERS or so differences
    share. Any common set gives the same links; one near the middle makes differences small. With w = 100 + limit, v = 100 - limit and g(x) = w * |D(x)| - v * |x|, classes x and y are linked
    exactly if g(x) + g(y) <= 2 * w * |D(x) & D(y)|. Let z have the least g. Every x meets z. An x that isn't
    linked to z has g(x) + g(z) > 0, so it shares at least (g(x) + g(y)) / 2w > 0 elements with any y that it
    is linked to. An edit puts several elements into the same classes' differences; elements with the same
    sharers are one block, with its elements as weight. Blocks in the order of their frequency give the
    usual prefix filter: x and y share one of their rarest blocks. The join on blocks compares weights of
    common blocks and lets only pairs through whose overlap suffices.
    """
    w, v = 100 + rule.limit, 100 - rule.limit
    group = written(rows.select(F.col("largest").alias("grp"), "node", "label").distinct(), "groups")
    found = sets.of(group.select("node").distinct())
    anchors = group.groupBy("grp").agg(F.min("node").alias("node"), F.count("*").alias("members"))
    anchor = written(anchors.join(found, "node").select("grp", F.col("set").alias("anchor"), "members", F.col("members").alias("weight")), "anchors")
    raw = spread(group.join(found, "node"), anchor, ["grp"], "node", "weight")
    raw = written(raw.select("grp", "node", "label", "members", F.size("set").alias("n"), _symmetric("set", "anchor").alias("d")), "differences")
    few = raw.where(F.pmod(F.xxhash64("node"), F.col("members")) < VOTERS)
    voters = few.groupBy("grp").agg(F.count("*").alias("voters"))
    often = few.select("grp", F.explode("d").alias("e")).groupBy("grp", "e").agg(F.count("*").alias("f")).join(voters, "grp").where("2 * f > voters")
    common = anchors.select("grp", "members").join(often.groupBy("grp").agg(F.collect_list("e").alias("common")), "grp", "left")
    common = written(common.select("grp", "members", F.coalesce("common", F.array().cast("array<long>")).alias("common")), "common")
    diff = spread(raw.drop("members"), common, ["grp"], "node", "members").select("grp", "node", "label", "n", _symmetric("d", "common").alias("d")).withColumn("g", w * F.size("d") - v * F.col("n"))
    diff = written(diff, "differences")
    center = diff.groupBy("grp").agg(F.min(F.struct("g", "node")).alias("z"), F.count("*").alias("members")).select("grp", F.col("z.g").alias("g_z"), F.col("z.node").alias("z"), "members")
    center = written(center.join(diff.select("grp", F.col("node").alias("z"), F.col("d").alias("d_z"), F.col("label").alias("label_z")), ["grp", "z"]), "centers")
    met = spread(diff, center, ["grp"], "node", "members").withColumn("linked", 2 * w * F.size(F.array_intersect("d", "d_z")) >= F.col("g") + F.col("g_z"))
    met = written(met.drop("d_z"), "met")
    forget(anchor, raw, common, diff, center)
    links = met.where("linked AND node <> z").select(F.least("node", "z").alias("a"), F.greatest("node", "z").alias("b"))

    need = lambda total: F.ceil(total / F.lit(2 * w))
    elements = written(met.select("grp", "node", F.explode("d").alias("e")), "elements")
    sharers = elements.groupBy("grp", "e").agg(F.count("*").alias("f"), F.sum(F.xxhash64("node") % (1 << 40)).alias("who")).where("f > 1")
    sharers = written(sharers.withColumn("weight", F.col("f")), "sharers")
    blocks = spread(elements, sharers, ["grp", "e"], "node", "weight").groupBy("grp", "node", "f", "who").agg(F.count("*").alias("weight"))
    # the weight, of 26 bits at most, stands in the block's name, so that common names give the overlap
    blocks = blocks.withColumn("block", F.xxhash64("f", "who").bitwiseAND(F.lit(-(1 << 26))).bitwiseOR(F.col("weight")))
    order = W.partitionBy("grp", "node").orderBy("f", "block")
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    held = F.collect_list("block").over(W.partitionBy("grp", "node"))
    blocks = blocks.select("grp", "node", "f", "block", after.alias("after"), held.alias("blocks"))
    starts = ~F.col("linked") & (F.col("label") != F.col("label_z"))
    state = met.select("grp", "node", "label", "g", F.greatest(F.lit(1), need(F.col("g") - F.col("g_z"))).alias("any_one"), F.when(starts, need(F.col("g") + F.col("g_z"))).alias("as_start"))
    # `after` elements are left from a block on: if they are too few, the first shared block can't be this one
    blocks = written(blocks.join(state, ["grp", "node"]).where("after >= least(any_one, as_start)"), "blocks")
    one = blocks.where("after >= as_start").select("grp", "block", F.col("node").alias("x"), F.col("label").alias("label_x"), F.col("g").alias("g_x"), F.col("after").alias("after_x"), F.col("blocks").alias("blocks_x"))
    two = blocks.where("after >= any_one").select("grp", "block", F.col("node").alias("y"), F.col("label").alias("label_y"), F.col("g").alias("g_y"), F.col("after").alias("after_y"), F.col("blocks").alias("blocks_y"))
    overlap = F.aggregate(F.array_intersect("blocks_x", "blocks_y"), F.lit(0).cast("long"), lambda a, b: a + b.bitwiseAND(F.lit((1 << 26) - 1)))
    total = F.col("g_x") + F.col("g_y")
    enough = (2 * w * F.least("after_x", "after_y") >= total) & (2 * w * overlap >= total)
    return links, _ordered(one.join(two, ["grp", "block"]).where((F.col("label_x") != F.col("label_y")) & enough).select("x", "y"))


def _linked(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Of docs (uid, doc_id, text): rows, as signed makes them, and classes with label (least node of the component, null if alone)."""
    rows = written(signed(docs, rule), "signed")
    reps = written(classes(rows), "classes")
    sets = Sets(docs, reps)
    live = written(bands(reps, rule), "bands")
    tried = written(_ordered(live.select(F.col("node").alias("x"), F.explode("pivots").alias("y"))), "pairs")
    edges = written(verified(sets, tried, rule), "links")
    labels = components(edges)
    mixed = written(_open_rows(live, labels), "open-buckets")
    forget(live)
    links, rest = _across_large(sets, mixed.where(F.col("members") > SMALL), rule)
    rest = rest.union(_across_small(mixed.where(F.col("members") <= SMALL), rule)).distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = written(verified(sets, rest, rule).union(links), "links")
    labels = grown(labels, more)
    out = written(reps.select("node", "one", "two", "copies", "doc_id").join(labels, "node", "left"), "labelled")
    forget(tried, mixed, rest, *sets.read)
    return rows, out


def grouped(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row a document.

    Null and empty texts and texts without a word have no shingle and stay alone. A null doc_id has no say
    in component_id; if a whole component has no id, component_id is null and its rows are kept. Rows with
    one doc_id and different texts are rows of their own.
    """
    rows, found = _linked(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"), rule)
    least = written(found.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "components")
    several = spread(found.where("label IS NOT NULL"), least, ["label"], "node", "n").select("one", "two", "copies", "component_id")
    by_set = written(several.union(found.where("label IS NULL").select("one", "two", "copies", F.col("doc_id").alias("component_id"))), "by-set")
    filled = spread(rows.where("n_shingles > 0").select("uid", "doc_id", "n_shingles", "one", "two"), by_set, ["one", "two"], "uid", "copies")
    out = filled.select("doc_id", "n_shingles", "component_id").union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, rule: Rule = OP5) -> DataFrame:
    """One row of each group, with the columns of docs: the one of its smallest doc_id, then of its least set hash.

    Of rows that are equal in both one is left; texts without a word are kept, all of them.
    """
    names, uid = docs.columns, fresh(docs, "uid")
    docs = written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    rows, found = _linked(docs.select(F.col(uid).alias("uid"), "doc_id", "text"), rule)
    best = written(rows.where("n_shingles > 0").groupBy("one", "two").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "one", "two", "uid")).alias("best")), "best-of-set")
    best = best.join(found.select("one", "two", "label"), ["one", "two"])
    first = best.where("label IS NOT NULL").groupBy("label").agg(F.min("best").alias("best")).select("best.uid")
    kept = first.union(best.where("label IS NULL").select("best.uid")).union(rows.where("n_shingles = 0").select("uid"))
    out = docs.join(written(kept.withColumnRenamed("uid", uid), "kept"), uid, "left_semi")
    return out.select(*[F.col(f"`{c}`") for c in names])


def op5_bayes_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))
