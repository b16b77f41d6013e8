"""A Merkle manifest of a dataset: one root for all rows, and for each row the siblings that lead to it.

A row's leaf is the digest of its columns. A leaf's place in its source is its rank by doc_id, and is found
without sorting the rows: ids become bitmaps of 64 by source, those of the tasks are merged by OR, words that
aren't empty are gathered in containers of 65,536 ids with a directory of the counts before each, and containers
get theirs by a tree of fan-out 65,536. A row's rank is what stands before its container, before its word, and
the ones below its bit. Places are numbered, so each level of the tree is made by grouping (source, place div
81) and laying digests in an array by place mod 81; four levels of runs of three are made in that array. Paths
are handed down the same blocks from the root.

Null ids come before all others. Rows of one id, null ids too, are ranked among themselves in the same way by
the beginning of their leaves; only rows that are the same in all columns can stand in either order. A null
source is a source of its own, before all others. Without rows there is no root and no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import forget, internal, joined, table, written
from .mixing import BROADCAST_ROWS, beside
from .sharding import _CRC, numbered

#: Children of a node, and levels that one grouping makes.
FAN, HEIGHT = 3, 4
BLOCK = FAN**HEIGHT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
#: Copies of one row that one task numbers.
SPAN = 1_000_000


def leaf(columns: dict[str, Column]) -> Column:
    """sha256 over values, each as '-' if null, else its bytes in UTF-8, ':' and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, **changed: Column) -> DataFrame:
    """source, doc_id and leaf of every row; changed: also the leaf that it would have with the column changed, null where it is null or has no change."""
    own = {c: F.col(f"`{c}`") for c in COLUMNS}
    more = [F.when(new.isNotNull() & (new != own[c]), leaf(own | {c: new})).alias(f"changed_{c}") for c, new in changed.items()]
    return docs.select(own["source"].alias("source"), own["doc_id"].cast("long").alias("doc_id"), leaf(own).alias("leaf"), *more)


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))")


def _containers(rows: DataFrame, keys: list[str], key: str, weight: Column) -> DataFrame:
    """keys, _hi, _base (rows before the container), and arrays of its words: _at, _bits, _dir (rows before the word) and _more.

    _more lists the bits of a word that stand for several rows, with the rows beyond one. No window has over
    65,536 rows.
    """
    own = rows.select(*keys, F.col(key).alias("_key"), weight.alias("_weight"))
    words = own.groupBy(*keys, F.shiftright("_key", 6).alias("_word")).agg(F.bit_or(_bit("_key")).alias("_bits"), F.sum("_weight").alias("_rows"))
    words = written(words, "merkle-words")
    several = words.where("_rows > bit_count(_bits)").select(*keys, "_word")
    more = "array<struct<bit:long,rows:long>>"
    if several.isEmpty():
        words = words.withColumn("_more", F.lit(None).cast(more))
    else:
        again = joined(own.withColumn("_word", F.shiftright("_key", 6)), several, [*keys, "_word"], "left_semi")
        again = again.groupBy(*keys, "_word", "_key").agg((F.sum("_weight") - 1).alias("_rows")).where("_rows > 0")
        again = again.groupBy(*keys, "_word").agg(F.collect_list(F.struct(F.expr("_key & 63").alias("bit"), F.col("_rows").alias("rows"))).alias("_more"))
        words = joined(words, again, [*keys, "_word"], "left")
    before = lambda *by: W.partitionBy(*by)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    words = words.withColumn("_hi", F.shiftright("_word", 10))
    words = words.withColumn("_dir", F.coalesce(F.sum("_rows").over(upto(before(*keys, "_hi").orderBy("_word"))), F.lit(0)))
    entry = F.struct(F.expr("CAST(_word & 1023 AS INT)").alias("at"), F.col("_bits").alias("bits"), F.col("_dir").alias("dir"), F.col("_more").alias("more"))
    found = words.groupBy(*keys, "_hi").agg(F.sort_array(F.collect_list(entry)).alias("_e"), F.sum("_rows").alias("_rows"))
    found = found.select(*keys, "_hi", "_rows", *[F.col(f"_e.{c}").alias(f"_{c}") for c in ("at", "bits", "dir", "more")])
    found = written(found, "merkle-containers")
    # counts of containers, of 2 ** 16 of them and of 2 ** 32
    low = found.select(*keys, "_hi", F.shiftright("_hi", 16).alias("_mid"), "_rows")
    low = low.withColumn("_base", F.coalesce(F.sum("_rows").over(upto(before(*keys, "_mid").orderBy("_hi"))), F.lit(0)))
    mid = low.groupBy(*keys, "_mid").agg(F.sum("_rows").alias("_rows")).withColumn("_top", F.shiftright("_mid", 16))
    mid = mid.withColumn("_base2", F.coalesce(F.sum("_rows").over(upto(before(*keys, "_top").orderBy("_mid"))), F.lit(0)))
    top = mid.groupBy(*keys, "_top").agg(F.sum("_rows").alias("_rows"))
    top = top.withColumn("_base3", F.coalesce(F.sum("_rows").over(upto(before(*keys).orderBy("_top"))), F.lit(0)))
    mid = joined(mid, top.select(*keys, "_top", "_base3"), [*keys, "_top"])
    low = joined(low, mid.select(*keys, "_mid", (F.col("_base2") + F.col("_base3")).alias("_base2")), [*keys, "_mid"])
    return joined(found.drop("_rows"), low.select(*keys, "_hi", (F.col("_base") + F.col("_base2")).alias("_base")), [*keys, "_hi"])


def ranked(rows: DataFrame, keys: list[str], key: str, weight: Column | None = None, name: str = "rank") -> DataFrame:
    """rows with the sum of weights (by default the count) of the rows of the same keys whose key, a long without nulls, is smaller; _tied: others have the same key."""
    index = _containers(rows, keys, key, F.lit(1).cast("long") if weight is None else weight)
    asked = rows.withColumn("_hi", F.shiftright(key, 16)).withColumn("_w", F.expr(f"CAST(shiftright({key}, 6) & 1023 AS INT)"))
    both = joined(asked, index, [*keys, "_hi"])
    at = F.when(F.size("_at") == 1024, F.col("_w") + 1).otherwise(F.array_position("_at", F.col("_w")).cast("int"))
    both = both.withColumn("_i", at)
    below = F.expr(f"bit_count(element_at(_bits, _i) & ~shiftleft(-1L, CAST({key} & 63 AS INT)))")
    more = F.expr(f"aggregate(filter(coalesce(element_at(_more, _i), array()), x -> x.bit < {key} & 63), 0L, (a, x) -> a + x.rows)")
    tied = F.expr(f"exists(coalesce(element_at(_more, _i), array()), x -> x.bit = {key} & 63)")
    return both.withColumn(name, F.col("_base") + F.expr("element_at(_dir, _i)") + below + more).withColumn("_tied", tied).drop("_hi", "_w", "_i", "_at", "_bits", "_dir", "_more", "_base")


def places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, doc_id, leaf and more) with place, from 0 within keys: by doc_id, null first, then by leaf."""
    some = rows.where("doc_id IS NOT NULL")
    nulls = rows.where("doc_id IS NULL")
    ids = written(ranked(some, keys, "doc_id", name="_rank"), "merkle-ranks")
    shift = nulls.groupBy(*keys).agg(F.count("*").alias("_nulls"))
    if not shift.isEmpty():
        small = shift.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ids = joined(ids, F.broadcast(shift) if small else shift, keys, "left")
        ids = ids.withColumn("_rank", F.col("_rank") + F.coalesce("_nulls", F.lit(0))).drop("_nulls")
    single = ids.where("NOT _tied").drop("_tied").withColumnRenamed("_rank", "place")
    tied = ids.where("_tied").drop("_tied").unionByName(nulls.withColumn("_rank", F.lit(0).cast("long")))
    if tied.isEmpty():
        return single
    # rows alike in all columns are counted, ranked together and dealt out again
    names = [c for c in tied.columns]
    distinct = tied.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_lead", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    distinct = written(distinct, "merkle-tied")
    among = ranked(distinct, [*keys, "doc_id"], "_lead", F.col("_copies"), "_among")
    same = W.partitionBy(*keys, "doc_id", "_lead").orderBy("leaf", *[c for c in names if c not in (*keys, "doc_id", "leaf")]).rowsBetween(W.unboundedPreceding, -1)
    among = among.withColumn("_from", F.col("_rank") + F.col("_among") + F.coalesce(F.sum("_copies").over(same), F.lit(0)))
    spans = among.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(SPAN).cast("long"))))
    copies = F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + SPAN, F.col("_copies")) - 1))
    dealt = spans.repartition(*keys, "doc_id", "leaf", "_start").withColumn("_copy", copies).withColumn("place", F.col("_from") + F.col("_copy"))
    return single.unionByName(dealt.select(*single.columns))


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests: list[str], whole: bool) -> list[list[str]]:
    """The digests of a block and the levels above: HEIGHT of them, or all up to a single node if the block holds a whole tree."""
    out = [digests]
    while len(out[-1]) > 1 if whole else len(out) <= HEIGHT:
        below = out[-1]
        out.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def path(made: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """Of each level the siblings before and after the node above this slot."""
    out = []
    for level in made[:-1]:
        run = slot // FAN * FAN
        out.append(("".join(level[run:slot]), "".join(level[slot + 1 : run + FAN])))
        slot //= FAN
    return out


def _tops(digests: pa.Array, whole: pa.Array) -> pa.Array:
    return pa.array([levels(d, w)[-1][0] for d, w in zip(digests.to_pylist(), whole.to_pylist(), strict=True)], pa.string())


def _raised(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of every round: gid, block, whole, slots (slot, digest, row), top. nodes: gid, place, n (nodes of its gid), digest, row."""
    rounds, top = [], F.arrow_udf(_tops, "string")
    while True:
        slot = F.struct(F.expr(f"CAST(place % {BLOCK} AS INT)").alias("slot"), "digest", "row")
        blocks = nodes.groupBy("gid", F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(slot), lambda a, b: a["slot"] - b["slot"]).alias("slots"), F.max("n").alias("n"))
        blocks = blocks.withColumn("whole", F.col("n") <= BLOCK)
        blocks = written(blocks.withColumn("top", top(F.col("slots.digest"), F.col("whole"))), "merkle-blocks")
        rounds.append(blocks)
        if most <= BLOCK:
            return rounds
        most = -(-most // BLOCK)
        nodes = blocks.where("NOT whole").select("gid", F.col("block").alias("place"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("row"))


def _expand(blocks: DataFrame) -> DataFrame:
    """gid, place, digest, above, path and row of every slot of blocks, which have above and path of their own top."""
    row = blocks.schema["slots"].dataType.elementType["row"].dataType.simpleString()
    above = blocks.schema["above"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                slots = part.column("slots")
                sizes = np.diff(slots.offsets.to_numpy())
                flat = slots.flatten()
                lists = zip(part.column("whole").to_pylist(), part.column("slots").to_pylist(), part.column("path").to_pylist(), strict=True)
                before, after, ends = [], [], [0]
                for whole, entries, upper in lists:
                    made = levels([e["digest"] for e in entries], whole)
                    for i in range(len(entries)):
                        own = path(made, i)
                        before += [b for b, _ in own] + [u["before"] for u in upper]
                        after += [a for _, a in own] + [u["after"] for u in upper]
                        ends.append(len(before))
                paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]))
                of = np.repeat(np.arange(part.num_rows), sizes)
                place = part.column("block").to_numpy()[of] * BLOCK + flat.field("slot").to_numpy()
                yield pa.RecordBatch.from_arrays([part.column("gid").take(pa.array(of)), pa.array(place), flat.field("digest"), part.column("above").take(pa.array(of)), paths, flat.field("row")], names=["gid", "place", "digest", "above", "path", "row"])

    return blocks.select("gid", "block", "whole", "slots", "above", "path").mapInArrow(run, f"gid long, place long, digest string, above {above}, path {PATH}, row {row}")


def _lowered(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """gid, place, digest, above, path and row of the nodes that _raised was given; tops: gid, above and path of the top of every gid."""
    nodes = None
    for blocks in reversed(rounds):
        found = blocks.where("whole").join(tops, "gid")
        if nodes is not None:
            parents = nodes.select("gid", F.col("place").alias("block"), "above", "path")
            found = found.unionByName(blocks.where("NOT whole").join(parents, ["gid", "block"]))
        nodes = _expand(found)
        if blocks is not rounds[0]:
            nodes = written(nodes, "merkle-paths")
    return nodes


def manifest(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, leaf and more, best written) with place, subroot, root and path, the siblings before and after on every level from the leaf to the root."""
    counts = written(rows.groupBy("source").agg(F.count("*").alias("documents")), "merkle-counts")
    order, n = numbered(counts.select("source", "documents"), ["source"])
    sources = written(order.select("source", "documents", F.col("row_number").alias("gid"), F.col("documents").alias("_n")), "merkle-sources")
    most = sources.agg(F.max("documents")).first()[0] or 1
    placed = places(beside(rows, sources, "leaf"), ["gid"])
    more = [c for c in rows.columns if c != "leaf"]
    nodes = placed.select("gid", "place", F.col("_n").alias("n"), F.col("leaf").alias("digest"), F.struct(*more).alias("row"))
    lower = _raised(nodes, most)
    subroots = lower[0].where("whole").select("gid", "top")
    for blocks in lower[1:]:
        subroots = subroots.unionByName(blocks.where("whole").select("gid", "top"))
    upper = _raised(subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("place"), F.lit(n).cast("long").alias("n"), F.col("top").alias("digest"), F.lit(None).cast("int").alias("row")), n)
    tops = upper[-1].select("gid", F.col("top").alias("above"), F.array().cast(PATH).alias("path"))
    by_source = written(_lowered(upper, tops).select(F.col("place").alias("gid"), F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above"), "path"), "merkle-subroots")
    return _lowered(lower, by_source).select("row.*", F.col("digest").alias("leaf"), "place", "above.subroot", "above.root", "path")


def proof(path: str) -> Column:
    """The siblings of a path in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), "")


def folded(path: str, start: Column) -> Column:
    """The root that a leaf and the siblings of a path make."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def op13_bitmap_rank_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = internal(table(spark, sf_dir, "documents"), *COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    rows = manifest(written(leaves(docs, text=tampered), "merkle-leaves"))
    out = rows.withColumn("folded_root", folded("path", F.coalesce("changed_text", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof("path"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_tree(name: str, nodes: str, walk: str, levels: int) -> str:
    """Levels of trees from nodes (g, i, h, n), and walks (id, g, i, acc, proof) up them to the last one, <name>w<levels>."""
    out, at, w = [], nodes, walk
    for k in range(levels):
        run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{k} AS MATERIALIZED (SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, "
            f"coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {at})"
        )
        out.append(
            f"{name}w{k + 1} AS MATERIALIZED (SELECT id, w.g, w.i // 3 AS i, CASE WHEN n > 1 THEN sha256(b || acc || a) ELSE acc END AS acc, CASE WHEN n > 1 THEN proof || b || a ELSE proof END AS proof "
            f"FROM {w} w JOIN {name}s{k} s ON w.g = s.g AND w.i = s.i)"
        )
        out.append(f"{name}n{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 2) // 3 AS n FROM {at} GROUP BY g, i // 3)")
        at, w = f"{name}n{k + 1}", f"{name}w{k + 1}"
    return ",\n".join(out)


def op13_sql(levels: int = 16, source_levels: int = 8) -> str:
    """The same manifest in SQL, for 3 ** levels rows of a source and 3 ** source_levels sources."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join([*map(part, COLUMNS[:-1]), part(text)]) + ")"
    return f"""
WITH ids AS (SELECT row_number() OVER () AS id, * FROM documents),
rows AS (SELECT id AS doc_id, 0 AS size, CAST(doc_id AS VARCHAR) AS text FROM ids WHERE doc_id IS NOT NULL),
{_CRC},
leaves AS (
  SELECT id, doc_id, source, {digest("text")} AS leaf, CASE WHEN text_crc32 % 2 = 0 THEN {digest("replace(text, chr(10), '')")} END AS changed
  FROM ids LEFT JOIN (SELECT doc_id AS crc_id, text_crc32 FROM crc) c ON id = crc_id),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) AS n FROM leaves GROUP BY source),
placed AS MATERIALIZED (
  SELECT id, doc_id, leaf, changed, g, n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves JOIN sources s ON leaves.source IS NOT DISTINCT FROM s.source),
nodes AS MATERIALIZED (SELECT g, i, leaf AS h, n FROM placed),
walks AS MATERIALIZED (SELECT id, g, i, coalesce(changed, leaf) AS acc, '' AS proof FROM placed),
{_sql_tree("l", "nodes", "walks", levels)},
tops AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM ln{levels}),
climbs AS MATERIALIZED (SELECT id, 0 AS g, g AS i, acc, proof FROM lw{levels}),
{_sql_tree("u", "tops", "climbs", source_levels)}
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = r.h AS verified
FROM placed p JOIN uw{source_levels} w ON p.id = w.id JOIN tops t ON t.i = p.g CROSS JOIN un{source_levels} r
"""
