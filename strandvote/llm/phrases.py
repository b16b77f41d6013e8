"""Phrases whose words stand together more often than their parts explain, by Rabin-Karp fingerprints.

Texts are cut into pieces and pieces into words. A task lays the words of a block of whole texts side by
side and takes the prefix sums of a polynomial over their bytes, modulo two primes; the fingerprint of
any run of words is then a difference of two prefixes, shifted to the beginning of its piece, so all
runs of one to three words are hashed without making a string of them. A block's fingerprints, with their
counts, a text where each occurs and a check value, are sorted, packed and dealt by their leading bits;
there they are counted over all blocks. Only fingerprints that are frequent are looked up among the runs of
that text and become phrases. Where two different runs have met in a fingerprint, which the check values
tell, those runs are counted again by their text.

Counts are by language; a null language is 'und', a null text empty. Rows that are the same in all columns
count as often as they stand. Without words there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as k
from .common import forget, internal, spread, table, written

#: Words of the longest phrase; occurrences from which on a phrase counts; phrases of a language that are returned.
LONGEST, LEAST, MOST = 3, 10, 2000
#: Share of a phrase's occurrences, as a fraction of 100, that a longer one must cover to take its place.
COVERED = 50
#: Parts in which the first phrases of a language are sought.
PARTS = 256
#: Bytes of text of a block, and fingerprints of a bucket; one byte of text has PER_BYTE fingerprints or so.
BLOCK, BUCKET, PER_BYTE = 1 << 20, 500_000, 0.35
#: Primes below 2**31 and bases of the two polynomials.
MODULI, BASES = (2147483647, 2147483629), (911382323, 672327653)
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True

COUNTED = "fp long, n long, clash boolean, block long, doc int, keys array<struct<a:long,b:long>>, words array<struct<lang:string,n:long>>"
PACKED = "bucket long, block long, n long, packed binary, keys array<struct<a:long,b:long>>, words array<struct<lang:string,n:long>>"


class Runs:
    """Fingerprints of the runs of words of a slice of texts."""

    def __init__(self, part: k.Slice, langs: list[str], moduli: tuple[int, int] = MODULI):
        self.part, self.data = part, k.LOWER[part.data]
        w = self.words = k.words(part, GAPS, lower=True)
        self.text = w.text_of()
        breaks = np.concatenate(([0], np.cumsum(BREAKS[part.data])))[w.start] if len(w.start) else np.zeros(0, np.int64)
        new = np.ones(len(w.start), bool)
        new[1:] = (np.diff(self.text) > 0) | (np.diff(breaks) > 0)
        heads = np.append(np.flatnonzero(new), len(new))
        piece = np.cumsum(new) - 1
        self.left = heads[piece + 1] - np.arange(len(new))  # words to the end of the piece
        size = w.end - w.start + 1
        self.stop = np.cumsum(size) - 1  # in the words side by side, with one byte between two
        self.begin = self.stop - size + 1
        self.offset = self.begin - self.begin[heads[:-1]][piece]
        self.lang = k.mix(np.array([_lang_hash(x) for x in langs], np.uint64))[self.text] if len(new) else np.zeros(0, np.uint64)
        self.prefix = [self._prefixes(size, m, b) for m, b in zip(moduli, BASES, strict=True)]
        self.moduli = moduli

    def _prefixes(self, size: np.ndarray, modulus: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of byte times base ** offset in its piece, and base ** -offset of each word."""
        total = int(size.sum())
        at = np.arange(total) - np.repeat(self.begin, size)
        source = np.repeat(self.words.start, size) + at
        letters = np.where(at < np.repeat(size - 1, size), self.data[np.minimum(source, max(len(self.data) - 1, 0))] if total else 0, 0x20).astype(np.int64) + 1
        offset = np.repeat(self.offset, size) + at
        most = int(offset.max()) + 1 if total else 1
        terms = letters * powers(base % modulus, modulus, most)[offset] % modulus
        inverse = powers(pow(base, -1, modulus), modulus, most)
        return np.concatenate(([0], np.cumsum(terms))), inverse[self.offset]

    def fingerprints(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, check value and first word of every run of n words."""
        at = np.flatnonzero(self.left >= n)
        out = np.zeros(len(at), np.uint64)
        for (sums, inverse), modulus in zip(self.prefix, self.moduli, strict=True):
            h = (sums[self.stop[at + n - 1]] - sums[self.begin[at]]) % modulus * inverse[at] % modulus
            out = (out << np.uint64(31)) | h.astype(np.uint64)
        own = self.lang[at] * np.uint64(2 * n + 1)
        check = k.mix(k.windows(self.words.hash, n)[at] ^ own) >> np.uint64(40)  # 24 bits beside the 62 of the fingerprint
        return k.mix(out ^ own), check.astype(np.uint32), at

    def phrase(self, word: int, n: int) -> str:
        w = self.words
        return b" ".join(self.data[w.start[i] : w.end[i]].tobytes() for i in range(word, word + n)).decode()


def _lang_hash(lang: str) -> int:
    data = np.frombuffer(lang.encode(), np.uint8)
    return int(k.span_hash(data, np.zeros(1, np.int64), np.array([len(data)], np.int64))[0])


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * (int(out[-1]) * base % modulus) % modulus))
    return out[:n]


def _pack(fp: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted fingerprints as differences, and columns of 32 bits; bytes of one weight side by side, compressed."""
    planes = [np.diff(fp, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()]
    planes += [c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = np.frombuffer(pa.decompress(packed, n * (8 + 4 * columns), codec="zstd", asbytes=True), np.uint8)
    plane = lambda a, width: np.ascontiguousarray(raw[a * n : (a + width) * n].reshape(width, n).T).view(f"<u{width}").ravel()
    return np.cumsum(plane(0, 8), dtype=np.uint64), [plane(8 + 4 * i, 4) for i in range(columns)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, k.Slice]]:
    for batch in batches:
        for part in k.slices(batch.column("text"), BLOCK):
            yield batch.slice(part.first, len(part)), part


def _packer(buckets: int, moduli: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("keys", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("words", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])
        for batch, part in _blocks(batches):
            langs = batch.column("lang").to_pylist()
            runs = Runs(part, langs, moduli)
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            block = int(k.mix(np.array([(a.view(np.uint64) * np.uint64(3) + k.mix(b.view(np.uint64)) + np.arange(len(a), dtype=np.uint64)).sum()], np.uint64)).view(np.int64)[0])
            counts: dict[str, int] = {}
            for lang, n in zip(langs, runs.words.count.tolist(), strict=True):
                counts[lang] = counts.get(lang, 0) + n
            rows = [(-1 - block % buckets, block, 0, None, [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], [{"lang": x, "n": n} for x, n in counts.items() if n])]
            fp, check, at = (np.concatenate(x) for x in zip(*[runs.fingerprints(n) for n in range(1, LONGEST + 1)], strict=True))
            order = np.lexsort((check, fp))
            fp, check, at = fp[order], check[order], at[order]
            # one entry for each fingerprint and check value, so that runs that collide inside a block are told apart
            first = np.flatnonzero(np.concatenate(([True], (np.diff(fp) > 0) | (np.diff(check.astype(np.int64)) != 0)))) if len(fp) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(fp)))
            fp, check, at = fp[first], check[first], at[first]
            text = runs.text[at]
            columns = [n - 1, check, text]
            bucket = (fp >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket) > 0, [True]))) if len(fp) else np.zeros(0, np.int64)
            rows += [(int(bucket[i]), block, int(j - i), _pack(fp[i:j], [c[i:j] for c in columns]), None, None) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _counter(least: int):
    def run(bucket: pa.Table) -> pa.Table:
        """Counts of the fingerprints of a bucket, each with one of its texts; of a directory's bucket the directories."""
        block, n = bucket.column("block").to_numpy(), bucket.column("n").to_numpy()
        if bucket.column("bucket")[0].as_py() < 0:
            none = lambda t: pa.nulls(len(block), t)
            return pa.table([none(pa.int64()), none(pa.int64()), none(pa.bool_()), bucket.column("block"), none(pa.int32()), bucket.column("keys"), bucket.column("words")], names=_names())
        found = [_unpack(x.as_py(), int(m), 3) for x, m in zip(bucket.column("packed"), n, strict=True)]
        fp, rest = np.concatenate([f for f, _ in found]), [np.concatenate(c) for c in zip(*[c for _, c in found], strict=True)]
        block = np.repeat(block, n)
        order = np.argsort(fp, kind="stable")
        fp, block, (count, check, doc) = fp[order], block[order], [c[order] for c in rest]
        first = np.flatnonzero(np.concatenate(([True], np.diff(fp) > 0)))
        total = np.add.reduceat(count.astype(np.int64) + 1, first)
        clash = np.minimum.reduceat(check, first) != np.maximum.reduceat(check, first)
        some = total >= least
        at = first[some]
        none = lambda t: pa.nulls(len(at), t)
        return pa.table([fp[at].view(np.int64), total[some], clash[some], block[at], doc[at].astype(np.int32), none(bucket.column("keys").type), none(bucket.column("words").type)], names=_names())

    return run


def _names() -> list[str]:
    return [c.split(" ")[0] for c in COUNTED.split(", ")]


def _texts(docs: DataFrame) -> DataFrame:
    """lang, text and a, b, the 128 bits by which a place names its document; rows alike in all three columns share them."""
    rows = internal(docs, "doc_id", "lang", "text").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("lang", "text", F.xxhash64("doc_id", "lang", "text").alias("a"), F.xxhash64(F.lit(7), "text", "lang", "doc_id").alias("b"))


def _found(texts: DataFrame, least: int, moduli: tuple[int, int]) -> DataFrame:
    """Frequent fingerprints with a text each, and the directory of documents of every block."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size * PER_BYTE / BUCKET))
    packed = texts.select("a", "b", "lang", "text").mapInArrow(_packer(buckets, moduli), PACKED)
    return written(packed.groupBy("bucket").applyInArrow(_counter(least), COUNTED), "phrase-counts")


def _materialised(texts: DataFrame, found: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """lang, phrase, size (its words) and n of the frequent fingerprints in which nothing collides."""
    places = found.where("fp IS NOT NULL AND NOT clash").select("fp", "n", "block", "doc")
    where = found.where("keys IS NOT NULL").select("block", "keys")
    at = places.join(where, "block").select("fp", "n", F.element_at("keys", F.col("doc") + 1).alias("key"))
    wanted = at.groupBy("key.a", "key.b").agg(F.collect_list(F.struct("fp", "n")).alias("wanted"))  # as many as the text has runs

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _blocks(batches):
            langs = batch.column("lang").to_pylist()
            runs = Runs(part, langs, moduli)
            asked = batch.column("wanted")
            fp, n = (asked.flatten().field(i).to_numpy() for i in range(2))
            text = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
            names, fp = np.unique(fp.view(np.uint64), return_inverse=True)
            wanted_in = fp * len(part) + text  # a number for each fingerprint and text
            rows = []
            for size in range(1, LONGEST + 1):
                have, _, at = runs.fingerprints(size)
                slot = np.minimum(np.searchsorted(names, have), len(names) - 1)
                hit = np.flatnonzero(names[slot] == have)
                known, first = np.unique(slot[hit] * len(part) + runs.text[at[hit]], return_index=True)
                place = np.minimum(np.searchsorted(known, wanted_in), max(len(known) - 1, 0))
                ok = np.flatnonzero(known[place] == wanted_in) if len(known) else []
                rows += [(langs[text[i]], runs.phrase(int(at[hit[first[place[i]]]]), size), size, int(n[i])) for i in ok]
            out = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "size", "n"])

    rows = texts.join(wanted, ["a", "b"]).select("lang", "text", "wanted").mapInArrow(look, "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("n").alias("n"))  # repeated rows are looked up once each


def _recounted(texts: DataFrame, clashing: DataFrame, least: int, moduli: tuple[int, int]) -> DataFrame:
    """lang, phrase, size and n of the runs whose fingerprint others share, counted by their text."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _blocks(batches):
            langs = batch.column("lang").to_pylist()
            runs = Runs(part, langs, moduli)
            for size in range(1, LONGEST + 1):
                fp, _, at = runs.fingerprints(size)
                for i in range(0, len(at), 50_000):
                    some = at[i : i + 50_000]
                    names = [langs[t] for t in runs.text[some]], [runs.phrase(int(w), size) for w in some]
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i : i + 50_000].view(np.int64)), pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array(np.full(len(some), size, np.int32))], names=["fp", "lang", "phrase", "size"])

    rows = texts.select("lang", "text").mapInArrow(spell, "fp long, lang string, phrase string, size int").join(clashing.select("fp"), "fp", "left_semi")
    return rows.groupBy("lang", "phrase", "size").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "phrase", "size", "n")


def frequent(docs: DataFrame, least: int = LEAST, moduli: tuple[int, int] = MODULI) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and n of all runs of one to three words that occur least times or more; and lang and n, its words."""
    texts = _texts(docs)
    found = _found(texts, least, moduli)
    out = _materialised(texts, found, moduli)
    clashing = found.where("clash")
    if not clashing.isEmpty():
        out = out.unionByName(_recounted(texts, clashing, least, moduli))
    totals = found.select(F.explode("words").alias("w")).groupBy("w.lang").agg(F.sum("w.n").alias("n"))
    out, totals = written(out, "phrases"), written(totals, "phrase-words")
    forget(found)
    return out, totals


def _beside(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """rows with the count of the phrase in column part; common parts are dealt to many tasks."""
    asked = rows.groupBy("lang", F.col(part).alias("phrase")).agg(F.count("*").alias("_asked"))
    known = counts.select("lang", "phrase", F.col("n").alias(name)).join(asked, ["lang", "phrase"]).withColumnRenamed("phrase", part)
    return spread(rows, known, ["lang", part], "phrase", "_asked")


def score(a: str | Column, left: str | Column, right: str | Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact; counts have 15 digits at most, products 38."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, moduli: tuple[int, int] = MODULI) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a, l, r and score of the phrases of two and three words that no longer one covers; and lang and n, its words.

    A part occurs as often as its phrase at least, so the frequent runs hold all parts.
    """
    runs, totals = frequent(docs, least, moduli)
    words = F.split("phrase", " ")
    cut = lambda i, j: F.array_join(F.slice(words, i, j), " ")
    phrases = runs.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": cut(F.lit(1), F.col("k")), "right": cut(F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = _beside(_beside(cuts, runs, "left", "l"), runs, "right", "r").withColumn("score", score("a", "l", "r"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = phrases.where(F.col("size") == LONGEST).select("lang", "a", F.explode(F.array_distinct(F.array(cut(F.lit(1), F.lit(2)), cut(F.lit(2), F.lit(2))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * covered))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), totals


def top(phrases: DataFrame, totals: DataFrame, most: int = MOST) -> DataFrame:
    """The first phrases of each language by score, occurrences and bytes, with their rank and the words of the language."""
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")
    # the first of each of PARTS parts of a language hold the first of all
    parted = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = parted.withColumn("rank", place("lang", "_part")).where(F.col("rank") <= most).drop("_part")
    ranked = near.withColumn("rank", place("lang")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_rabin_karp_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(*collocations(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM lists),
three AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
runs AS (
  SELECT lang, 1 AS size, x AS phrase FROM three UNION ALL
  SELECT lang, 2, x || ' ' || y FROM three WHERE y IS NOT NULL UNION ALL
  SELECT lang, 3, x || ' ' || y || ' ' || z FROM three WHERE z IS NOT NULL),
f AS MATERIALIZED (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS n FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.n AS l, y.n AS r, 1000000 * c.a * c.a // (x.n * y.n) AS score
  FROM c JOIN (SELECT unnest([1, 2]) AS k) ON k < c.size
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE size = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
