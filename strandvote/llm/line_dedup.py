"""Line de-duplication by winnowing over line hashes.

Lines are told apart by hash; lines without a word are passed over. A window is the shortest run of lines
from a line on, or up to a line, with at least LEAST words. Of each window the line of the least hash (the
last of equal ones) is selected; its position is a fingerprint. A run of at least LEAST words that stands in
two places holds a window, and the window's minimum is the same line in both, so each such run has a
fingerprint in common: none is missed. Positions are joined by fingerprint; those without a partner, nearly
all of a clean corpus, go. From each position that is left, the windows it is the minimum of reach out both
ways. They are compared by content with the first place of that content, whichever it is, so a run may be
matched in part by one earlier document and in part by another. A line is deleted if some window that holds
it has an earlier place; a run of LEAST words can be cut from both ends down to such a window around any of
its lines, so these are just the lines of all later repeated runs. Matched windows are joined into runs. All
joins are with one row a content, not with each holder of it, so a group of copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as k
from .common import forget, internal, spread, table, written

LEAST = 50


def line_table(part: k.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that hold a word: text, line number in it, hash and words."""
    breaks = np.flatnonzero(part.data == 10)
    start = np.sort(np.concatenate((part.offsets[:-1], breaks + 1)))
    counts = np.searchsorted(breaks, part.offsets[1:]) - np.searchsorted(breaks, part.offsets[:-1]) + 1
    text = np.repeat(np.arange(len(part)), counts)
    number = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.cumsum(counts) - 1
    end = np.append(start[1:] - 1, 0)
    end[last] = part.offsets[1:]
    w = k.words(part)
    n = np.bincount(np.searchsorted(start, w.start, "right") - 1, minlength=len(start)) if len(w.start) else np.zeros(len(start), np.int64)
    some = n > 0
    return text[some], number[some], k.span_hash(part.data, start[some], end[some]), n[some]


def windows(text: np.ndarray, n: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First line and line after the last of each window, in the order of lines."""
    size = len(text)
    total = np.concatenate(([0], np.cumsum(n)))
    end = np.searchsorted(total, total[:-1] + least, "left")
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    down_from, up_to = np.flatnonzero(end <= np.searchsorted(text, text, "right")), np.flatnonzero(start >= np.searchsorted(text, text, "left"))
    both = np.unique(np.concatenate((down_from * (size + 1) + end[down_from], start[up_to] * (size + 1) + up_to + 1)))
    return both // (size + 1), both % (size + 1)


def minima(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The line of the least hash of each window, the last one of equals."""
    best, live = start.copy(), np.arange(len(start))
    for j in range(1, LEAST):  # a line has a word, so no window has more lines
        live = live[start[live] + j < end[live]]
        if not len(live):
            break
        at = start[live] + j
        lower = hashes[at] <= hashes[best[live]]
        best[live[lower]] = at[lower]
    return best


def contents(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the lines of each window."""
    one, two = (end - start).astype(np.uint64), np.zeros(len(start), np.uint64)
    live = np.arange(len(start))
    for j in range(LEAST):
        live = live[start[live] + j < end[live]]
        if not len(live):
            break
        own = hashes[start[live] + j]
        one[live] += own * k.PLACE[j]
        two[live] += k.mix(own ^ k.PLACE[j])
    return k.mix(one), k.mix(two)


_LINES = "doc_id long, text string, n_lines long, words array<int>, numbers array<int>, hashes array<long>, minima array<int>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _LINES.split(", ")]
    by = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
    for batch in batches:
        for part in k.slices(batch.column("text")):
            text, number, hashes, n = line_table(part)
            at = np.unique(minima(hashes, *windows(text, n)))
            bounds = np.searchsorted(text, np.arange(len(part) + 1))
            places = (at - bounds[text[at]]).astype(np.int32)
            lists = [by(n.astype(np.int32), bounds), by(number.astype(np.int32), bounds), by(hashes.view(np.int64), bounds), by(places, np.searchsorted(at, bounds))]
            first = [batch.column(c).slice(part.first, len(part)) for c in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*first, pa.array(part.per_text(part.data == 10) + 1), *lists], names)


#: A window's place is its first line and its lines, at most LEAST.
_BITS = 6
_WINDOWS = "uid long, doc_id long, text_hash long, place long, key long, check long"


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows, with their contents, of which a line in column at is the minimum."""
    for batch in batches:
        flat = lambda c, b=batch: b.column(c).flatten().to_numpy(zero_copy_only=False)
        size = batch.column("hashes").value_lengths().to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.cumsum(size)))
        doc = np.repeat(np.arange(batch.num_rows), size)
        hashes = flat("hashes").view(np.uint64)
        asked = np.zeros(len(hashes), bool)
        asked[np.repeat(first[:-1], batch.column("at").value_lengths().to_numpy(zero_copy_only=False)) + flat("at")] = True
        start, end = windows(doc, flat("words").astype(np.int64))
        own = asked[minima(hashes, start, end)]
        start, end = start[own], end[own]
        of = doc[start]
        ids = [batch.column(c).take(pa.array(of)) for c in ("uid", "doc_id", "text_hash")]
        columns = [(start - first[of]) << _BITS | end - start, *[x.view(np.int64) for x in contents(hashes, start, end)]]
        yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, columns)], [x.split()[0] for x in _WINDOWS.split(", ")])


def _covered(places: pa.Array) -> pa.Array:
    """The lines, from 0 and in order, that windows at these places cover, for each list of places."""
    flat, sizes = places.flatten().to_numpy(zero_copy_only=False), places.value_lengths().to_numpy(zero_copy_only=False)
    out, ends = [np.zeros(0, np.int64)], [0]
    for own in np.split(flat, np.cumsum(sizes)[:-1]):
        start, n = own >> _BITS, own & ((1 << _BITS) - 1)
        edge = np.zeros(int((start + n).max(initial=0)) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n, -1)
        out.append(np.flatnonzero(np.cumsum(edge) > 0))
        ends.append(ends[-1] + len(out[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.int32()))


def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers; null stays null."""
    out = []
    for text, numbers in zip(texts, removed, strict=True):
        if not text.is_valid:
            out.append(None)
            continue
        lines = text.as_py().split("\n")
        keep = np.ones(len(lines), bool)
        keep[numbers.values.to_numpy(zero_copy_only=False)] = False
        out.append("\n".join([lines[i] for i in np.flatnonzero(keep).tolist()]))
    return pa.array(out, pa.string())


def _found(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text, n_lines, words, numbers and gone (lines with a word, from 0, to delete), one row a document."""
    rows = docs.select("doc_id", "text").mapInArrow(_read, _LINES)
    rows = written(rows.withColumns({"uid": F.monotonically_increasing_id(), "text_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}), "lines")
    spots = rows.select("uid", F.explode("minima").alias("at"), "hashes").select("uid", "at", F.element_at("hashes", F.col("at") + 1).alias("fingerprint"))
    shared = written(spots.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"), "fingerprints")
    met = spread(spots, shared, ["fingerprint"], "uid", "n").groupBy("uid").agg(F.collect_list("at").alias("at"))
    held = written(rows.select("uid", "doc_id", "text_hash", "words", "hashes").join(met, "uid").mapInArrow(_reach, _WINDOWS), "windows")
    firsts = held.groupBy("key", "check").agg(F.min(F.struct("doc_id", "text_hash", "uid", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("key", "check", F.col("first.uid").alias("first"), F.col("first.place").alias("first_place"), "n"), "first-windows")
    later = spread(held, firsts, ["key", "check"], "uid", "n").where("uid <> first OR place <> first_place")
    gone = later.groupBy("uid").agg(F.collect_list("place").alias("places")).select("uid", F.arrow_udf(_covered, "array<int>")("places").alias("gone"))
    gone = written(gone, "gone")
    forget(shared, held, firsts)
    # one plan at every size, so that what small tables show holds for large ones
    out = rows.select("uid", "doc_id", "text", "n_lines", "words", "numbers").join(gone.hint("merge"), "uid", "left")
    return out.withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))


def _pick(col: str) -> Column:
    return F.transform("gone", lambda i: F.element_at(col, i + 1))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed (line numbers from 0, sorted) and words_removed, one row a document.

    Documents are ordered by doc_id (nulls first), then by hash of the text; of repeated rows one is the
    first. A run may repeat inside its own document; there too the later one goes. Null and empty texts
    have one line and lose none.
    """
    return _removed(_found(docs)).drop("text")


def _removed(found: DataFrame) -> DataFrame:
    words = F.aggregate(_pick("words"), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("doc_id", "text", "n_lines", _pick("numbers").alias("removed"), words.alias("words_removed"))


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated lines, n_lines, n_removed and words_removed, one row a document."""
    some = F.size("removed") > 0
    kept = F.arrow_udf(_without, "string")(F.when(some, F.col("text")), "removed")
    return _removed(_found(docs)).select("doc_id", F.when(some, kept).otherwise(F.col("text")).alias("text"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "words_removed")


def op2_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(internal(table(spark, sf_dir, "documents"), "doc_id", "text"))
