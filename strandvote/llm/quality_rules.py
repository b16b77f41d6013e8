"""Quality rules by distribution divergence.

The corpus gives each language a reference: the histogram of character classes and of its most common
words (all others in one cell), counted over all documents that carry the language. A document is
compared with every reference by Jensen-Shannon distance and judged by the nearest one, so it needs no
language of its own. Short texts have unsteady histograms; length guards keep them out of each rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as k
from .common import internal, table
from .stats import CLASSES, TO_CLASS, byte_histograms, measure

COMMON = 48
#: Largest distances and least lengths (code points, words) at which each rule speaks.
CLASS_LIMIT, CLASS_LEAST, WORD_LIMIT, WORD_LEAST = 0.24, 400, 0.46, 60
#: Distinct (language, word) pairs that a task holds before it passes its partial counts on.
HELD = 1_000_000
_COUNTS = "lang string, kind int, key long, n long"


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: kind 0 of character classes, kind 1 of word hashes, kind 2 of all words."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            key, n = _merge(parts)
            yield _count_batch(lang, 1, key, n)
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for part in k.slices(batch.column("text")):
            w, hist = k.words(part), byte_histograms(part)
            of_text, own = w.text_of(), langs[part.first : part.last]
            for lang in set(own):
                mine = own == lang
                yield _count_batch(lang, 0, np.arange(len(CLASSES)), (hist[mine] @ TO_CLASS).sum(0))
                hashes = w.hash[mine[of_text]]
                yield _count_batch(lang, 2, np.zeros(1), np.array([len(hashes)]))
                parts = held.setdefault(lang, [])
                parts.append(np.unique(hashes.view(np.int64), return_counts=True))
                size += len(parts[-1][0])
            if size > HELD:
                held = {lang: [_merge(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > HELD // 2:
                    yield from flush()
                    size = 0
    yield from flush()


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)


def _count_batch(lang: str, kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), size), pa.array(np.full(size, kind, np.int32)), pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(n, np.int64))],
        ["lang", "kind", "key", "n"],
    )


@dataclass
class References:
    """By language: shares of classes, and of its common words with the rest of the words last."""

    langs: list[str]
    classes: np.ndarray
    vocabulary: np.ndarray
    words: list[tuple[np.ndarray, np.ndarray]]


def references(docs: DataFrame, common: int = COMMON) -> References:
    """Counted over all documents with a language and a text; a few dozen numbers a language reach the driver."""
    rows = internal(docs, "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_partial_counts, _COUNTS).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    top = W.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "key")
    found = counts.withColumn("at", F.row_number().over(top)).where(F.col("at") <= max(common, len(CLASSES))).where(f"kind <> 1 OR at <= {common}")
    by_lang: dict[str, tuple[dict, dict, int]] = {}
    for row in found.collect():
        of = by_lang.setdefault(row["lang"], ({}, {}, [0]))
        if row["kind"] == 2:
            of[2][0] = row["n"]
        else:
            of[row["kind"]][row["key"]] = row["n"]
    langs = sorted(x for x, of in by_lang.items() if of[2][0])
    vocabulary = np.unique(np.array([w for x in langs for w in by_lang[x][1]], np.int64))
    classes = np.array([[by_lang[x][0].get(c, 0) for c in range(len(CLASSES))] for x in langs], float).reshape(len(langs), len(CLASSES))
    own = []
    for x in langs:
        keys = np.array(sorted(by_lang[x][1]), np.int64)
        n = np.array([by_lang[x][1][w] for w in keys.tolist()], float)
        own.append((np.searchsorted(vocabulary, keys), np.append(n, by_lang[x][2][0] - n.sum()) / by_lang[x][2][0]))
    return References(langs, classes / np.maximum(classes.sum(1, keepdims=True), 1), vocabulary, own)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, by row of p against q; 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def _distances(s, ref: References) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: the nearest reference (by the sum of both), its class distance and its word distance."""
    n, none = len(s.n_words), len(ref.langs) == 0
    if none:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    p = s.classes / np.maximum(s.classes.sum(1, keepdims=True), 1)
    by_class = np.stack([js_distance(p, q) for q in ref.classes], 1)
    of, hashes = s.words.text_of(), s.words.hash.view(np.int64)
    at = np.minimum(np.searchsorted(ref.vocabulary, hashes), len(ref.vocabulary) - 1)
    hit = ref.vocabulary[at] == hashes
    seen = np.bincount(of[hit] * len(ref.vocabulary) + at[hit], minlength=n * len(ref.vocabulary)).reshape(n, -1)
    by_word = np.empty_like(by_class)
    for j, (cells, q) in enumerate(ref.words):
        own = seen[:, cells]
        own = np.concatenate((own, (s.n_words - own.sum(1))[:, None]), 1) / np.maximum(s.n_words, 1)[:, None]
        by_word[:, j] = js_distance(own, q)
    best = (by_class + by_word).argmin(1)
    rows = np.arange(n)
    return best, by_class[rows, best], by_word[rows, best]


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double, nearest string"


def judge(docs: DataFrame, ref: References) -> DataFrame:
    """Base counts, distances to the nearest reference and the verdict, one row a document.

    A text fails the base rules with under 10 words or with more than a fifth of its words in repeated
    5-word windows. It fails the method's rule if its class or word distance is over its limit and it
    is long enough for that rule. A null text counts as empty and fails the base rules. Without any
    language in the corpus only the base rules apply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for part in k.slices(batch.column("text")):
                s = measure(part)
                failed = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
                best, by_class, by_word = _distances(s, ref)
                chars = s.classes.sum(1)
                far = (by_class > CLASS_LIMIT) & (chars >= CLASS_LEAST) | (by_word > WORD_LIMIT) & (s.n_words >= WORD_LEAST)
                names = pa.array([None if b < 0 else ref.langs[b] for b in best], pa.string())
                columns = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, ~failed & ~far, by_class, by_word]
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(part)), *map(pa.array, columns), names], [x.split()[0] for x in _OUT.split(", ")])

    return internal(docs, "doc_id", "text").mapInArrow(run, _OUT)


def op6_distribution_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
