"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. Pairs of a good and a bad document train
it by the logistic loss of feature differences. The strength at which documents are accepted is a
quantile of the strengths of training documents, the share that labels mark as bad; the score maps
strengths to (0, 1) so that this threshold scores ACCEPT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as k
from .common import internal, least_hashes, remainder, table
from .stats import CLASSES, measure

ACCEPT = 0.3
#: Labelled documents and preference pairs that a fit reads at most; documents are taken by hash of the id.
SAMPLE, PAIRS = 20_000, 200_000
_PUNCTUATION = [b"!", b"|", b"#", b"*", b"$", b"%", b"&", b".", b",", b"<", b">", b"?", b"@", b"/", b"="]


def features(part: k.Slice) -> np.ndarray:
    """One row a text. Shares are clipped logarithms and plain values, so that a linear function can bend."""
    s = measure(part)
    n, chars = np.maximum(s.n_words, 1), np.maximum(s.classes.sum(1), 1)
    of = s.words.text_of()
    key, first = np.unique(k.mix(s.words.hash + of.astype(np.uint64) * k._BASE), return_index=True)
    distinct = np.bincount(of[first], minlength=len(part))
    length = s.words.end - s.words.start
    short = np.bincount(of[length <= 3], minlength=len(part))
    upper = s.classes[:, CLASSES.index("upper")] / np.maximum(s.classes[:, CLASSES.index("upper")] + s.classes[:, CLASSES.index("lower")], 1)
    shares = [s.classes[:, i] / chars for i in range(len(CLASSES))] + [s.bytes[:, c[0]] / n for c in _PUNCTUATION]
    shares += [upper, s.n_dup_lines / np.maximum(s.n_lines, 1), s.n_repeat_words / n, distinct / n, short / n, s.n_lines / n]
    shares = np.stack(shares, 1)
    size = np.stack([np.log1p(s.n_words), np.log1p(s.n_words) ** 2 / 10, s.word_chars / n / 10, np.log1p(s.n_dup_lines), s.n_words < 10, s.n_words < 30], 1)
    return np.concatenate([size, shares, np.log(shares + 1e-3)], 1)


_FEATURES = "doc_id long, f array<double>"


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in k.slices(batch.column("text")):
            f = features(part)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), lists], ["doc_id", "f"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, f: np.ndarray) -> np.ndarray:
        return np.clip((f - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, f: np.ndarray) -> np.ndarray:
        x = self.strength(f) - self.threshold + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_pairs(f: np.ndarray, good: np.ndarray, steps: int = 400, decay: float = 1e-3, pairs: int = PAIRS) -> Model:
    """Bradley-Terry strengths from features and labels; with labels of one kind only, all strengths are equal.

    Each bad document meets as many good ones as the bound on pairs allows, in a fixed random order.
    """
    f = np.asarray(f, float)
    mean, scale = (f.mean(0), f.std(0)) if len(f) else (np.zeros(f.shape[1]), np.ones(f.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1)
    z = np.clip((f - mean) / scale, -6, 6)
    w = np.zeros(z.shape[1])
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Model(mean, scale, w, 0.0)
    rng = np.random.default_rng(7)
    each = max(1, min(len(up), pairs // len(down)))
    losers = np.repeat(down, each)[:pairs]
    winners = np.concatenate([rng.permutation(up) for _ in range(-(-len(losers) // len(up)))])[: len(losers)]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        pick = rng.integers(0, len(losers), min(len(losers), 8192))
        d = z[winners[pick]] - z[losers[pick]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    threshold = float(np.quantile(z @ w, len(down) / len(f), method="midpoint"))
    return Model(mean, scale, w, threshold)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents that are not held out: SAMPLE of them at most, the first by hash of the id.

    A document that any row of labels marks 0 counts as bad; rows without a label or an id are left out.
    Of several texts with one id the one of the least features counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder("doc_id", 5) != 0)).select("doc_id", "quality")
    chosen = least_hashes(known, "doc_id", SAMPLE)  # a bounded sample, so it may be broadcast
    known = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = internal(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    quality = {r["doc_id"]: r["quality"] for r in known.collect()}
    rows = rows.mapInArrow(_feature_rows, _FEATURES).groupBy("doc_id").agg(F.min("f").alias("f"))
    found = sorted((r["doc_id"], r["f"]) for r in rows.collect())
    width = features(next(k.slices(pa.array([""])))).shape[1]
    f = np.array([x for _, x in found], float).reshape(len(found), width)
    return fit_pairs(f, np.array([quality[d] == 1 for d, _ in found], bool))


_OUT = "doc_id long, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; a null text scores as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), pa.array(model.score(features(part)))], ["doc_id", "score"])

    return internal(docs, "doc_id", "text").mapInArrow(run, _OUT)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.score(features(part)) >= ACCEPT for part in k.slices(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
