"""Language identification by a bidirectional gated recurrent network over bytes.

Two small GRUs read a text's bytes forwards and backwards; together they label every position, and the
document gets the mean of its positions' probabilities. Gates use the piecewise linear sigmoid. The
network is trained here, in numpy, by backpropagation through time on chunks of a bounded sample.
Texts are read whole, as chunks of CHUNK bytes side by side in one batch.
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

HIDDEN, CHUNK, BATCH = 8, 128, 2048
#: Training documents of a language and chunks of a document that a fit reads at most.
SAMPLE, CHUNKS = 600, 6
PAD = 0x20
_ONE_HOT = np.eye(256, dtype=np.float32)


@dataclass
class Network:
    """langs; by direction the input table (byte to gates), recurrent and output weights; output bias."""

    langs: list[str]
    table: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recurrent, *self.out, self.bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    r = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    n = len(langs)
    return Network(langs, [r(256, 3 * hidden, s=0.3) for _ in "ab"], [r(hidden, 3 * hidden, s=0.3) for _ in "ab"], [r(hidden, n, s=0.3) for _ in "ab"], np.zeros(n, np.float32))


def run_direction(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """States after each row of x (time, batch). keep: gets what backpropagation needs."""
    size = u.shape[0]
    h = np.zeros((x.shape[1], size), np.float32)
    for row in x:
        a, b = table[row], h @ u
        gates = a[:, : 2 * size]
        gates += b[:, : 2 * size]
        gates *= np.float32(0.25)
        gates += np.float32(0.5)
        np.clip(gates, 0, 1, out=gates)
        reset, update = gates[:, :size], gates[:, size:]
        new = np.tanh(a[:, 2 * size :] + reset * b[:, 2 * size :])
        if keep is not None:
            keep.append((row, h, gates, b[:, 2 * size :], new))
        h = new + update * (h - new)
        yield h


def back_direction(keep: list, d_states: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights by backpropagation through time."""
    size = u.shape[0]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(keep) - 1, -1, -1):
        row, h, gates, b_new, new = keep[t]
        d_h = d_h + d_states[t]
        reset, update = gates[:, :size], gates[:, size:]
        d_pre = d_h * (1 - update) * (1 - new * new)
        d_gates = np.concatenate((d_pre * b_new, d_h * (h - new)), 1) * ((gates > 0) & (gates < 1)) * np.float32(0.25)
        d_a = np.concatenate((d_gates, d_pre), 1)
        d_b = np.concatenate((d_gates, d_pre * reset), 1)
        d_table += _ONE_HOT[row].T @ d_a
        d_u += h.T @ d_b
        d_h = d_h * update + d_b @ u.T
    return d_table, d_u


def train(x: np.ndarray, filled: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 160, batch: int = 192, rate: float = 0.03) -> Network:
    """A network from chunks x (chunk, byte), the bytes each holds, and languages y by number; a fixed seed makes it repeatable."""
    net, rng = new_network(langs), np.random.default_rng(5)
    params = net.parameters()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(batch, 4 * len(x)))
        rows, goal = x[pick].T, y[pick]
        live = (np.arange(x.shape[1])[:, None] < filled[pick]).astype(np.float32)
        kept: list[list] = [[], []]
        states = [np.stack(list(run_direction(r, net.table[d], net.recurrent[d], kept[d]))) for d, r in enumerate((rows, rows[::-1]))]
        logits = states[0] @ net.out[0] + (states[1] @ net.out[1])[::-1] + net.bias
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(len(goal)), goal] -= 1
        p *= (live / max(live.sum(), 1))[:, :, None]
        grads_t, grads_u, grads_o = [], [], []
        for d in range(2):
            g = p if d == 0 else p[::-1]
            grads_o.append(np.einsum("tbh,tbl->hl", states[d], g))
            dt, du = back_direction(kept[d], g @ net.out[d].T, net.table[d], net.recurrent[d])
            grads_t.append(dt)
            grads_u.append(du)
        now = rate * (1 - step / (steps + 1))
        for i, (q, g) in enumerate(zip(params, [*grads_t, *grads_u, *grads_o, p.sum((0, 1))], strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            q -= (now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _split(net: Network, d: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Input tables and recurrent weights by gate (reset, update, new), with the gates' slope and offset folded in."""
    size = net.recurrent[d].shape[0]
    tables = [np.ascontiguousarray(net.table[d][:, i * size : (i + 1) * size]) for i in range(3)]
    weights = [np.ascontiguousarray(net.recurrent[d][:, i * size : (i + 1) * size]) for i in range(3)]
    quarter, half = np.float32(0.25), np.float32(0.5)
    return [tables[0] * quarter + half, tables[1] * quarter + half, tables[2]], [weights[0] * quarter, weights[1] * quarter, weights[2]]


def _states(net: Network, d: int, x: np.ndarray) -> Iterator[np.ndarray]:
    """As run_direction, in place and by contiguous gates; each state is valid until the next."""
    tables, weights = _split(net, d)
    size = weights[0].shape[0]
    h = np.zeros((x.shape[1], size), np.float32)
    a, b, gate, update = (np.empty_like(h) for _ in range(4))

    def line(i: int, row: np.ndarray, out: np.ndarray) -> None:
        np.take(tables[i], row, axis=0, out=out, mode="clip")
        np.matmul(h, weights[i], out=b)

    for row in x:
        for i, out in ((0, gate), (1, update)):
            line(i, row, out)
            out += b
            np.maximum(out, 0, out=out)
            np.minimum(out, 1, out=out)
        line(2, row, a)
        np.multiply(gate, b, out=b)
        a += b
        np.tanh(a, out=a)
        h -= a
        h *= update
        h += a
        yield h


def position_scores(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities (language, time, batch) of every position of x (time, batch)."""
    length, batch = x.shape
    logits = np.empty((length, batch, len(net.langs)), np.float32)
    part = np.empty((batch, len(net.langs)), np.float32)
    for t, h in enumerate(_states(net, 0, x)):
        np.matmul(h, net.out[0], out=logits[t])
    for t, h in enumerate(_states(net, 1, x[::-1])):
        np.matmul(h, net.out[1], out=part)
        logits[length - 1 - t] += part
    p = np.ascontiguousarray(logits.transpose(2, 0, 1))
    p += net.bias[:, None, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def pooled(net: Network, part: k.Slice) -> tuple[np.ndarray, np.ndarray]:
    """By text: sums of its positions' probabilities and counts of positions by label, (text, language)."""
    size = np.diff(part.offsets)
    chunks = -(-size // CHUNK)
    of = np.repeat(np.arange(len(part)), chunks)
    at = np.arange(len(of)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = part.offsets[of] + at * CHUNK
    filled = np.minimum(size[of] - at * CHUNK, CHUNK)
    data = np.concatenate((part.data, np.full(CHUNK, PAD, np.uint8)))
    total, labels = np.zeros((len(part), len(net.langs))), np.zeros((len(part), len(net.langs)), np.int64)
    for a in range(0, len(of), BATCH):
        own = slice(a, a + BATCH)
        live = np.arange(CHUNK)[:, None] < filled[own]
        x = np.where(live, data[start[own] + np.arange(CHUNK)[:, None]], PAD)
        p = position_scores(net, x.astype(np.intp))
        p *= live
        best = p.max(0)
        for i in range(len(net.langs)):
            total[:, i] += np.bincount(of[own], p[i].sum(0), len(part))
            labels[:, i] += np.bincount(of[own], ((p[i] == best) & live).sum(0), len(part)).astype(np.int64)
    return total, labels


_SAMPLE = "lang string, chunk binary"


def _sample_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to CHUNKS chunks of each text, spread evenly over all of it."""
    for batch in batches:
        for part in k.slices(batch.column("text")):
            lang, chunk = [], []
            names = batch.column("lang").slice(part.first, len(part)).to_pylist()
            for i in range(len(part)):
                text = part.text(i)
                n = min(CHUNKS, -(-len(text) // CHUNK))
                for j in range(n):
                    a = (len(text) - CHUNK) * j // max(n - 1, 1) if len(text) > CHUNK else 0
                    lang.append(names[i])
                    chunk.append(text[a : a + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(chunk, pa.binary())], ["lang", "chunk"])


def fit(docs: DataFrame) -> Network | None:
    """A network from documents that are not held out and have a language and a letter.

    Up to SAMPLE documents a language, the first by hash of the id, so that large languages don't drown
    small ones; of several texts with one id and language the first in their order. None if there are no
    such documents.
    """
    rows = internal(docs, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder("doc_id", 4) != 2))
    ids = least_hashes(rows.select("doc_id", "lang"), "doc_id", SAMPLE, "lang")
    chosen = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")  # SAMPLE rows a language at most
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = sorted((r["lang"], bytes(r["chunk"])) for r in chosen.mapInArrow(_sample_chunks, _SAMPLE).collect())
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    x = np.array([list(c.ljust(CHUNK, b" ")) for _, c in found], np.uint8)
    filled, y = np.array([len(c) for _, c in found]), np.array([langs.index(lang) for lang, _ in found])
    even = np.concatenate([np.resize(np.flatnonzero(y == i), SAMPLE * CHUNKS) for i in range(len(langs))])
    return train(x[even], filled[even], y[even], langs)


_OUT = "doc_id long, lang_pred string, score double, positions long, agreeing long"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, positions (bytes) and agreeing (positions labelled lang_pred), one row a document.

    A null text, a text without a letter, and every text if there is no network, is und with score 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in k.slices(batch.column("text")):
                n, langs = len(part), np.array(net.langs + ["und"], object)
                letters = np.array(batch.column("letters").slice(part.first, n).to_pylist(), bool)
                total, labels = pooled(net, part)
                best = total.argmax(1)
                share = total[np.arange(n), best] / np.maximum(np.diff(part.offsets), 1)
                agree = np.where(letters, labels[np.arange(n), best], 0)
                names = langs[np.where(letters, best, len(net.langs))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, n), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, np.clip(share, 0, 1), 0.0)), pa.array(np.diff(part.offsets)), pa.array(agree)],
                    [x.split()[0] for x in _OUT.split(", ")],
                )

    rows = internal(docs, "doc_id", "text").withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if net is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("positions"), F.lit(0).cast("long").alias("agreeing"))
    return rows.mapInArrow(run, _OUT)


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "positions", "agreeing")
