"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A CGK walk reads a word sequence and copies the word under its pointer at each step; whether the
pointer moves on is a random bit of the step and the word. Walks over similar sequences fall into step
again after an edit, so edit distance becomes Hamming distance of the copies. Each table samples a few
steps of a walk; its key is the hash of the words copied there. Walks start at every word of every
document, at every word of an item of under CLASSES[-1] words and at every STRIDE-th word of a longer one.
Tables are added until copies with the most edits allowed are found with the recall asked for in every
class of lengths. A class that doesn't get there, and items of under SHORT words, are searched by pieces
instead: of one piece more than edits are allowed, one stands unchanged in the passage, so none is missed.
Every candidate is verified by its exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as k
from .common import fresh, table, written

#: A passage may have one edit for each 1 / EDITS words of its item, so items of under 5 words are found verbatim only.
EDITS, RECALL = 0.2, 0.98
#: Words that a walk spans, sampled steps a key, tables a walk, distance of walks over an item.
SPAN, SAMPLED, PER_WALK, STRIDE = 16, 6, 6, 3
#: Words of items a block. Its index takes 16 bytes a word and table, and a bit map of half a megabyte a table: 63 MB at most.
BLOCK_WORDS = 100_000
MOST_TABLES, CHUNK = 30, 1 << 15
#: Items of fewer words go by pieces. Least words of the classes whose recall is measured, by COPIES copies of each.
SHORT, CLASSES, COPIES = 25, (25, 30, 40, 60, 100), 600


@dataclass
class Keys:
    """Sorted keys with their item and offset, and a bit map, eight bits a byte, of the keys' first bits."""

    key: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    bits: int
    seen: np.ndarray

    def matches(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of row with a key, the item of it and its offset, one for each match."""
        head = (row >> np.uint64(64 - self.bits)).view(np.int64)
        at = np.flatnonzero(self.seen.take(head >> 3) >> (head & 7).astype(np.uint8) & 1)
        lo, hi = np.searchsorted(self.key, row[at], "left"), np.searchsorted(self.key, row[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[entry], self.offset[entry]


@dataclass
class Index:
    """Items' ids and word hashes, the tables' sampled steps and keys, and the keys of pieces by their words.

    recall: that of the walks by class of lengths, measured on copies other than those that chose the tables.
    """

    ids: list
    items: list[np.ndarray]
    steps: int
    samples: np.ndarray
    tables: list[Keys]
    pieces: dict[int, Keys]
    recall: dict[int, float]


def allowed(n: int) -> int:
    return int(n * EDITS)


def walk_keys(hashes: np.ndarray, steps: int, samples: np.ndarray) -> np.ndarray:
    """Keys (table, start) of the walks from every word; past the end they read an empty word."""
    n, tables = len(hashes), len(samples)
    padded = np.concatenate((hashes, np.zeros(steps + 1, np.uint64)))
    out = np.zeros((tables, n), np.uint64)
    one = np.uint64(1)
    for walk in range(-(-tables // PER_WALK)):
        own = range(walk * PER_WALK, min(tables, (walk + 1) * PER_WALK))
        moves = k.mix(padded ^ k.PLACE[walk])
        for a in range(0, n, CHUNK):
            b = min(n, a + CHUNK)
            words, move = padded[a : b + steps + 1], moves[a : b + steps + 1]
            at = np.arange(b - a)
            for j in range(steps):
                now = [t for t in own if j in samples[t]]
                if now:
                    copied = words.take(at)
                    for t in now:
                        out[t, a:b] += copied * k.PLACE[j % 64]
                if j < steps - 1:
                    at += ((move.take(at) >> np.uint64(j)) & one).view(np.int64)
    return k.mix(out)


def _tables(steps: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng(11)
    parts = np.linspace(0, steps, min(SAMPLED, steps) + 1).astype(int)  # one step of each part: fewer copies of one word
    return np.stack([rng.integers(parts[:-1], parts[1:]) for _ in range(tables)])


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """words after edits random substitutions, deletions and insertions."""
    out = words.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), rng.integers(len(out))
        new = int(rng.integers(1, 1 << 63))
        out[at : at + (kind != 2)] = [] if kind == 1 and len(out) > 1 else [new]
    return np.array(out, np.uint64)


def _class(n: int) -> int:
    """The least words of the class of lengths that n is in."""
    return max(c for c in CLASSES if c <= n)


def _measured(items: list[np.ndarray], steps: int, samples: np.ndarray, seed: int) -> np.ndarray:
    """By copy (COPIES, of the items in turn) and table: does a copy with as many edits as allowed share a key with its item?"""
    rng = np.random.default_rng(seed)
    noise = lambda: rng.integers(1, 1 << 63, 2 * SPAN, dtype=np.uint64)
    own = [items[i] for i in rng.permutation(len(items))[: COPIES // 4]]
    theirs = [walk_keys(words, steps, samples)[:, _starts(len(words), steps)] for words in own]
    copies = [np.concatenate((_edited(words, allowed(len(words)), rng), noise())) for words in (own * COPIES)[:COPIES]]
    keys = walk_keys(np.concatenate((noise(), *copies)), steps, samples)
    # each copy's keys are marked with its number, so that one search a table serves all copies
    mark = lambda sizes: k.mix(np.repeat(np.arange(1, COPIES + 1), sizes).astype(np.uint64))
    copy_of = mark([len(x) for x in copies])
    keys = keys[:, SPAN : SPAN + len(copy_of)] ^ copy_of
    theirs = (theirs * COPIES)[:COPIES]
    sizes = [x.shape[1] for x in theirs]
    first = np.cumsum([0, *sizes[:-1]])
    own_keys = np.concatenate(theirs, axis=1) ^ mark(sizes)
    return np.stack([np.logical_or.reduceat(np.isin(x, y), first) for x, y in zip(own_keys, keys, strict=True)], 1)


def _starts(n: int, steps: int) -> np.ndarray:
    """Places of an item from which a walk, at half a word a step, stays inside it."""
    return np.arange(0, max(1, n - int(steps / 1.7) + 1), 1 if n < CLASSES[-1] else STRIDE)


def _pieces(n: int) -> np.ndarray:
    """Bounds of one piece more than edits are allowed in n words."""
    return np.linspace(0, n, allowed(n) + 2).astype(int)


def _keys(found: list[tuple[np.ndarray, int, np.ndarray]]) -> Keys:
    """Keys of (keys, item, offsets) of items."""
    key, at = (np.concatenate([x[i] for x in found]) for i in (0, 2))
    owner = np.repeat([x[1] for x in found], [len(x[0]) for x in found])
    order = np.argsort(key, kind="stable")
    bits = max(12, int(np.ceil(np.log2(len(key) + 1))) + 5)
    seen = np.zeros(1 << bits, bool)
    seen[(key >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Keys(key[order], owner[order].astype(np.int32), at[order].astype(np.int32), bits, np.packbits(seen, bitorder="little"))


def build(ids: list, texts: list[str | None], recall: float = RECALL) -> Index | None:
    """An index of the items that hold a word. None if there is none."""
    if not texts:
        return None
    items = []
    for part in k.slices(pa.array(texts, pa.string())):
        w = k.words(part, k.NOT_ALNUM, lower=True)
        items += [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(part))]
    some = [(i, x) for i, x in zip(ids, items, strict=True) if len(x)]
    ids, items = [i for i, _ in some], [x for _, x in some]
    if not items:
        return None
    steps, samples = int(1.7 * SPAN), _tables(int(1.7 * SPAN), MOST_TABLES)
    by_class: dict[int, list[np.ndarray]] = {}
    for words in items:
        if len(words) >= SHORT:
            by_class.setdefault(_class(len(words)), []).append(words)
    hits = {c: _measured(own, steps, samples, 13) for c, own in by_class.items()}
    tables, least = 0, recall + 2 * (recall * (1 - recall) / COPIES) ** 0.5  # two standard errors above the target
    for c in list(hits):  # the fewest tables that serve a class; one that no number serves goes by pieces
        need = next((n for n in range(PER_WALK, MOST_TABLES + 1, PER_WALK) if hits[c][:, :n].any(1).mean() >= min(1.0, least)), None)
        if need is None:
            del hits[c]
        else:
            tables = max(tables, need)
    samples = samples[:tables]
    walked: list[list] = [[] for _ in range(tables)]
    cut: dict[int, list] = {}
    for i, words in enumerate(items):
        if len(words) >= SHORT and _class(len(words)) in hits:
            at = _starts(len(words), steps)
            for t, row in enumerate(walk_keys(words, steps, samples)[:, at]):
                walked[t].append((row, i, at))
        else:
            bounds = _pieces(len(words))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                cut.setdefault(int(b - a), []).append((k.windows(words[a:b], int(b - a))[:1], i, np.array([a])))
    held_out = {c: float(_measured(by_class[c], steps, samples, 17).any(1).mean()) for c in sorted(hits)}
    return Index(ids, items, steps, samples, [_keys(x) for x in walked], {n: _keys(x) for n, x in cut.items()}, held_out)


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def candidates(index: Index, hashes: np.ndarray) -> np.ndarray:
    """Distinct (item, word at which it would begin) of all keys of walks that hashes share with the index."""
    out = []
    for keys, row in zip(index.tables, walk_keys(hashes, index.steps, index.samples) if index.tables else (), strict=True):
        at, item, offset = keys.matches(row)
        if len(at):
            out.append(np.stack((item.astype(np.int64), at - offset), 1))
    return _distinct(out)


def piece_candidates(index: Index, w: k.Words) -> np.ndarray:
    """Distinct (item, word at which it would begin, text) of all pieces that stand in a text."""
    out, left = [], w.left() if index.pieces else None
    for n, keys in index.pieces.items():
        at, item, offset = keys.matches(k.windows(w.hash, n))
        inside = left[at] >= n
        at, item, offset = at[inside], item[inside], offset[inside]
        if len(at):
            out.append(np.stack((item.astype(np.int64), at - offset, np.searchsorted(w.first, at, "right") - 1), 1))
    return _distinct(out)


def best_edits(pattern: list[int], text: list[int]) -> int:
    """Least edit distance, in words, of pattern to any part of text, by bit vectors (Myers 1999)."""
    n = len(pattern)
    eq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score, best = full, 0, n, n
    for w in text:
        x = eq.get(w, 0)
        vertical = x | down
        x = (((x & up) + up) ^ up) | x
        plus, minus = down | ~(x | up) & full, up & x
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        best = min(best, score)
    return best


def leaks(index: Index, w: k.Words) -> list[dict[int, int]]:
    """By text: the items that it holds, with their least edits."""
    out: list[dict[int, int]] = [{} for _ in range(len(w.first) - 1)]

    def verify(t: int, i: int, at: int, spare: int) -> None:
        if out[t].get(i) == 0:
            return
        words = index.items[i]
        slack = allowed(len(words))
        a, b = max(w.first[t], at - slack - spare), min(w.first[t + 1], at + len(words) + slack + spare)
        if b - a < len(words) - slack:
            return
        pattern, text = words.tolist(), w.hash[a:b].tolist()
        here = set(text)
        if sum(x not in here for x in pattern) > slack:  # a word that isn't there is an edit
            return
        edits = best_edits(pattern, text)
        if edits <= slack:
            out[t][i] = min(edits, out[t].get(i, edits))

    for i, at, t in piece_candidates(index, w).tolist():
        verify(t, i, at, 0)
    found = candidates(index, w.hash)
    if not len(found):
        return out
    # the word of the text at which an item begins may lie before the text's first word
    size = np.array([len(x) for x in index.items])[found[:, 0]]
    last = len(w.hash) - 1
    sides = [np.searchsorted(w.first, np.clip(at, 0, last), "right") - 1 for at in (found[:, 1], found[:, 1] + size // 2, found[:, 1] + size - 1)]
    for (i, at), texts in zip(found.tolist(), np.stack(sides, 1).tolist(), strict=True):
        for t in set(texts):
            verify(t, i, at, SPAN)
    return out


_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
_OUT = "doc_id long, text string, hits array<struct<item_id: long, edits: long>>"


def _scan(docs: DataFrame, schema: object, text_at: int, index: Index, keep_clean: bool) -> DataFrame:
    """Search column text_at; keep the rows without a hit, or add hits to the third column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = []
            for part in k.slices(batch.column(text_at)):
                of = leaks(index, k.words(part, k.NOT_ALNUM, lower=True))
                found += [[{"item_id": index.ids[i], "edits": e} for i, e in sorted(x.items())] for x in of]
            if keep_clean:
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))
            else:
                before = batch.column("hits").to_pylist()
                hits = pa.array([a + b for a, b in zip(before, found, strict=True)], _HIT)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), hits], ["doc_id", "text", "hits"])

    return docs.mapInArrow(run, schema)


def indexes(benchmark: DataFrame, recall: float = RECALL, block: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of blocks of about block words each, one after the other; each block is a fixed query set against all documents."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.lower("text").alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-words // block))
    for i in range(blocks):
        rows = sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect())
        found = build([r[0] for r in rows], [r[1] for r in rows], recall)
        if found:
            yield found


def _by_block(docs: DataFrame, benchmark: DataFrame, schema: object, text_at: int, keep_clean: bool) -> DataFrame:
    """Scan with one index after the other; what one found is written before the next is built, so one is held at a time."""
    out, held = docs, None
    for index in indexes(benchmark):
        out = _scan(out if held is None else written(out, "decontaminated"), schema, text_at, index, keep_clean)
        held = index
    return out


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text (in lower case) and hits: the items whose wording stands in the text with few enough edits, and the edits.

    Null and empty texts have no hits; null items and those without a word are never found; an item that is
    given twice is reported twice.
    """
    out = docs.select("doc_id", F.lower("text").alias("text")).withColumn("hits", F.array().cast("array<struct<item_id: long, edits: long>>"))
    return _by_block(out, benchmark, _OUT, 1, False)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with their own columns."""
    names = docs.columns
    out = docs.withColumn(fresh(docs, "wording"), F.lower(F.col("text")))
    return _by_block(out, benchmark, out.schema, len(names), True).select(*[F.col(f"`{c}`") for c in names])


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    hit = F.size("hits") > 0
    return found.select("doc_id", hit.alias("contaminated"), (~hit).alias("kept"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("least_edits"))
