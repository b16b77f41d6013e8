"""Raw votes from JSON, read by splits.

Files of lines are read by Spark's own splits. A file that is one object, headers with lists of bins, is cut into
splits of bytes. A first pass counts the quotes of each split that no backslash escapes; whether a split begins
inside a string is then the parity of those before it. As headers are the only strings, every quote that opens
one begins an entry, and each task reads the entries that begin in its split, to the next one's beginning.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .named import file_system

#: Bytes of a split, and of what is read and parsed at once.
SPLIT, CHUNK = 64 << 20, 1 << 20


def _files(path: str) -> list[tuple[str, int, bool]]:
    """Files at a path, or under it: their path, size, and whether they hold an object on each line."""
    from pyarrow import fs

    where, root = file_system(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    out = []
    for f in found:
        with where.open_input_file(f.path) as file:
            out.append((f.path, f.size, file.read(64).lstrip().startswith(b'{"header"')))
    return out


def _quotes(file: pa.NativeFile, start: int, end: int) -> Iterator[np.ndarray]:
    """Places of the quotes in [start, end) that aren't escaped: an even number of backslashes is before them."""
    run = 0  # backslashes right before the chunk
    while run < start and file.read_at(1, start - 1 - run) == b"\\":
        run += 1
    for at in range(start, end, CHUNK):
        data = np.frombuffer(file.read_at(min(CHUNK, end - at), at), np.uint8)
        slash = data == 0x5C
        # backslashes up to each place: the distance to the last other byte
        other = np.where(slash, -1, np.arange(len(data)))
        last = np.maximum.accumulate(other)
        before = np.concatenate(([run], np.where(last < 0, np.arange(len(data)) + 1 + run, np.arange(len(data)) - last)))
        yield at + np.flatnonzero((data == 0x22) & (before[:-1] % 2 == 0))
        run = int(before[-1])


def _entries(file: pa.NativeFile, size: int, start: int, end: int, inside: bool) -> Iterator[tuple[str, list[int]]]:
    """Headers and bins of the entries that begin in [start, end)."""
    begin, opens = None, not inside
    for places in _quotes(file, start, size):
        for place in places.tolist():
            if opens:
                if begin is not None and (place >= end or place - begin >= CHUNK):
                    yield from _parsed(file, begin, place)
                    begin = None
                if place >= end:
                    return
                begin = place if begin is None else begin
            opens = not opens
    if begin is not None:
        yield from _parsed(file, begin, size)


def _parsed(file: pa.NativeFile, begin: int, end: int) -> list[tuple[str, list[int]]]:
    text = file.read_at(end - begin, begin).decode().rstrip()
    return json.loads("{" + text.rstrip(",}").rstrip() + "}", object_pairs_hook=list)


def read_raw_votes(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Header and bin of every raw vote, from files of one JSON object of lists each, or of a line of {header, bins} each.

    A header that stands twice has the votes of both places.
    """
    files = _files(path)
    out = spark.createDataFrame([], "header string, bins array<int>")
    lines = [name for name, _, is_lines in files if is_lines]
    uri = path.split("://")[0] + "://" if "://" in path else ""
    if lines:
        out = out.unionByName(spark.read.schema("header string, bins array<int>").json([uri + name for name in lines]).where("header IS NOT NULL"))
    splits = [(name, size, a, min(size, a + split)) for name, size, is_lines in files if not is_lines for a in range(0, size, split)]
    if splits:
        out = out.unionByName(_objects(spark, path, splits))
    return out.select("header", F.explode("bins").alias("bin"))


def _objects(spark: SparkSession, path: str, splits: list[tuple[str, int, int, int]]) -> DataFrame:
    """header and bins of the entries of splits (file, its size, start, end), a task a split."""
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartitionByRange(len(rows), "name", "start")

    def parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(path)
        for batch in batches:
            for r in batch.to_pylist():
                with where.open_input_file(r["name"]) as file:
                    n = sum(map(len, _quotes(file, r["start"], r["stop"])))
                yield pa.RecordBatch.from_pylist([{"name": r["name"], "start": r["start"], "odd": bool(n % 2)}])

    schema = "name string, size long, start long, stop long"
    odd = {(r["name"], r["start"]): r["odd"] for r in dealt(splits, schema).mapInArrow(parity, "name string, start long, odd boolean").collect()}  # a bit a split
    known, inside, last = [], False, None
    for name, size, start, stop in splits:
        inside = False if name != last else inside
        known.append((name, size, start, stop, inside))
        inside, last = inside != odd[name, start], name

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(path)
        kind = pa.schema([("header", pa.string()), ("bins", pa.list_(pa.int32()))])
        for batch in batches:
            for r in batch.to_pylist():
                with where.open_input_file(r["name"]) as file:
                    rows = []
                    for header, bins in _entries(file, r["size"], r["start"], r["stop"], r["inside"]):
                        rows.append((header, bins))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return dealt(known, schema + ", inside boolean").mapInArrow(read, "header string, bins array<int>")
