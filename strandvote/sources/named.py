"""A writer of single files of given names (K1, K6), as programs outside Spark read them.

Spark's own writers make folders of part files. Here every row is a line, or several, of the file that it
names. Tasks write to a folder of the attempt; only when all tasks of the job are done are their files moved to
their names, and a job that fails leaves none. Rows are dealt by ranges of file and order, so a long file is written in
pieces by several tasks, and one task then copies its pieces behind one another.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import storage

PENDING = "_pending"
#: Bytes that are copied at a time.
CHUNK = 1 << 23


def file_system(path: str) -> tuple[Any, str]:
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are, and their names."""

    files: list[tuple[str, str]]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _pending(self, root: str) -> str:
        return f"{root}/{PENDING}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (file, value), those of a file one after the other; a value is the path of a piece."""
        where, root = file_system(self.path)
        folder = f"{self._pending(root)}/{uuid.uuid4().hex}"
        where.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        name, out = None, None
        try:
            for batch in iterator:
                rows = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)
                for file, lines in groupby(rows, lambda r: r[0]):
                    if file != name:
                        if out is not None:
                            out.close()
                        name = file
                        files.append((f"{folder}/{len(files)}", name))
                        out = where.open_output_stream(files[-1][0])
                    for _, piece in lines:
                        with where.open_input_stream(piece) as source:
                            while chunk := source.read(CHUNK):
                                out.write(chunk)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = file_system(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("a file was written by several tasks")
        for folder in sorted({f"{root}/{name}".rsplit("/", 1)[0] for _, name in files}):
            where.create_dir(folder, recursive=True)
        for at, name in files:
            where.move(at, f"{root}/{name}")
        where.delete_dir(self._pending(root))

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        where, root = file_system(self.path)
        if where.get_file_info(self._pending(root)).type != fs.FileType.NotFound:
            where.delete_dir(self._pending(root))


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options["job"])


def _pieces(path: str, job: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted rows (file, value) as pieces of this task, and yields file, part (the task's number) and value, the path of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(path)
        part, folder = TaskContext.get().partitionId(), f"{root}/{PENDING}-{job}/{uuid.uuid4().hex}"
        name, out, found = None, None, 0
        for batch in batches:
            done = []
            rows = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True)
            for file, lines in groupby(rows, lambda r: r[0]):
                if file != name:
                    if out is None:
                        where.create_dir(folder, recursive=True)
                    else:
                        out.close()
                    name, found = file, found + 1
                    done.append((name, part, f"{folder}/{found}"))
                    out = where.open_output_stream(done[-1][2])
                out.write("".join(value + "\n" for _, value in lines).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "part", "value"])
        if out is not None:
            out.close()

    return write


def write_named(rows: DataFrame, path: str, order: list[str], partitions: int | None = None) -> None:
    """Write rows (file, value and columns to order by) as single files under path; a file of that name is replaced."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    rows, job = storage.stored(rows.select("file", "value", *order), "named"), uuid.uuid4().hex  # read for the ranges, and for the files
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // storage.DEALT))
    dealt = rows.repartitionByRange(n, "file", *order).sortWithinPartitions("file", *order).select("file", "value")
    try:
        pieces = storage.stored(dealt.mapInArrow(_pieces(path, job), "file string, part long, value string"), "pieces")
        pieces = pieces.repartition("file").sortWithinPartitions("file", "part").select("file", "value")
        pieces.write.format("named_files").option("path", path).option("job", job).mode("append").save()
    except BaseException:
        NamedFilesWriter(path, job).abort([])
        raise


def record(header: str = "header", seq: str = "seq") -> Column:
    """A record of an alignment file."""
    return F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq))


def write_group_files(groups: DataFrame, path: str, keys: list[str], query_seq: str | None = None, query_header: str = "101") -> None:
    """K1: one file a group, <key>_<number>/ for every key but the last and <key>_<number>.a3m for it: the query record first, then members by pos."""
    parts = [F.concat(F.lit(f"{k}_"), F.col(k).cast("string")) for k in keys]
    rows = groups.select(F.concat(F.concat_ws("/", *parts), F.lit(".a3m")).alias("file"), F.col("pos").cast("long").alias("pos"), record().alias("value"))
    if query_seq is not None:
        first = rows.select("file").distinct().select("file", F.lit(None).cast("long").alias("pos"), F.lit(f">{query_header}\n{query_seq}").alias("value"))
        rows = rows.unionByName(first)
    write_named(rows, path, ["pos"])


def write_shuffle_files(ranked: DataFrame, path: str) -> None:
    """K6: shuffle_<number>/shuffle_<number>.shuf, the whole alignment of each shuffle in its order."""
    name = F.concat(F.lit("shuffle_"), F.col("shuffle").cast("string"))
    write_named(ranked.select(F.concat(name, F.lit("/"), name, F.lit(".shuf")).alias("file"), "rank", record().alias("value")), path, ["rank"])
