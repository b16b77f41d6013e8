"""Stages that are committed as a whole.

A stage's table goes to a folder of its own; a manifest, written last and under its final name in one step,
says which folder holds it, what settings and inputs made it, and how many rows it has. A folder without a
manifest is what a stopped run left behind: it is never read, and goes when the stage is made anew. A stage whose
settings, or inputs, by their own manifests back to the fingerprint of the alignment, are other than those of
the manifest is an error, or is made again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stage(NamedTuple):
    """A finished table and what tells it from one that was made otherwise."""

    df: DataFrame
    id: str


class StaleStage(ValueError):
    """A stored stage was made with other settings or from other inputs."""


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """What a table holds, whatever the order of its rows and partitions: its columns, rows, and sums of two hashes of each row."""
    columns = sorted(df.columns)
    row = [F.col(f"`{c}`") for c in columns]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), total(1), total(2)).first()
    return digest([columns, n, str(a), str(b)])


class Folder:
    """Files under a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is no such file. Other faults are errors."""
        if not self._fs.exists(self._at(f"{self.path}/{name}")):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect())  # a manifest

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; one of that name goes first."""
        part, final = self._at(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._at(f"{self.path}/{name}")
        out = self._fs.create(part, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        self._fs.delete(final, False)
        if not self._fs.rename(part, final):
            raise OSError(f"{final.toString()} can't be written")

    def names(self) -> list[str]:
        here = self._at(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(here)] if self._fs.exists(here) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)


class Stages:
    """The stages of a run under one path. stale: 'raise', or 'rerun' to make a stage again that was made otherwise."""

    def __init__(self, spark: SparkSession, path: str, stale: str = "raise"):
        if stale not in ("raise", "rerun"):
            raise ValueError(f"stale is raise or rerun, not {stale}")
        self.spark, self.path, self.stale = spark, path, stale

    def once(self, name: str, make: Callable[[], DataFrame], settings: object = None, inputs: tuple[str, ...] = (), strict: bool = False) -> Stage:
        """The stage called name, as it was committed, or made and committed now. strict: no rows are an error, and nothing is committed."""
        settings = asdict(settings) if is_dataclass(settings) else settings
        want = {"stage": name, "settings": json.loads(json.dumps(settings, default=str)), "inputs": list(inputs)}
        folder = Folder(self.spark, f"{self.path}/{name}")
        found = folder.read("manifest.json")
        if found is not None:
            have = json.loads(found)
            if all(have[k] == v for k, v in want.items()):
                return Stage(self.spark.read.schema(have["schema"]).parquet(f"{folder.path}/{have['data']}"), have["id"])
            other = [k for k, v in want.items() if have[k] != v]
            if self.stale == "raise":
                raise StaleStage(f"{folder.path} was made with other {' and '.join(other)}")
        data = f"data-{uuid.uuid4().hex}"
        make().write.parquet(f"{folder.path}/{data}")
        df = self.spark.read.parquet(f"{folder.path}/{data}")
        rows = df.count()
        if strict and not rows:
            folder.delete(data)
            raise ValueError(f"stage {name}: no rows")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        folder.write("manifest.json", json.dumps(want | {"id": digest([want, data]), "data": data, "rows": rows, "schema": schema}, indent=1))
        for old in folder.names():
            if old.startswith("data-") and old != data:
                folder.delete(old)
        return Stage(self.spark.read.schema(schema).parquet(f"{folder.path}/{data}"), digest([want, data]))
