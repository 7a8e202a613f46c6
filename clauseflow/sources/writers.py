"""Sinks: CSV with nested columns as JSON text, append-only JSON lines."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_nested_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV in the given column order; nested columns are serialised as JSON text."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cols = [
        F.to_json(c).alias(c) if isinstance(kinds[c], NESTED) else F.col(c)
        for c in (columns or df.columns)
    ]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: Folders over the folders of single files: more than Spark lists in one task.
SHARDS = 256


def write_files(df: DataFrame, path: str, folder: str | None = None) -> None:
    """One text file per row of ``value``; ``folder`` gives each of its values a folder of its own.

    On a mounted path the tasks write the files themselves: Hadoop's local file system starts a
    process for each file and folder, to set its mode.  Folders are dealt into shards, so that a
    later scan lists shards side by side.  Elsewhere Spark writes, and tasks move their files.
    """
    if not re.match(r"(file:)?/", path):
        w = df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        (w.partitionBy(folder) if folder else w).text(path)
        return
    root = re.sub(r"^file:(//)?", "", path)
    os.makedirs(root)
    name = F.col(folder).cast("string") if folder else F.lit(None).cast("string")
    rows = df.select(name.alias("name"), "value")
    if folder:
        rows = rows.sortWithinPartitions("name")
    rows.mapInArrow(lambda batches: _place(batches, root, folder), "n long").agg(F.sum("n")).collect()


def _place(batches: Iterator[pa.RecordBatch], root: str, folder: str | None) -> Iterator[pa.RecordBatch]:
    """Write the files of a task's rows.

    A name is the task's number and the row's place in it (in its folder, where there is one), and a
    file appears whole, under its name: another attempt puts the same files into the same places.
    """
    task, last, place, n = TaskContext.get(), None, 0, 0
    part, home = task.partitionId(), root
    for batch in batches:
        for name, value in zip(*batch.columns):
            name = name.as_py()
            if folder and (not n or name != last):
                key = "__HIVE_DEFAULT_PARTITION__" if name is None else quote(name, safe="")
                home = f"{root}/{zlib.crc32(key.encode()) % SHARDS:03d}/{folder}={key}"
                os.makedirs(home, exist_ok=True)
                last, place = name, 0
            made = f"{home}/.{part:05d}-{place:06d}.{task.taskAttemptId()}"
            with open(made, "wb") as f:
                f.write((value.as_py() or "").encode() + b"\n")
            os.replace(made, f"{home}/part-{part:05d}-{place:06d}.txt")
            place, n = place + 1, n + 1
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
