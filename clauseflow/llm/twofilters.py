"""Two Bloom filters of one size: keys seen at least once, keys seen at least twice.

Every task writes the places its keys set, cut into segments of 2^16 bits; a place set again,
in the same task or when segments of different tasks meet, moves into the second filter. The
second filter therefore holds every key that occurs twice, with some false positives and no
false negatives. Nothing but set places crosses the shuffle, each segment is merged in a
stream, and the merged size is bounded by ``MAX_BITS`` whatever the input. A filter that is too
small for its input only passes more keys on to the exact step behind it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clauseflow.llm.words import U, mix
from clauseflow.session import shared_dir

SEGMENT = 16
#: 32 MB for each filter at most.
MAX_BITS = 1 << 28
#: Places gathered in a task before they are written out.
FLUSH = 1 << 20

PLACES = "segment int, once binary, twice binary"


def bits_for(keys: int, each: int, most: int = MAX_BITS) -> int:
    """Power of two of about ``each`` bits a key, from 2^SEGMENT to ``most``."""
    bits = 1 << SEGMENT
    while bits < min(keys * each, most):
        bits *= 2
    return bits


def places(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    """(k, len(keys)) places of the keys."""
    m = U(bits - 1)
    rows = [keys & m, (keys >> U(32)) & m, mix(keys + U(1)) & m, (mix(keys + U(1)) >> U(32)) & m]
    return np.stack(rows[:k])


def segments(found: np.ndarray) -> pa.RecordBatch:
    """Set places as rows (segment, places once, places twice)."""
    at, counts = np.unique(found, return_counts=True)
    seg = (at >> U(SEGMENT)).astype(np.int64)
    low = (at & U((1 << SEGMENT) - 1)).astype("<u2")
    cut = np.flatnonzero(np.diff(seg, prepend=-1))
    ends = np.append(cut[1:], len(at))
    again = counts > 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array(seg[cut].astype(np.int32)),
            pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([low[a:b][again[a:b]].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        ],
        names=["segment", "once", "twice"],
    )


def _write(keys: Iterator[np.ndarray], bits: int, k: int) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []
    size = 0
    for part in keys:
        if len(part):
            waiting.append(places(part, bits, k).ravel())
            size += len(waiting[-1])
        if size >= FLUSH:
            yield segments(np.concatenate(waiting))
            waiting, size = [], 0
    if size:
        yield segments(np.concatenate(waiting))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = np.zeros(1 << SEGMENT, bool)
    twice = np.zeros(1 << SEGMENT, bool)
    current = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([current], pa.int32()),
                pa.array([np.packbits(once).tobytes()], pa.binary()),
                pa.array([np.packbits(twice).tobytes()], pa.binary()),
            ],
            names=["segment", "once", "twice"],
        )

    for batch in batches:
        for seg, one, two in zip(*(c.to_pylist() for c in batch.columns)):
            if seg != current:
                if current is not None:
                    yield done()
                current = seg
                once[:] = False
                twice[:] = False
            at = np.frombuffer(one, "<u2")
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(two, "<u2")] = True
    if current is not None:
        yield done()


#: The files that a task's process has mapped.
_maps: dict[str, np.memmap] = {}


def mapped(path: str) -> np.memmap:
    if path not in _maps:
        if len(_maps) >= 8:
            _maps.clear()
        _maps[path] = np.memmap(path, np.uint8, "r")
    return _maps[path]


class Filter:
    """A merged filter as the tasks see it.

    Where the shared folder is a folder of the file system, the bits are a file there that each
    machine's tasks map into memory together; in another store they are broadcast.
    """

    def __init__(self, spark: SparkSession, data: np.ndarray, bits: int, k: int):
        self.bits, self.k, self.shared, self.path = bits, k, None, None
        folder = re.sub("^file:(//)?", "", shared_dir(spark))
        if os.path.isdir(folder):
            self.path = f"{folder}/filter-{uuid.uuid4().hex}"
            data.tofile(self.path + ".part")
            os.rename(self.path + ".part", self.path)
        else:
            self.shared = spark.sparkContext.broadcast(data)

    def release(self) -> None:
        """Frees the filter once everything that used it is stored."""
        if self.path:
            os.remove(self.path)
        else:
            self.shared.unpersist()

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """True where a key may be in the filter (never false for a key that is)."""
        data = mapped(self.path) if self.path else self.shared.value
        out = np.ones(len(keys), bool)
        for at in places(keys, self.bits, self.k):
            out &= (data[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & np.uint8(1) > 0
        return out


def build(
    df: DataFrame,
    keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    bits: int,
    k: int,
    which: tuple[str, ...] = ("once", "twice"),
) -> list[Filter]:
    """The filters of all keys that ``keys_of`` finds in the rows.

    Each is bits / 8 bytes, ``MAX_BITS`` / 8 at most: that is what the driver and each machine hold.
    """
    spark: SparkSession = df.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write((part for b in batches for part in keys_of(b)), bits, k)

    merged = (
        df.mapInArrow(write, PLACES)
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_merge, PLACES)
        .select("segment", *which)
    )
    whole = {w: np.zeros(bits // 8, np.uint8) for w in which}
    size = (1 << SEGMENT) // 8
    table = merged.toArrow()
    at = table.column("segment").to_pylist()
    for w in which:
        for seg, data in zip(at, table.column(w)):
            whole[w][seg * size : (seg + 1) * size] = np.frombuffer(data.as_buffer(), np.uint8)
    del table
    return [Filter(spark, whole.pop(w), bits, k) for w in which]
