"""A fixed-size table of counts over hashed keys, summed over all rows of a table.

Keys fall into ``1 << BITS`` counters, so the table sent to the tasks stays at a few MB
whatever the input; it over-counts by the share of other keys, evenly for all keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseflow.llm.words import U

BITS = 20
SEGMENT = 14
#: Keys counted at once.
GATHER = 1 << 20
COUNTS = "segment int, width int, counts binary"


def counter(keys: np.ndarray) -> np.ndarray:
    return (keys >> U(64 - BITS)).astype(np.int64)


def _rows(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(-1, 1 << SEGMENT)
    widths, data = [], []
    for p in parts:
        top = int(p.max())
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 8
        widths.append(width)
        data.append(p.astype(f"<u{width}").tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(len(parts), dtype=np.int32)),
            pa.array(widths, pa.int32()),
            pa.array(data, pa.binary()),
        ],
        names=["segment", "width", "counts"],
    )


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, current = np.zeros(1 << SEGMENT, np.int64), None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([current], pa.int32()),
                pa.array([8], pa.int32()),
                pa.array([total.astype("<u8").tobytes()], pa.binary()),
            ],
            names=["segment", "width", "counts"],
        )

    for batch in batches:
        for seg, width, data in zip(*(c.to_pylist() for c in batch.columns)):
            if seg != current:
                if current is not None:
                    yield done()
                current, total = seg, np.zeros(1 << SEGMENT, np.int64)
            total += np.frombuffer(data, f"<u{width}").astype(np.int64)
    if current is not None:
        yield done()


def count_keys(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The counters over all keys that ``keys_of`` finds in the rows."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for keys in keys_of(batch):
                waiting.append(keys)
                size += len(keys)
                if size >= GATHER:
                    total += np.bincount(counter(np.concatenate(waiting)), minlength=1 << BITS)
                    waiting, size = [], 0
        if size:
            total += np.bincount(counter(np.concatenate(waiting)), minlength=1 << BITS)
        yield _rows(total)

    merged = (
        df.mapInArrow(write, COUNTS)
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(_sum, COUNTS)
    )
    out = np.zeros((1 << (BITS - SEGMENT), 1 << SEGMENT), np.int64)
    for row in merged.collect():
        out[row.segment] = np.frombuffer(row.counts, "<u8").astype(np.int64)
    return out.ravel()
