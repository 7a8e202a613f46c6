"""Substring dedup by fixed-block anchors.

Blocks of (window + 1) // 2 words at fixed places of every text are the index: any window of
``window`` words holds one whole block of the text it stands in. A repeated window therefore
meets, in each of its occurrences, a block of the other one; so rolling blocks of every text
are probed against the index (two Bloom filters over the blocks: met once, met twice), and the
windows around the hits are the only ones that can repeat. These are counted exactly by 96-bit
hashes of their words. Adjoining repeated windows unite to maximal exact repeats, and the words
under them go.

Windows that occur again among the windows gathered in one task are settled there, and their key
leaves the task once: the group of a key grows with the number of tasks, not of its occurrences.

Nulls and odd input: a null text has no words; a text shorter than the window loses nothing;
rows are told apart by id and text, so equal ids and null ids are allowed, and an equal row is
a repeat like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clauseflow.llm import twofilters
from clauseflow.llm.words import SPACED, U, Words, chunks, column, mix, windows

WINDOW = 35
#: Bits of a filter for a block, and places it sets.
BITS_EACH, K = 32, 3
#: Windows gathered in a task before they are compared and written out.
FLUSH = 1 << 20


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Hashes of the blocks of each text: places 0, size, 2 * size, ..."""
    for _, group in chunks(batch.column("body")):
        words = Words(group, SPACED)
        rolling = windows(words.hashes(), size)
        picks = [
            np.arange(a, b - size + 1, size) for a, b in zip(words.first, words.first[1:]) if b - a >= size
        ]
        if picks:
            yield rolling[np.concatenate(picks)]


def _candidates(words: Words, hashes: np.ndarray, once, twice, window: int):
    """(text, place in the text, h, g) of the windows that hold an anchor, as arrays."""
    size = (window + 1) // 2
    rolling = windows(hashes, size)
    first = words.first
    lengths = np.diff(first)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: len(rolling)]
    place = np.arange(len(rolling)) - first[owner]
    inside = place + size <= lengths[owner]
    own = inside & (place % size == 0)
    anchor = np.zeros(len(rolling), bool)
    at = np.flatnonzero(inside & ~own)
    anchor[at] = once.hits(rolling[at])
    at = np.flatnonzero(own)
    anchor[at] = twice.hits(rolling[at])
    # windows that start up to window - size words before an anchor hold it
    reach = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(anchor)
    np.add.at(reach, np.maximum(at - (window - size), first[owner[at]]), 1)
    np.add.at(reach, at + 1, -1)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(hashes)) - first[owner]
    at = np.flatnonzero((np.cumsum(reach[:-1]) > 0) & (place + window <= lengths[owner]))
    if not len(at):
        return owner[at], place[at], np.empty(0, U), np.empty(0, np.uint32)
    h = windows(hashes, window)[at]
    g = (windows(mix(hashes ^ U(0x6A09E667F3BCC909)), window)[at] >> U(32)).astype(np.uint32)
    return owner[at], place[at], h, g


def _settle(row: np.ndarray, place: np.ndarray, h: np.ndarray, g: np.ndarray):
    """Keys that occur twice here: their occurrences as ranges, and each key once.

    Returns (row, place, length, h, g, weight). A range has a key of its own and weight 2; a
    key that is settled here has weight 2 and length 0; any other occurrence has weight 1.
    """
    order = np.lexsort((g, h))
    h, g, row, place = h[order], g[order], row[order], place[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    last = np.append(new[1:], True)
    alone = new & last
    again = ~alone
    heads = again & new
    r, p = row[again], place[again]
    by = np.lexsort((p, r))
    r, p = r[by], p[by]
    cut = np.ones(len(r), bool)
    cut[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(r)))
    r, p = r[begin], p[begin]
    own = mix(mix(r.astype(U) + U(1)) + p.astype(U) + (h[0] if len(h) else U(0)))
    n, k, s = len(r), int(heads.sum()), int(alone.sum())
    out = (
        np.concatenate([r, row[heads], row[alone]]),
        np.concatenate([p, place[heads], place[alone]]),
        np.concatenate([length, np.zeros(k, np.int64), np.ones(s, np.int64)]),
        np.concatenate([own, h[heads], h[alone]]),
        np.concatenate([own.astype(np.uint32), g[heads], g[alone]]),
        np.concatenate([np.full(n + k, 2), np.ones(s)]).astype(np.int32),
    )
    # rows of a text side by side compress far better in the shuffle
    order = np.lexsort((out[1], out[0]))
    return tuple(x[order] for x in out)


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, sig, place, length): stretches of places where a repeated window starts.

    ``rows`` has doc (any type), sig (hash of the text) and body (binary).
    """
    size = (window + 1) // 2
    text = F.col("body").cast("string")
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    guess = rows.agg(F.sum(F.floor(spaces / size) + 1)).first()[0] or 0
    bits = twofilters.bits_for(guess, BITS_EACH)
    once, twice = twofilters.build(rows.select("body"), lambda b: _blocks(b, size), bits, K)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ids: list[pa.Array] = []
        sigs: list[pa.Array] = []
        count = base = 0

        def flush() -> pa.RecordBatch:
            doc, sig = pa.concat_arrays(ids), pa.concat_arrays(sigs)
            row, place, length, h, g, weight = _settle(
                *(np.concatenate([x[i] for x in held]) for i in range(4))
            )
            at = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    doc.take(at),
                    sig.take(at),
                    pa.array(place.astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                    pa.array(h.view(np.int64)),
                    pa.array(g.view(np.int32)),
                    pa.array(weight),
                ],
                names=["doc", "sig", "place", "length", "h", "g", "weight"],
            )

        for batch in batches:
            ids.append(batch.column("doc"))
            sigs.append(batch.column("sig"))
            for start, group in chunks(batch.column("body")):
                words = Words(group, SPACED)
                row, place, h, g = _candidates(words, words.hashes(), once, twice, window)
                if len(row):
                    held.append((row + (base + start), place, h, g))
                    count += len(row)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
            base += batch.num_rows
            if not held:
                ids, sigs, base = [], [], 0
        if held:
            yield flush()

    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.select("doc", "sig", "body").mapInArrow(
        find, f"doc {kind}, sig bigint, place int, length int, h bigint, g int, weight int"
    )
    total = F.sum("weight").over(Window.partitionBy("h", "g"))
    return (
        found.withColumn("total", total)
        .where("total >= 2 and length > 0")
        .select("doc", "sig", "place", "length")
    )


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """All rows with n_words, n_removed long, kept_text string and repeats.

    A word goes when a window of ``window`` words over it starts at another place too, in any
    text. ``repeats`` lists the maximal stretches that went, as word places (end exclusive);
    ``kept_text`` joins the words that stay by one space. Windows are judged on the input.
    """
    added = {"n_words", "n_removed", "kept_text", "repeats"}
    kept = [c for c in docs.columns if c not in added]

    def signed(df: DataFrame) -> list:
        return [column(docs, id_col).alias("doc"), F.xxhash64(column(docs, text_col)).alias("sig")]

    rows = docs.select(*signed(docs), column(docs, text_col).cast("binary").alias("body"))
    # one number for place and length: an array of structs takes several times the room
    packed = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(F.col("length").cast("long"))
    places = (
        repeated_windows(rows, window)
        .groupBy("doc", "sig")
        .agg(F.collect_set(packed).alias("places"))
        .withColumnsRenamed({"doc": "of", "sig": "by"})
    )
    whole = docs.select(F.struct(*[column(docs, c) for c in kept]).alias("row"), *signed(docs))
    joined = whole.join(
        places, F.col("doc").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("by")), "left"
    ).select("row", F.col("row")[text_col].cast("binary").alias("body"), "places")

    @F.arrow_udf(
        "struct<n_words:bigint,n_removed:bigint,kept:binary,repeats:array<struct<start:int,end:int>>>"
    )
    def strip(texts: pa.Array, places: pa.Array) -> pa.Array:
        out: list[list] = [[], [], [], []]
        bounds = places.offsets.to_numpy()
        both = places.values.to_numpy(zero_copy_only=False)
        at, size = both >> 32, both & 0xFFFFFFFF
        valid = places.is_valid().to_numpy(zero_copy_only=False)
        for i, text in enumerate(texts.to_pylist()):
            words = (text or b"").split()
            a, b = (bounds[i], bounds[i + 1]) if valid[i] else (0, 0)
            spans = []
            if b > a:
                reach = np.zeros(len(words) + 1, np.int64)
                np.add.at(reach, at[a:b], 1)
                np.add.at(reach, at[a:b] + size[a:b] - 1 + window, -1)
                gone = np.cumsum(reach[:-1]) > 0
                edge = np.flatnonzero(
                    np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))
                )
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[0::2], edge[1::2])]
                left = list(compress(words, (~gone).tolist()))
            else:
                left = words
            out[0].append(len(words))
            out[1].append(len(words) - len(left))
            out[2].append(b" ".join(left))
            out[3].append(spans)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(span)]
        return pa.StructArray.from_arrays(
            [pa.array(o, k) for o, k in zip(out, kinds)],
            names=["n_words", "n_removed", "kept", "repeats"],
        )

    return joined.select("row", strip("body", "places").alias("r")).select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("r.n_words").alias("n_words"),
        F.col("r.n_removed").alias("n_removed"),
        F.col("r.kept").cast("string").alias("kept_text"),
        F.col("r.repeats").alias("repeats"),
    )
