"""Line dedup: a line found in several documents stays in one of them.

Two Bloom filters, keys seen once and keys seen twice, are built over the hashes of all lines.
Only lines in the second filter leave their task: their 128-bit digests are counted exactly and
the first document that holds each is chosen. Lines that occur in one document never move.

Nulls and odd input: a null text counts as one empty line; a null document id takes no part in
the comparison and keeps its lines; rows with the same id count as one document; an empty table
gives an empty result; extra columns stay unless the caller drops them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from clauseflow.llm import twofilters
from clauseflow.llm.words import column, each_value
from clauseflow.session import cut_lineage

#: Bits of each filter for a line, and places a line sets.
BITS_EACH, K = 12, 2
MIN_CHARS = 10


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased; bytes work because both are ASCII."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points."""
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def keys(text: bytes | None, least: int) -> set[bytes]:
    """Distinct keys of a text that are long enough to count."""
    found = set(map(line_key, (text or b"").split(b"\n")))
    return {k for k in found if long_enough(k, least)}


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _hashes(found) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in found), np.uint64, len(found))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """All rows with their columns and kept_text string, n_lines long, n_dropped long.

    Keys of at least ``min_chars`` code points that occur in two or more documents lose all
    their lines but those in the smallest document id that holds them.
    """
    narrow = docs.select(
        column(docs, id_col).alias("doc"), column(docs, text_col).cast("binary").alias("body")
    ).where("doc is not null")
    bare = F.replace(F.col("body").cast("string"), F.lit("\n"), F.lit(""))
    newlines = F.octet_length("body") - F.octet_length(bare)
    lines = narrow.agg(F.sum(F.lit(1) + F.coalesce(newlines, F.lit(0)))).first()[0] or 0

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in each_value(batch.column("body")):
            yield _hashes(keys(text, min_chars))

    bits = twofilters.bits_for(lines, BITS_EACH)
    (twice,) = twofilters.build(narrow.select("body"), hashes_of, bits, K, ("twice",))

    id_type = narrow.schema["doc"].dataType

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(each_value(batch.column("body"))):
                own = list(keys(text, min_chars))
                for hit in np.flatnonzero(twice.hits(_hashes(own))):
                    owner.append(i)
                    found.append(digest(own[hit]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(owner, pa.int64())), pa.array(found, pa.binary())],
                names=["doc", "digest"],
            )

    marked = cut_lineage(narrow.mapInArrow(suspects, f"doc {id_type.simpleString()}, digest binary"))
    twice.release()
    # Stored, so that the join below has an exchange on both sides and Spark can split a line
    # that a large part of the documents share.
    repeated = cut_lineage(
        marked.groupBy("digest")
        .agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"))
        .where("keeper <> last")
        .select("digest", "keeper")
    )
    lost = (
        marked.join(repeated, "digest")
        .where("doc <> keeper")
        .groupBy("doc")
        .agg(F.collect_set("digest").alias("lost"))
    )

    whole = docs.select(
        F.struct(*[column(docs, c) for c in docs.columns]).alias("row"),
        column(docs, id_col).alias("doc"),
    )
    joined = whole.join(lost, "doc", "left").select(
        "row",
        F.col("row")[text_col].cast("binary").alias("body"),
        F.coalesce("lost", F.array().cast("array<binary>")).alias("lost"),
    )

    @F.pandas_udf("kept binary, n_lines long, n_dropped long")
    def strip_lost(body, lost):
        import pandas as pd

        out = []
        for text, gone in zip(body, lost):
            parts = (text or b"").split(b"\n")
            if len(gone):
                dropped = set(map(bytes, gone))
                kept = []
                for p in parts:
                    k = line_key(p)
                    if not (long_enough(k, min_chars) and digest(k) in dropped):
                        kept.append(p)
            else:
                kept = parts
            out.append((b"\n".join(kept), len(parts), len(parts) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

    done = joined.select("row", strip_lost("body", "lost").alias("r"))
    taken = {"kept_text", "n_lines", "n_dropped"}
    return done.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in taken],
        F.col("r.kept").cast("string").alias("kept_text"),
        F.col("r.n_lines").alias("n_lines"),
        F.col("r.n_dropped").alias("n_dropped"),
    )

