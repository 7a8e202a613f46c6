"""I-Match fingerprints over randomised lexicons.

Document frequencies of all terms come from all documents, counted for each term. A lexicon keeps
the terms within a band of normalised inverse document frequency; it is sent to the tasks as a
Bloom filter of these terms with the list of all other terms of the documents that the filter
lets pass, so every term of a document is told exactly (a word that only an edit makes, by cutting
one in two, is in no document and may pass by chance).
``LEXICONS`` random orders of it give nested sub-lexicons, each half of the one before, chosen
without regard to any text. For each of them all distinct terms that it keeps of a text are hashed
together (sub-lexicons of one order that keep the same terms have one hash). The coarse ones tell
texts apart that differ in any term; the fine ones are spared by an edit that does not touch their
few terms. A fingerprint has about as many hashes for each order as its text's terms can be
halved. The likeness of two fingerprints is the Jaccard similarity of their hashes.

Nulls and odd input: a null text counts as empty and has an empty fingerprint; a text whose
terms all lie outside the band is hashed over all its terms, one without terms over its bytes;
two empty fingerprints are alike (1), an empty and another are not (0); equal texts have equal
fingerprints; rows with one id are ordered by text, null ids come first, and the row after the
last is the first, so a single row is its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from clauseflow.llm import twofilters
from clauseflow.llm.words import ALNUM, LOWER, U, Words, chunks, column, mix
from clauseflow.session import cut_lineage

LEXICONS = 32
#: Band of ln(N / df) / ln(N), and the least document frequency.
BAND = (0.25, 1.0)
MIN_DF = 2
#: Bits of the lexicon's filter for a term, and places a term sets.
BITS_EACH, K = 32, 4
#: Ranks of a text's terms sorted at once: as many orders as fit, at least one.
RANKS = 1 << 18
#: Most terms counted in a task before they are written out.
GATHER = 1 << 20
SEEDS = mix(np.arange(1, LEXICONS + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def term_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    words = Words(texts, ALNUM)
    hashes = words.hashes(LOWER)
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        yield np.unique(hashes[a:b])


@dataclass
class Lexicon:
    """Terms whose document frequency lies in the band."""

    maybe: twofilters.Filter
    #: sorted terms of the documents that the filter lets pass but the band does not
    wrong: Broadcast

    @classmethod
    def of(cls, counts: DataFrame, documents: int, band=BAND, min_df: int = MIN_DF) -> Lexicon:
        """``counts`` has each term once, with its document frequency df."""
        most = float(np.log(max(documents, 2)))
        idf = (F.lit(most) - F.ln("df")) / F.lit(most)
        within = (idf >= band[0]) & (idf <= band[1]) & (F.col("df") >= min_df)
        kept = counts.where(within).select("term")

        def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield batch.column("term").to_numpy(zero_copy_only=False).view(U)

        bits = twofilters.bits_for(kept.count(), BITS_EACH)
        (maybe,) = twofilters.build(kept, keys_of, bits, K, ("once",))

        @F.arrow_udf("boolean")
        def passes(terms: pa.Array) -> pa.Array:
            return pa.array(maybe.hits(terms.to_numpy(zero_copy_only=False).view(U)))

        found = counts.where(~within).where(passes("term")).select("term").toArrow()
        wrong = np.sort(found["term"].to_numpy().view(U))
        return cls(maybe, counts.sparkSession.sparkContext.broadcast(wrong))

    def holds(self, terms: np.ndarray) -> np.ndarray:
        """True for the terms of the lexicon."""
        hit = self.maybe.hits(terms)
        wrong = self.wrong.value
        if len(wrong):
            at = np.minimum(np.searchsorted(wrong, terms), len(wrong) - 1)
            hit &= wrong[at] != terms
        return hit

    def entries(self, terms: np.ndarray, text: bytes) -> np.ndarray:
        """Sorted 32-bit hashes, each over the terms of one sub-lexicon."""
        if not len(terms):
            return np.array([xxhash.xxh32_intdigest(text)] if text else [], np.uint32)
        chosen = terms[self.holds(terms)]
        if not len(chosen):
            chosen = terms
        step = max(1, RANKS // len(chosen))
        parts = [_sub_lexicons(chosen, SEEDS[k : k + step]) for k in range(0, LEXICONS, step)]
        return np.unique(np.concatenate(parts))


def _sub_lexicons(terms: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """32-bit hashes of what each sub-lexicon of these orders keeps of the terms."""
    ranks = mix(terms[None, :] ^ seeds[:, None])
    ranks.sort(axis=1)
    # sub-lexicon: ranks below a power of two; it ends where the power changes
    level = np.frexp(ranks.astype(np.float64))[1]
    ends = np.ones(ranks.shape, bool)
    ends[:, :-1] = level[:, 1:] > level[:, :-1]
    folded = np.cumsum(mix(ranks), axis=1, dtype=U)
    of = np.broadcast_to(seeds[:, None], ranks.shape)[ends]
    return (mix(folded[ends] ^ of) >> U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(entries: np.ndarray) -> str:
    return entries.astype(">u4").tobytes().hex()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents of this task that hold it), terms summed up to ``GATHER`` at a time."""
    terms, counts = np.empty(0, U), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([terms, *waiting])
        found, at = np.unique(keys, return_inverse=True)
        weights = np.concatenate([counts, np.ones(len(keys) - len(terms), np.int64)])
        return found, np.bincount(at, weights, len(found)).astype(np.int64)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(terms.view(np.int64)), pa.array(counts)], names=["term", "df"]
        )

    for batch in batches:
        for _, group in chunks(batch.column("body").to_pylist()):
            for found in term_sets(group):
                waiting.append(found)
                size += len(found)
            if size >= GATHER:
                terms, counts = fold()
                waiting, size = [], 0
                if len(terms) >= GATHER:
                    yield rows()
                    terms, counts = np.empty(0, U), np.empty(0, np.int64)
    if size:
        terms, counts = fold()
    if len(terms):
        yield rows()


def learn_lexicon(
    docs: DataFrame, text_col: str = "text", band=BAND, min_df: int = MIN_DF
) -> Lexicon:
    """The lexicon of all documents: each counts once for each of its terms."""
    rows = docs.select(column(docs, text_col).cast("binary").alias("body"))
    counts = cut_lineage(
        rows.mapInArrow(_count_terms, "term bigint, df bigint")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    return Lexicon.of(counts, rows.count(), band, min_df)


def fingerprints(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """All rows with fingerprint string (hexadecimal, 8 digits for each hash)."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for _, group in chunks(texts.to_pylist()):
            out += [as_text(lexicon.entries(s, t)) for s, t in zip(term_sets(group), group)]
        return pa.array(out, pa.string())

    return docs.withColumn("fingerprint", run(column(docs, text_col).cast("binary")))


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first characters of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compare_with_edits(
    docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Rows are dealt into ranges of ids and sorted there; the first id of each range also goes to
    the end of the range before it (that of the first range to the last one), so every row
    meets its successor without any text passing through one task or the driver.
    """
    spark = docs.sparkSession
    kind = docs.select(column(docs, id_col)).schema[0].dataType.simpleString()
    rows = docs.select(
        column(docs, id_col).alias("id"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    ranged = rows.select("id").repartitionByRange(parts, "id").sortWithinPartitions("id")
    # one id for each partition
    firsts = [r.id for r in ranged.mapInArrow(first_of, f"id {kind}").collect()]
    bounds = sorted({f for f in firsts if f is not None})
    lowest_null = any(f is None for f in firsts)
    cuts = bounds if lowest_null else bounds[1:]
    last = len(cuts)
    lowest = None if lowest_null else (bounds[0] if bounds else None)

    @F.arrow_udf("array<struct<range:int,ahead:boolean>>")
    def deal(ids: pa.Array) -> pa.Array:
        out = []
        for v in ids.to_pylist():
            at = 0 if v is None else bisect_right(cuts, v)
            places = [{"range": at, "ahead": False}]
            if at and v == cuts[at - 1]:
                places.append({"range": at - 1, "ahead": True})
            if v == lowest:
                places.append({"range": last, "ahead": True})
            out.append(places)
        item = pa.struct([("range", pa.int32()), ("ahead", pa.bool_())])
        return pa.array(out, pa.list_(item))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (range, id scalar, text, entries)

        for batch in batches:
            ids: list[pa.Array] = []
            out: list[list] = [[], [], [], [], [], []]
            ranges = batch.column("range").to_pylist()
            ahead = batch.column("ahead").to_pylist()
            bodies = batch.column("body").to_pylist()
            for start, group in chunks(bodies):
                own = [lexicon.entries(s, t) for s, t in zip(term_sets(group), group)]
                pairs, edits = [], []
                for k, text in enumerate(group):
                    i = start + k
                    this = (ranges[i], batch.column("id").slice(i, 1), text.decode("utf-8", "replace"), own[k])
                    if waiting is not None and waiting[0] == this[0]:
                        pairs.append((waiting, this))
                        edits.append(edit(waiting[2], this[2]))
                    waiting = None if ahead[i] else this
                raw = [e.encode() for e in edits]
                marks = [lexicon.entries(s, t) for s, t in zip(term_sets(raw), raw)] if raw else []
                for (row, following), data, mark in zip(pairs, raw, marks):
                    ids.append(row[1])
                    out[0].append(len(row[2]))
                    out[1].append(hashlib.sha256(data).hexdigest())
                    out[2].append(as_text(row[3]))
                    out[3].append(as_text(mark))
                    out[4].append(likeness(row[3], mark))
                    out[5].append(likeness(row[3], following[3]))
            if ids:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays(ids), *(pa.array(o, t) for o, t in zip(out, kinds))],
                    names=[
                        "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next",
                    ],
                )

    dealt = rows.select("id", "body", F.explode(deal("id")).alias("p")).select(
        F.col("p.range").alias("range"), F.col("p.ahead").alias("ahead"), "id", "body"
    )
    return (
        dealt.repartition(parts, "range")
        .sortWithinPartitions("range", "ahead", F.col("id").asc_nulls_first(), "body")
        .mapInArrow(
            pair,
            f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
        .withColumnRenamed("id", id_col)
    )
