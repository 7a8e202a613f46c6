"""Phrase collocation mining with Toivonen's sampling method.

A sample of the documents proposes phrases: those whose count in the sample passes a lowered
bound. Together with every word, the proposals and their negative border are counted exactly in
one pass over all documents; the border are the phrases that occur although they were not
proposed themselves, while their first words without the last and their last without the first
were. Where a phrase of the border turns out to be frequent, the border was not wide enough: it
joins the proposals, and one more pass counts what this adds to the border, until no frequent
phrase is left outside the proposals. As parts are at most three words long this takes three
further passes at most. Every frequent phrase has frequent parts, so all of them are counted.

Proposals reach the tasks as a Bloom filter (``FILTER_BITS`` bits, 32 MB, at most): a phrase let
in by mistake widens the border and is counted as well, so results do not depend on the filter.
At ten bits a phrase that is room for 27 million proposals of up to three words; beyond, the
border grows towards all phrases that occur, and with it what is shuffled. Inside a task the
words of a slice of texts get exact numbers, phrases are numbered pair by pair, and one row for
each distinct phrase of a slice goes to the aggregation.

Nulls and odd input: a null text counts as empty, a null language as ``und``; a text without
words adds nothing; repeated rows count as often as they occur; ties are ordered by phrase; an
empty table gives an empty result. Columns other than text and language are not read. Texts are
read whole, whatever their length: a longer text than a slice (1 MB) makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from clauseflow.llm import twofilters
from clauseflow.llm.words import LOWER, U, Words, column, join_two
from clauseflow.session import cut_lineage

#: Bytes of texts handled together, and rows handed on at once.
SLICE, ROWS = 1 << 20, 1 << 15
#: Bits of a filter for each proposed phrase, places each sets, and most bits of a filter.
BITS_EACH, PLACES, FILTER_BITS = 10, 3, 1 << 28
#: Parts that a language's candidates are dealt into before its first ones are taken.
PARTS = 64

WORD = np.ones(256, bool)
WORD[[0x20, 0x09]] = False
SPACE = pa.scalar(b" ", pa.large_binary())
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD &= ~PIECE_END
#: Tables of ``bytes.translate``: the kind of a byte, A-Z to a-z, and what is in no word.
WORD_BYTE, END_BYTE = 1, 2
KIND = np.where(WORD, WORD_BYTE, np.where(PIECE_END, END_BYTE, 0)).astype(np.uint8).tobytes()
FOLD = LOWER.tobytes()
NO_WORD = np.flatnonzero(~WORD).astype(np.uint8).tobytes()


@dataclass(frozen=True)
class Mining:
    """Phrases of up to ``longest`` words that occur ``least`` times or more in their language.

    ``share`` of the documents are the sample; a phrase is proposed from ``ease * share * least``
    occurrences there (two at least). Both steer how many passes are needed, not the result.
    """

    longest: int = 4
    least: int = 30
    share: float = 1 / 16
    ease: float = 0.8

    @property
    def lowered(self) -> int:
        return max(2, int(self.ease * self.share * self.least))


def lang_key(lang: str) -> np.uint64:
    return U(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


class Slice:
    """The words of some texts of one language, numbered exactly."""

    def __init__(self, texts: list[bytes], lang: str):
        joined = b"\n".join([b"", *texts, b""])  # neither end is inside a word
        kind = np.frombuffer(joined.translate(KIND), np.uint8)
        inside = kind == WORD_BYTE
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        gap = np.searchsorted(starts, np.flatnonzero(kind == END_BYTE))
        self.together = np.ones(max(0, len(starts) - 1), bool)
        self.together[gap[(gap > 0) & (gap < len(starts))] - 1] = False
        places = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(joined.translate(FOLD, NO_WORD))]
        ).dictionary_encode()
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary
        self.lang = lang_key(lang)
        self.hashes = Words.of(self.words).hashes()

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at ``at``."""
        taken = [self.words.take(pa.array(self.ids[at + i])) for i in range(k)]
        return taken[0] if k == 1 else pc.binary_join_element_wise(*taken, SPACE)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """Their hashes, made without their texts."""
        key = np.full(len(at), self.lang, U)
        for i in range(k):
            key = join_two(key, self.hashes[self.ids[at + i]])
        return key


def phrase_keys(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes of :class:`Slice` for stored phrases."""
    listed = Words(phrases.cast(pa.binary()).to_pylist(), WORD)
    names = langs.dictionary_encode()
    of_name = np.array([lang_key(x) for x in names.dictionary.to_pylist()], U)
    hashes = listed.hashes()
    lo, size = listed.first[:-1], np.diff(listed.first)
    key = of_name[names.indices.to_numpy(zero_copy_only=False)]
    for i in range(int(size.max(initial=0))):
        more = size > i
        key[more] = join_two(key[more], hashes[lo[more] + i])
    return key


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys in the order of their first places, and how often each occurs."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    numbers = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, np.bincount(numbers)


def _member(filters: list, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for f in filters:
        out |= f.hits(keys)
    return out


def _counted(s: Slice, longest: int, filters: list | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of a slice: all phrases without filters; else those with both parts
    counted and in any filter, without those that all filters but the last one let in already.

    A filter can hold a phrase by mistake that was not counted when it was sent, so whether a
    phrase was counted before is known only together with the same of its parts."""
    n = len(s.ids)
    again = filters is not None and len(filters) > 1
    numbers, distinct = s.ids, len(s.words)
    places = np.empty(distinct, np.int64)
    places[s.ids[::-1]] = np.arange(n - 1, -1, -1)
    counts = np.bincount(s.ids, minlength=distinct)
    alive = np.ones(n, bool)
    counted = np.full(distinct, again)  # before this pass
    for k in range(1, longest + 1):
        if k > 1:
            # a phrase is its first k - 1 words and one more; numbers are places in ``places``
            begin = np.flatnonzero(alive[:-1] & alive[1:] & (s.together if k == 2 else True))
            begin = begin[: np.searchsorted(begin, n - k + 1)]
            if filters is not None:
                now, before = known
                ok = now[numbers[begin]] & now[numbers[begin + 1]]
                begin = begin[ok]
            key = numbers[begin] * (int(s.ids.max()) + 1) + s.ids[begin + k - 1]
            back, counts = numbered(key)
            places = np.empty(len(counts), np.int64)
            places[back[::-1]] = begin[::-1]
            parts = numbers[places], numbers[places + 1]
            counted = counted[parts[0]] & counted[parts[1]]
            if again:
                counted &= before[parts[0]] & before[parts[1]]
            numbers = np.full(n, -1, np.int64)
            numbers[begin] = back
            alive = numbers >= 0
        fresh = ~counted
        if not len(places):
            return
        if k < longest and filters is not None:
            keys = s.keys(places, k)
            known = _member(filters, keys), (_member(filters[:-1], keys) if again else None)
        if fresh.all():
            yield s.texts(places, k), counts
        elif fresh.any():
            yield s.texts(places[fresh], k), counts[fresh]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    langs, bodies = batch.column("lang").dictionary_encode(), batch.column("body")
    of = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        group, size = [], 0
        for at in np.flatnonzero(of == i).tolist():
            body = bodies[at].as_py()
            if group and size + len(body) > SLICE:
                yield lang, group
                group, size = [], 0
            group.append(body)
            size += len(body)
        if group:
            yield lang, group


#: A phrase and its language in one key: a line feed ends pieces, so no phrase holds one.
COUNTS = "key string, f bigint"
LINE = pa.scalar(b"\n", pa.large_binary())


def _count(docs: DataFrame, longest: int, filters: list | None) -> DataFrame:
    """(lang, phrase, f) summed; the number of all words of a language stands with an empty phrase."""

    def rows(lang: str, phrases: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(phrases), ROWS):
            part = phrases.slice(at, ROWS)
            keys = pc.binary_join_element_wise(part, pa.scalar(lang.encode(), pa.large_binary()), LINE)
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.large_string()).cast(pa.string()), pa.array(f[at : at + ROWS].astype(np.int64))],
                names=["key", "f"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _slices(batch):
                s = Slice(texts, lang)
                if not len(s.ids):
                    continue
                if filters is None or len(filters) == 1:
                    yield from rows(lang, pa.array([b""], pa.large_binary()), np.array([len(s.ids)]))
                for phrases, f in _counted(s, longest, filters):
                    yield from rows(lang, phrases, f)
        pa.default_memory_pool().release_unused()

    summed = docs.mapInArrow(count, COUNTS).groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", 1)
    lang = F.substring(F.col("key"), F.char_length(phrase) + 2, F.char_length("key"))
    return summed.select(lang.alias("lang"), phrase.alias("phrase"), "f")


def _filter(proposed: DataFrame, size: int) -> twofilters.Filter:
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield phrase_keys(batch.column("lang"), batch.column("phrase"))

    bits = twofilters.bits_for(size, BITS_EACH, FILTER_BITS)
    return twofilters.build(proposed.select("lang", "phrase"), keys_of, bits, PLACES, ("once",))[0]


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", how: Mining = Mining()
) -> DataFrame:
    """(lang, words, phrase, f): all phrases with f >= least, and a row of 0 words and an empty
    phrase with the number of all word occurrences of each language."""
    body = docs.select(
        F.coalesce(column(docs, lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    part = F.col("words").between(1, how.longest - 1)
    sample = body.where(F.rand(11) < how.share)
    proposed = cut_lineage(
        _count(sample, how.longest - 1, None)
        .where((F.col("f") >= how.lowered) & (F.col("phrase") != ""))
        .select("lang", "phrase")
    )
    filters: list[twofilters.Filter] = []
    frequent = None
    while (size := proposed.count()) or not filters:
        filters.append(_filter(proposed, size))
        found = cut_lineage(
            _count(body, how.longest, filters)
            .where((F.col("f") >= how.least) | (F.col("phrase") == ""))
            .select("lang", words.alias("words"), "phrase", "f")
        )
        frequent = found if frequent is None else frequent.unionByName(found)
        sent = list(filters)

        def outside(langs: pa.Array, phrases: pa.Array) -> pa.Array:
            return pa.array(~_member(sent, phrase_keys(langs, phrases)))

        failed = F.arrow_udf(outside, "boolean")
        proposed = cut_lineage(found.where(part).where(failed("lang", "phrase")).select("lang", "phrase"))
    for f in filters:
        f.release()
    return frequent


def _sub_phrase(words: F.Column, start, size) -> F.Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    how: Mining = Mining(),
    covered: tuple[int, int] = (80, 100),
    top: int = 2000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more.

    A phrase's score is floor(2 000 000 a / (l + r)) at its weakest cut into two parts that occur
    l and r times. A phrase inside a longer frequent one that has ``covered`` of its occurrences
    goes. ``top`` is the length of the report.
    """
    counts = cut_lineage(frequent_phrases(docs, text_col, lang_col, how))
    exact = "decimal(38,0)"
    several = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = several.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("w") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    _sub_phrase(F.col("w"), F.lit(1), k).alias("head"),
                    _sub_phrase(F.col("w"), k + 1, F.size("w") - k).alias("tail"),
                ),
            )
        ).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    known = counts.where("words > 0")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .withColumn(
            "score",
            F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"),
        )
        .groupBy("lang", "phrase", "a")
        .agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
        .select("lang", "phrase", "a", "cut.*")
    )
    inside = (
        several.where("words > 2")
        .select(
            "lang",
            "f",
            F.explode(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.sequence(F.lit(2), F.size("w") - 1),
                            lambda size: F.transform(
                                F.sequence(F.lit(1), F.size("w") - size + 1),
                                lambda at: _sub_phrase(F.col("w"), at, size),
                            ),
                        )
                    )
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    part, whole = covered
    stays = F.col("longer").isNull() | (F.col("longer").cast(exact) * whole < F.col("a").cast(exact) * part)
    left = cut_lineage(scored.join(inside, ["lang", "phrase"], "left").where(stays).drop("longer"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = dealt.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))
    ).where(F.col("rank") <= top)
    ranked = few.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    ).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
