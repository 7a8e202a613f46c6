"""Benchmark decontamination with a generalised suffix automaton over the items' words.

The automaton of all normalised items is built once from the benchmark (in blocks of at most
``MAX_WORDS`` words, one pass over the documents for each block) and sent to the tasks. Words of
a document stream through it; the longest match that ends at each word tells which windows of
the items occur there. Only stretches of words that all occur in some item are streamed, since
any other word resets the automaton. Documents never move.

Nulls and odd input: a null or wordless text has no words and is never contaminated; a null
item, or one without words, has no window; equal items share one entry and are all reported;
an item without id marks words but is not listed; with no items nothing is hit; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clauseflow.llm.words import ALNUM, LOWER, Words, chunks, column
from clauseflow.session import cut_lineage

WINDOW = 13
#: A document is contaminated when SHARE times its hit words reach its words.
SHARE = 20
#: Words of items in one automaton; more items make more passes, never a cut.
MAX_WORDS = 2_000_000

SPANS = "array<struct<start:int,end:int,words:int>>"


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of word numbers, with windows marked."""

    def __init__(self, items: list[list[int]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        n = len(self.next)
        order = sorted(range(n), key=self.length.__getitem__)
        # the state of the suffix of `window` words, where there is one
        self.cut = [-1] * n
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.cut[v] = v if self.length[up] < window else self.cut[up]
        self.items: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            state = 0
            for i, word in enumerate(item):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.items.setdefault(self.cut[state], []).append(number)
            if len(item) < window:
                short.setdefault(state, []).append((len(item), number))
        # short items that end at a state or at one of its suffixes
        self.short: list[tuple] = [()] * n
        for v in order[1:]:
            self.short[v] = tuple(short.get(v, ())) + self.short[self.link[v]]

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return state

    def _split(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def stream(self, words: list[int], window: int) -> Iterator[tuple[int, int, tuple | list]]:
        """(place of the last word, length of the window, items) for each window met."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                yield i, window, self.items[self.cut[state]]
            if self.short[state]:
                for size, number in self.short[state]:
                    if size <= matched:
                        yield i, size, (number,)


class Block:
    """An automaton with its vocabulary and the ids of its items."""

    def __init__(self, items: list[tuple[bytes, list[str]]], window: int):
        parts = Words([text for text, _ in items], ALNUM)
        self.vocabulary, numbers = np.unique(parts.hashes(LOWER), return_inverse=True)
        lists = [numbers[a:b].tolist() for a, b in zip(parts.first, parts.first[1:])]
        self.ids = [ids for _, ids in items]
        self.window = window
        self.least = min([window, *map(len, lists)])
        self.automaton = SuffixAutomaton(lists, window)

    def match(self, hashes: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """(hit word flags, ids of items with an occurring window) of one document."""
        hit = np.zeros(len(hashes), bool)
        found: set[str] = set()
        if not len(hashes) or not len(self.vocabulary):
            return hit, found
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = (self.vocabulary[at] == hashes).view(np.int8)
        edge = np.flatnonzero(np.diff(known, prepend=np.int8(0), append=np.int8(0)))
        begins, ends = edge[0::2], edge[1::2]
        for k in np.flatnonzero(ends - begins >= self.least):
            a = int(begins[k])
            for last, size, numbers in self.automaton.stream(at[a : ends[k]].tolist(), self.window):
                hit[a + last - size + 1 : a + last + 1] = True
                for n in numbers:
                    found.update(self.ids[n])
        return hit, found


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[Block]:
    """Automata over the items, each of at most ``most`` words (one item at least)."""
    rows = items.select(
        column(items, id_col).cast("string").alias("id"),
        column(items, text_col).cast("binary").alias("body"),
    ).where("body is not null")
    equal = rows.groupBy("body").agg(F.collect_set("id").alias("ids"))
    waiting: list[tuple[bytes, list[str]]] = []
    size = 0
    for row in equal.toLocalIterator():
        words = Words([bytes(row.body)], ALNUM)
        n = len(words.starts)
        if not n:
            continue
        if waiting and size + n > most:
            yield Block(waiting, window)
            waiting, size = [], 0
        waiting.append((bytes(row.body), list(row.ids)))
        size += n
    if waiting:
        yield Block(waiting, window)


def _pass(texts: pa.Array, spans: pa.Array, block: Block | None) -> pa.StructArray:
    n_words, out_spans, out_items = [], [], []
    before = spans.to_pylist()
    for start, group in chunks(texts):
        words = Words(group, ALNUM)
        hashes = words.hashes(LOWER)
        for k in range(len(group)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            base = int(words.offsets[k])
            n_words.append(b - a)
            begin, end = words.starts[a:b] - base, words.ends[a:b] - base
            hit, found = np.zeros(b - a, bool), set()
            if block is not None:
                hit, found = block.match(hashes[a:b])
            for s in before[start + k] or ():
                hit[(begin >= s["start"]) & (end <= s["end"])] = True
            edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            out_spans.append(
                [
                    {"start": int(begin[i]), "end": int(end[j - 1]), "words": int(j - i)}
                    for i, j in zip(edge[0::2], edge[1::2])
                ]
            )
            out_items.append(sorted(found))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())])
    return pa.StructArray.from_arrays(
        [
            pa.array(n_words, pa.int64()),
            pa.array(out_spans, pa.list_(span)),
            pa.array(out_items, pa.list_(pa.string())),
        ],
        names=["n_words", "spans", "items"],
    )


def _matcher(sent):
    @F.arrow_udf(f"struct<n_words:bigint,spans:{SPANS},items:array<string>>")
    def match(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _pass(texts, spans, sent.value)

    return match


def mark_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    most: int = MAX_WORDS,
) -> DataFrame:
    """All rows with n_words, n_hit long, hit_spans, hit_items array<string>, contaminated.

    ``hit_spans`` are maximal stretches of hit words (byte places in UTF-8, end exclusive, and
    their number of words); ``hit_items`` are sorted. A row is contaminated when
    n_hit > 0 and share * n_hit >= n_words.
    """
    added = {"n_words", "n_hit", "hit_spans", "hit_items", "contaminated"}
    kept = [c for c in docs.columns if c not in added]
    out = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        F.lit(None).cast(f"struct<n_words:bigint,spans:{SPANS},items:array<string>>").alias("m"),
        F.array().cast("array<string>").alias("found"),
    )
    parts = list(blocks(items, item_id, item_text, window, most)) or [None]
    spark = docs.sparkSession
    for i, block in enumerate(parts):
        match = _matcher(spark.sparkContext.broadcast(block))
        body = F.col("row")[text_col].cast("binary")
        out = out.select("row", match(body, F.col("m.spans")).alias("m"), "found").select(
            "row", "m", F.array_union("found", "m.items").alias("found")
        )
        if i + 1 < len(parts):
            out = cut_lineage(out)
    n_hit = F.aggregate(
        F.transform("m.spans", lambda s: s["words"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b
    )
    done = out.select("row", "m", "found", n_hit.alias("n_hit"))
    return done.select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("m.n_words").alias("n_words"),
        F.col("n_hit"),
        F.col("m.spans").alias("hit_spans"),
        F.array_sort("found").alias("hit_items"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("m.n_words"))).alias(
            "contaminated"
        ),
    )


def remove_spans(
    marked: DataFrame, text_col: str = "text", min_words: int = WINDOW, share: int = SHARE
) -> DataFrame:
    """``clean_text``: the text without hit spans of ``min_words`` words or more.

    Where the hit words together reach the coverage limit (1 / share), shorter spans go too.
    """

    @F.arrow_udf("binary")
    def clean(texts: pa.Array, spans: pa.Array, every: pa.Array) -> pa.Array:
        out = []
        for text, found, whole in zip(texts.to_pylist(), spans.to_pylist(), every.to_pylist()):
            text, at, pieces = text or b"", 0, []
            for s in found:
                if whole or s["words"] >= min_words:
                    pieces.append(text[at : s["start"]])
                    at = s["end"]
            out.append(b"".join([*pieces, text[at:]]))
        return pa.array(out, pa.binary())

    cleaned = clean(column(marked, text_col).cast("binary"), F.col("hit_spans"), F.col("contaminated"))
    return marked.withColumn("clean_text", cleaned.cast("string"))


__all__ = ["mark_contamination", "remove_spans"]
