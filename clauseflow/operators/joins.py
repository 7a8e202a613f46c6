"""Joins that need more than ``DataFrame.join``: containment and attach with accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.functions.text import TOKEN, all_matches, normalize_text
from clauseflow.session import cut_lineage

#: Inner words in the key of a quote, at most.
INNER = 5
#: Up to so many inner words the key also takes characters of the first and last word, so many of each.
FEW, ENDS = 2, 3
#: Characters in the key of a quote of one word: the most of these that it has.
PARTS = (1, 2, 3, 5, 8)


def _window_key(word, inner: int, head: int, tail: int) -> Column:
    """Key of the inner words 1 .. ``inner``, with the last characters of word 0 and the first of the next."""
    ends = ([F.substring(word(0), -head, head)] if head else []) + ([F.substring(word(inner + 1), 1, tail)] if tail else [])
    return F.xxhash64(F.lit(f"words {inner} {head} {tail}"), *[word(i) for i in range(1, inner + 1)], *ends)


def _part_key(text: Column, at, size: int) -> Column:
    return F.xxhash64(F.lit(f"part {size}"), F.substring(text, at, F.lit(size)))


def _mark_key(text: Column) -> Column:
    return F.xxhash64(F.lit("mark"), F.substring(text, 1, 1))


def containment_join(
    quotes: DataFrame, quote_key: str, quote_text: str,
    docs: DataFrame, doc_key: str, doc_text: str,
) -> DataFrame:
    """(quote key, document key) where the normalised quote is a substring of the document.

    The inner words of a contained quote are whole words of the document, its first and last
    word may be cut. So a key of its inner words (the first ``INNER``; of up to ``FEW`` together
    with the last characters of the first word and the first of the last) is among the keys of
    the document's neighbouring words, and the substring test runs only on candidates. A quote of
    one word is found by its first characters in any place of a word, one without any word (marks
    only) by its first character. Only the kinds of keys that the quotes have are cut from the
    documents, which are normalised and split once; keys meet the quotes where they are made, as
    long as those are few enough to be sent there.
    """
    q = quotes.select(quote_key, normalize_text(F.col(quote_text), compat=True).alias("_q")).where(
        F.length("_q") > 0
    )
    q = cut_lineage(q.withColumn("_t", all_matches(F.col("_q"), TOKEN)))
    n, first, last = F.size("_t"), F.get("_t", F.lit(0)), F.get("_t", F.size("_t") - 1)
    inner = F.least(n - 2, F.lit(INNER))

    def taken(word: Column) -> Column:
        return F.when(inner <= FEW, F.least(F.length(word), F.lit(ENDS))).otherwise(F.lit(0))

    size = F.greatest(*[F.when(F.length(first) >= s, s) for s in PARTS], F.lit(0))
    q = q.withColumn(
        "_kind",
        F.when(n >= 2, F.array(inner, taken(first), taken(last)))
        .when(n == 1, F.array(size)).otherwise(F.array().cast("array<int>")),
    )
    kinds = sorted(tuple(r[0]) for r in q.select("_kind").distinct().collect())  # 36 at most
    windows = [k for k in kinds if len(k) == 3]
    sizes = [k[0] for k in kinds if len(k) == 1]

    def own(kind: tuple) -> Column:
        if not kind:
            return _mark_key(F.col("_q"))
        if len(kind) == 1:
            return _part_key(first, F.lit(1), kind[0])
        return _window_key(
            lambda i: last if i > kind[0] and kind[2] else F.get("_t", F.lit(i)), *kind
        )

    if not kinds:
        return docs.select(doc_key).limit(0).join(quotes.select(quote_key).limit(0), F.lit(False)).select(quote_key, doc_key)
    key = F.lit(None).cast("long")
    for kind in kinds:
        key = F.when(F.col("_kind") == F.array(*[F.lit(x) for x in kind]).cast("array<int>"), own(kind)).otherwise(key)
    wanted = cut_lineage(q.select(quote_key, "_q", key.alias("_h")))

    d = docs.select(doc_key, normalize_text(F.col(doc_text), compat=True).alias("_d"))
    d = cut_lineage(d.select(doc_key, "_d", all_matches(F.col("_d"), TOKEN).alias("_t")))
    keys = []
    if windows:
        wide = max(k[0] + 2 for k in windows)
        # all words from each place on; what is missing behind the last one is null
        cut = F.arrays_zip(*[F.slice("_t", i + 1, F.greatest(F.size("_t") - i, F.lit(0))).alias(f"w{i}") for i in range(wide)])
        rows = d.select(doc_key, F.inline(cut))
        whole = [F.when(F.col(f"w{k[0] + 1}").isNotNull(), _window_key(lambda i: F.col(f"w{i}"), *k)) for k in windows]
        keys.append(rows.select(doc_key, F.explode(F.array(*whole)).alias("_h")))
    if sizes:
        words = d.select(doc_key, F.explode(F.array_distinct("_t")).alias("w"))
        places = words.select(doc_key, "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("at"))
        parts = [F.when(F.col("at") + s - 1 <= F.length("w"), _part_key(F.col("w"), F.col("at"), s)) for s in sizes]
        keys.append(places.select(doc_key, F.explode(F.array(*parts)).alias("_h")))
    if () in kinds:
        marks = F.array_distinct(F.split(F.regexp_replace("_d", r"[\p{L}\p{N}_]", ""), ""))
        keys.append(d.select(doc_key, F.explode(marks).alias("m")).select(doc_key, _mark_key(F.col("m")).alias("_h")))
    short = wanted.select(quote_key, "_h")
    met = reduce(DataFrame.unionByName, [k.join(short, "_h").select(quote_key, doc_key).distinct() for k in keys])
    # a document's candidates come together, so its text is sent and read once
    listed = met.join(wanted.select(quote_key, "_q"), quote_key).groupBy(doc_key).agg(
        F.collect_list(F.struct(F.col(quote_key).alias("key"), "_q")).alias("_c")
    )
    hits = d.select(doc_key, "_d").join(listed, doc_key).select(
        doc_key, F.explode(F.filter("_c", lambda c: F.contains(F.col("_d"), c["_q"]))).alias("_c")
    )
    return hits.select(F.col("_c.key").alias(quote_key), doc_key)


def attach(
    base: DataFrame, main: DataFrame, side: DataFrame, key: str, main_col: str, side_col: str
) -> DataFrame:
    """Left attach of a required and an optional text; ``state`` says what was found."""
    out = base.join(main, key, "left").join(side, key, "left")
    return out.withColumn(
        "state",
        F.when(F.col(main_col).isNull(), "skipped_no_main")
        .when(F.col(side_col).isNull(), "kept_no_side")
        .otherwise("kept"),
    )
