"""Token counts through a digest cache.

The key of a count is the digest of the normalised content together with the digest of the
tokenizer file, so another version of the tokenizer never meets old counts. Texts are reduced
to one row for each digest before and after the shuffle; digests that the cache holds are
dropped; only distinct misses are encoded and their counts appended to the cache.

Normalisation joins runs of ASCII white space to one space, which changes no count for
tokenizers that drop white space between words (``squeeze=False`` keeps every byte for others).

Nulls and odd input: a null text counts as empty, with no tokens; equal texts are encoded once;
a missing cache is an empty one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clauseflow.llm.bpe import read_file
from clauseflow.llm.words import column
from clauseflow.session import cut_lineage

#: Entries of a task's table of words.
MAX_WORDS = 400_000
CACHE = "content string, tokenizer string, n_tokens bigint"


def content_digest(text: Column, squeeze: bool = True) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    if squeeze:
        text = F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "), F.lit(" "))
    return F.sha2(text.cast("binary"), 256)


class _Counts(dict):
    """Word to its number of tokens; unknown words of a batch are encoded together."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > MAX_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        texts = [w.decode("utf-8", "replace") for w in new]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            self[w] = len(e.ids)


_counters: dict[str, _Counts] = {}


def count_words(counts: _Counts, text: bytes) -> int:
    """Tokens of a text as the sum over its words (split at ASCII white space)."""
    words = text.split()
    try:
        return sum(map(counts.__getitem__, words))
    except KeyError:
        counts.learn(set(words))
        return sum(map(counts.__getitem__, words))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text"
) -> DataFrame:
    """All rows with n_bytes and n_tokens long.

    ``tokenizer_path`` is a tokenizers file that drops white space between words;
    ``cache_path`` a Parquet folder that all executors reach. Counts of contents that the
    cache lacks are appended to it before the result is read.
    """
    spark = docs.sparkSession
    spec = read_file(spark, tokenizer_path)
    version = hashlib.sha256(spec.encode()).hexdigest()
    sent = spark.sparkContext.broadcast(spec)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        counts = _counters.get(version)
        if counts is None:
            _counters.clear()
            counts = _counters[version] = _Counts(sent.value)
        return pa.array([count_words(counts, t or b"") for t in texts.to_pylist()], pa.int64())

    text = column(docs, text_col)
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    distinct = (
        docs.select(content_digest(text).alias("content"), text.cast("string").alias("body"))
        .groupBy("content")
        .agg(F.first("body").alias("body"))
    )
    misses = distinct.join(cached.select("content"), "content", "left_anti")
    misses.select(
        "content",
        F.lit(version).alias("tokenizer"),
        count(F.col("body").cast("binary")).alias("n_tokens"),
    ).write.mode("append").parquet(cache_path)

    # Stored, so that the join below has an exchange on both sides and Spark can split a content
    # that a large part of the rows share.
    known = cut_lineage(
        read_cache(spark, cache_path)
        .where(F.col("tokenizer") == version)
        .groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    kept = [c for c in docs.columns if c not in {"n_bytes", "n_tokens"}]
    keyed = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        content_digest(text).alias("content"),
    )
    return keyed.join(known, "content", "left").select(
        *[F.col("row")[c].alias(c) for c in kept], "n_bytes", "n_tokens"
    )
