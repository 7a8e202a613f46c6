"""Corpus pipeline over ``documents``: each stage is written as Parquet and read by the next.

1. language ID: documents without a letter, or whose language the model rejects, go;
2. line dedup: a line found in several documents stays in the first; texts shrink, rows stay;
3. n-gram Jaccard join: near duplicates (five-word shingles, similarity 0.8) leave one of a group;
4. benchmark decontamination: contaminated documents go, others stay as they are;
5. BPE: token ids of the texts that are left, with the round trip checked.

A stage works on all rows of the one before. All but the last return the columns they were given.
Null texts go in the first stage; the later ones take them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseflow.llm.bpe import encode_texts
from clauseflow.llm.decontaminate import mark_contamination
from clauseflow.llm.jaccard import Similarity, drop_near_duplicates
from clauseflow.llm.langid import identify, learn
from clauseflow.llm.linededup import dedup_lines
from clauseflow.llm.queries import tokenizer_file
from clauseflow.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs, learn(docs)).where(~F.col("rejected")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text becomes the kept lines and n_chars its length; nothing else changes."""
    kept = dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, sim=Similarity(n=5, num=80, den=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return mark_contamination(docs, items).where(~F.col("contaminated")).select(docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian unsigned 32-bit) and whether they decode back."""
    coded = encode_texts(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.col("ids").alias("token_ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_tokens", bpe_tokens),
]

#: Language ID is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
