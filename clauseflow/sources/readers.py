"""Readers for JSON lines, decision files, specification folders and CSV dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MIN_TEXT = 100
TOO_SHORT = 500

DECISION = (
    "decision_id string, fas_case_id string, document_id string, doc_type string, "
    "complaint_number string, purchase_id string, notice_id string, case_number string, "
    "articles array<string>, text_length long, freeze_date string, full_text string, "
    "decision_text string"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines are dropped.

    A path that does not exist is an empty relation.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jsonl_damage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(state, n): how many lines a tolerant read keeps and drops."""
    raw = spark.read.text(path)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    state = (
        F.when(F.trim("value") == "", "blank").when(valid & parsed.isNotNull(), "kept")
        .otherwise("malformed")
    )
    return raw.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def usable_text(*fields: str) -> Column:
    """First field whose stripped text has at least 100 characters, else null."""
    opts = []
    for f in fields:
        t = F.btrim(F.col(f), F.lit(" \t\r\n"))
        opts.append(F.when(F.length(t) >= MIN_TEXT, t))
    return F.coalesce(*opts)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision JSON, one document per file, over the superset schema of all layouts."""
    d = spark.read.schema(DECISION).option("multiLine", True).json(path)
    return d.withColumn("text", usable_text("full_text", "decision_text"))


def decision_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Canonical manifest over layouts that differ in key names.

    The layout follows from which keys are present, even when their value is empty.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.from_json("value", "map<string,string>").alias("m"),
    )

    def pick(first: str, second: str):
        has = F.map_contains_key("m", first)
        value = F.when(has, F.col("m")[first]).otherwise(F.col("m")[second])
        return F.trim(F.coalesce(value, F.lit(""))), F.when(has, first).otherwise(second)

    did, did_field = pick("decision_id", "fas_case_id")
    text, text_field = pick("full_text", "decision_text")
    notice, notice_field = pick("purchase_id", "notice_id")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    n = F.length(F.btrim(text, F.lit(" \t\r\n")))
    return raw.select(
        F.when(did != "", did).otherwise(stem).alias("canonical_decision_id"),
        notice.alias("canonical_notice_id"), "path", n.alias("text_length"),
        (n > 0).alias("has_text"), ((n > 0) & (n < TOO_SHORT)).alias("is_too_short"),
        F.concat_ws("|", did_field, text_field, notice_field).alias("schema_family"),
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("schema_family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_text").alias("with_text"),
        F.count_if("is_too_short").alias("too_short"), F.count_if(~F.col("has_text")).alias("empty"),
        F.count_if(F.col("canonical_notice_id") == "").alias("without_notice"),
    )


def read_specifications(
    spark: SparkSession, glob: str, id_pattern: str = r"/([^/]+)/tz\.md$"
) -> DataFrame:
    """Folder-per-notice texts; undecodable bytes become the replacement character.

    A folder given without wild cards is listed by tasks, at any depth; a glob by the driver.
    Files are read as bytes: the text reader copies the Hadoop settings for every file.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    return raw.select(
        F.regexp_extract("path", id_pattern, 1).alias("notice_id"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with an explicit schema, so id columns stay text and keep leading zeros."""
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", True)
        .option("escape", '"').csv(path)
    )


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of key to text, as (key, hint) rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "hint"))
