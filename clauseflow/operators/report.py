"""Risk report: dedupe, features, score, verdict, recommendations.

All findings of one document come from one text and sit in one array, so the whole report
is a projection; nothing is shuffled between the rules and the recommendations.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clauseflow import lexicon as L
from clauseflow.functions.text import collapse_spaces
from clauseflow.session import literal_table


def finding_key(f: Column) -> Column:
    """Dedupe key: type and the opening of the normalised quote, else of the description.

    The 60-character opening is the definition of the key, not a shortcut.
    """
    q = F.lower(F.substring(collapse_spaces(F.coalesce(f["quote"], F.lit(""))), 1, 60))
    d = F.lower(F.substring(F.coalesce(f["description"], F.lit("")), 1, 60))
    return F.concat(f["flag_type"], F.lit("|"), F.when(F.length(q) > 0, q).otherwise(d))


def dedupe_array(df: DataFrame, findings: str) -> DataFrame:
    """Strongest finding per key (first wins ties), strongest first."""
    keyed = df.withColumn(
        "_k",
        F.transform(
            findings,
            lambda f, i: F.struct(
                (-f["confidence"]).alias("neg"), i.alias("ord"), finding_key(f).alias("key"),
                f.alias("f"),
            ),
        ),
    )
    # the map type inside a finding has no order, so sort on the comparable part only
    keyed = keyed.withColumn(
        "_o",
        F.array_sort(F.transform("_k", lambda x: F.struct(x["neg"], x["ord"], x["key"]))),
    )
    keyed = keyed.withColumn("_keys", F.transform("_o", lambda x: x["key"]))
    first = F.filter("_o", lambda x, i: F.array_position(F.col("_keys"), x["key"]) == i + 1)
    kept = F.transform(first, lambda x: F.get(F.col(findings), x["ord"]))
    return keyed.withColumn(findings, kept).drop("_k", "_o", "_keys")


def features(text_len: Column) -> list[Column]:
    """The 17 model features from fact columns and the findings array."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    confs = F.transform("findings", lambda f: f["confidence"])
    n = F.size("findings")
    total = F.aggregate(confs, F.lit(0.0), lambda a, x: a + x)
    open_ = F.size(F.filter("brands", lambda b: ~b["guarded"]))
    cols = {
        "has_brand": (F.size("brands") > 0).cast("int"),
        "brand_count": F.size("brands"),
        "has_equivalent": F.exists("brands", lambda b: b["guarded"]).cast("int"),
        "brands_without_equiv": open_,
        "has_units": flag(F.col("has_units")),
        "has_ranges": flag(F.col("has_ranges")),
        "missing_char_count": F.size("missing"),
        "restrictive_count": F.size("phrases"),
        "ktru_mentioned": (F.coalesce("ktru_code", F.lit("")) != "").cast("int"),
        "beyond_ktru": flag(F.col("has_additional")),
        "has_functional": F.coalesce("has_functional", F.lit(True)).cast("int"),
        "has_technical": F.coalesce("has_technical", F.lit(True)).cast("int"),
        "has_quality": F.coalesce("has_quality", F.lit(True)).cast("int"),
        "risk_flag_count": n,
        "max_confidence": F.coalesce(F.array_max(confs), F.lit(0.0)),
        "mean_confidence": F.when(n > 0, total / n).otherwise(F.lit(0.0)),
        "tz_char_count": text_len,
    }
    return [cols[c].cast("double").alias(c) for c in L.FEATURE_COLUMNS]


def fallback_score(n: Column, max_conf: Column) -> Column:
    return F.when(n == 0, F.lit(0.1)).otherwise(
        F.least(F.lit(0.95), F.lit(0.3) + F.lit(0.15) * n + F.lit(0.3) * max_conf)
    )


def risk_verdict(score: Column, n: Column, max_conf: Column) -> Column:
    return (
        F.when(n == 0, F.lit("low"))
        .when((score >= 0.7) | (max_conf >= 0.85) | (n >= 4), F.lit("high"))
        .when((score >= 0.4) | (max_conf >= 0.55) | (n >= 2), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


@dataclass(frozen=True)
class RiskModel:
    """A fitted linear model over raw features; standardisation is folded into the weights."""

    version: str
    names: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, features: Column) -> Column:
        """Positive probability; features the row lacks count as 0, as do nulls."""
        return self.score_of({n: features[n] for n in L.FEATURE_COLUMNS})

    def score_of(self, columns: dict[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for name, w in zip(self.names, self.weights):
            if name in columns:
                z = z + F.lit(w) * F.coalesce(columns[name].cast("double"), F.lit(0.0))
        return 1 / (1 + F.exp(-z))


MODEL = "version string, saved_at timestamp, names array<string>, weights array<double>, intercept double"


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Append a version; older ones stay readable."""
    row = [(model.version, list(model.names), list(model.weights), model.intercept)]
    df = spark.createDataFrame(row, "version string, names array<string>, weights array<double>, intercept double")
    df.withColumn("saved_at", F.current_timestamp()).select(*[c.split()[0] for c in MODEL.split(", ")]).write.mode(
        "append"
    ).parquet(path)


def load_model(spark: SparkSession, path: str, version: str | None = None) -> RiskModel | None:
    """A stored version, else the latest; None where there is none or it is not usable."""
    try:
        stored = spark.read.schema(MODEL).parquet(path)
        if version is not None:
            stored = stored.where(F.col("version") == version)
        row = stored.orderBy(F.desc("saved_at"), F.desc("version")).first()
    except (AnalysisException, Py4JJavaError):
        return None
    if row is None or None in (row.names, row.weights, row.intercept) or len(row.names) != len(row.weights):
        return None
    return RiskModel(row.version, tuple(row.names), tuple(row.weights), row.intercept)


def assemble(df: DataFrame, text_len: Column, model: RiskModel | None = None) -> DataFrame:
    """Fact rows with ``findings`` to report rows: ``features`` struct, score and verdict.

    The score is that of the model; without one it is the fallback formula.
    """
    clean = dedupe_array(df, "findings")
    return _scored(clean.withColumn("features", F.struct(*features(text_len))), model)


def _scored(df: DataFrame, model: RiskModel | None) -> DataFrame:
    n, top = F.col("features.risk_flag_count"), F.col("features.max_confidence")
    score = fallback_score(n, top) if model is None else model.score(F.col("features"))
    return df.withColumn("risk_score", score).withColumn(
        "risk_verdict", risk_verdict(F.col("risk_score"), n, top)
    )


def templates(spark: SparkSession) -> DataFrame:
    """Recommendation templates: seven rows, always safe to broadcast."""
    return literal_table(
        spark, list(L.RECOMMENDATIONS), ("flag_type", "title", "fix", "law_ref")
    )


def recommend(findings: DataFrame) -> DataFrame:
    """Recommendation per finding row (``flag_type``, ``description``, ``extra``).

    Unknown types use the ``other`` template; empty placeholders fall back to the description.
    """
    known = F.when(F.col("flag_type").isin(*L.FINDING_TYPES), F.col("flag_type")).otherwise("other")
    j = findings.withColumn("_t", known).join(
        F.broadcast(templates(findings.sparkSession).withColumnRenamed("flag_type", "_t")), "_t"
    )
    desc = F.coalesce("description", F.lit(""))
    stripped = F.trim(F.regexp_replace(desc, f"^{L.MISSING_PREFIX}", ""))
    defaults = {
        "brand": F.lit(L.DEFAULT_BRAND),
        "missing": F.when(desc != "", stripped).otherwise(F.lit(L.DEFAULT_MISSING)),
        "phrase": F.when(desc != "", F.trim(desc)).otherwise(F.lit(L.DEFAULT_PHRASE)),
        "details": desc,
    }
    fix = F.col("fix")
    for name, default in defaults.items():
        given = F.col("extra")[name]
        value = F.when(F.length(given) > 0, given).otherwise(default)
        fix = F.replace(fix, F.lit("{" + name + "}"), value)
    return j.withColumn("fix", fix).drop("_t")
