"""Semi-structured decode: JSON recovery, verdict records, finding normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clauseflow import lexicon as L
from clauseflow.functions.text import _once

FINDING = (
    "struct<finding_type:string,description:string,evidence_quote:string,"
    "cited_articles:string,severity:string>"
)
FLAG = "struct<flag_type:string,confidence:double,evidence_quote:string>"
FLAG_RECORD = f"struct<parsed:struct<risk_flags:array<{FLAG}>>,risk_flags:array<{FLAG}>>"

# typed fact record of the service; nullable booleans keep three states
FACTS = (
    "struct<doc_type:string,"
    "brands:array<struct<name:string,has_equivalent_clause:boolean,equivalent_text:string,quote:string>>,"
    "measurements:struct<has_units:boolean,has_ranges:boolean,units_found:array<string>,"
    "missing_characteristics:array<string>>,"
    "restrictive_phrases:array<struct<phrase:string,quote:string>>,"
    "standards:struct<gost_references:array<string>,ktru_code:string,has_additional_beyond_ktru:boolean>,"
    "completeness:struct<has_functional_requirements:boolean,has_technical_requirements:boolean,"
    "has_quality_requirements:boolean,has_acceptance_criteria:boolean,has_warranty_terms:boolean,"
    "has_delivery_terms:boolean>,"
    "contract_specific:struct<has_penalty_clause:boolean,has_guarantee_provisions:boolean,"
    "has_acceptance_procedure:boolean,payment_terms_defined:boolean>,"
    "notice_specific:struct<has_nmck:boolean,has_submission_deadline:boolean,"
    "procurement_method_stated:boolean,has_eligibility_criteria:boolean>>"
)


def json_candidate(text: Column) -> Column:
    """JSON part of free text: fenced block, else outermost braces, else the whole text."""

    def fenced(t: Column) -> Column:
        return F.regexp_extract(t, r"```(?:json)?[ \t\r\n]*(\{[\s\S]*?\}|\[[\s\S]*?\])[ \t\r\n]*```", 1)

    def bare(t: Column) -> Column:
        return F.regexp_extract(t, r"(\{[\s\S]*\}|\[[\s\S]*\])", 1)

    def first_of(t: Column) -> Column:
        rest = _once(bare(t), lambda b: F.when(b != "", b).otherwise(t))
        return _once(fenced(t), lambda f: F.when(f != "", f).otherwise(rest))

    # each part is computed once, and the braces only where no block is fenced
    return _once(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), first_of)


def parse_status(candidate: Column) -> Column:
    return F.when(F.isnull(F.try_parse_json(candidate)), F.lit("parse_failed")).otherwise(F.lit("ok"))


def cut(c: Column, limit: int) -> Column:
    """Text of at most ``limit`` characters, ending in an ellipsis when shortened."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)


def coerce_verdict(raw: Column) -> Column:
    """Detector verdict; anything unknown falls back to not_established."""
    r = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    rest = F.regexp_replace(r, "not_established|not established", "")
    plain = F.contains(r, F.lit("violation")) & ~F.contains(rest, F.lit("not"))
    return F.when(plain, F.lit("violation")).otherwise(F.lit("not_established"))


VERDICT = "verdict string, confidence string, evidence_quote string, reasoning string"


def verdict_record(text: Column) -> dict[str, Column]:
    """verdict, confidence, evidence_quote and reasoning of one detector response."""
    cand = json_candidate(text)
    return _verdict_of(text, F.from_json(cand, VERDICT), parse_status(cand) == "parse_failed")


def with_verdict_record(df: DataFrame, text: str) -> DataFrame:
    """Add the four columns of :func:`verdict_record` in place of a response, decoded once a row."""
    staged = df.withColumn("_cand", json_candidate(F.col(text)))
    staged = staged.withColumn("_body", F.from_json("_cand", VERDICT)).withColumn(
        "_bad", parse_status(F.col("_cand")) == "parse_failed"
    )
    made = _verdict_of(F.col(text), F.col("_body"), F.col("_bad"))
    return staged.withColumns(made).drop(text, "_cand", "_body", "_bad")


def _verdict_of(text: Column, body: Column, bad: Column) -> dict[str, Column]:
    conf = F.coalesce(F.expr("NULL").cast("double"), body["confidence"].try_cast("double"), F.lit(0.0))
    raw = cut(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), 200)
    return {
        "verdict": F.when(bad, F.lit("not_established")).otherwise(coerce_verdict(body["verdict"])),
        "confidence": F.when(bad, F.lit(0.0)).otherwise(
            F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
        ),
        "evidence_quote": F.when(bad, F.lit("")).otherwise(cut(body["evidence_quote"], 300)),
        "reasoning": F.when(
            bad, F.concat(F.lit("parse_error: could not decode JSON. raw="), raw)
        ).otherwise(cut(body["reasoning"], 600)),
    }


def parse_bool(c: Column) -> Column:
    return F.lower(F.trim(c)) == "true"


def parse_json_list(c: Column) -> Column:
    """List from JSON text; bare text becomes a one-element list and empty text none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(t == "", F.array().cast("array<string>"))
        .when(F.startswith(t, F.lit("[")), F.coalesce(F.from_json(t, "array<string>"), F.array(t)))
        .otherwise(F.array(t))
    )


def normalize_finding(f: Column) -> Column:
    """Finding with vocabulary defaults, list-valued articles and bounded texts."""
    ftype = F.trim(F.coalesce(f["finding_type"], F.lit("")))
    sev = F.lower(F.trim(F.coalesce(f["severity"], F.lit(""))))
    arts = F.filter(
        F.transform(parse_json_list(f["cited_articles"]), lambda a: F.trim(a)), lambda a: F.length(a) > 0
    )
    return F.struct(
        F.when(ftype.isin(*L.FINDING_TYPES), ftype).otherwise(F.lit("other")).alias("finding_type"),
        F.substring(F.coalesce(f["description"], F.lit("")), 1, 1000).alias("description"),
        F.substring(F.coalesce(f["evidence_quote"], F.lit("")), 1, 1500).alias("evidence_quote"),
        arts.alias("cited_articles"),
        F.when(sev.isin(*L.SEVERITIES), sev).otherwise(F.lit("not_established")).alias("severity"),
    )


def normalize_decision(parsed: Column) -> dict[str, Column]:
    """Findings, verdict (derived when missing) and bounded reasoning of one decision."""
    findings = F.transform(
        F.coalesce(parsed["findings"], F.array().cast(f"array<{FINDING}>")), normalize_finding
    )
    stated = F.trim(F.coalesce(parsed["overall_verdict"], F.lit("")))
    derived = F.when(
        F.exists(findings, lambda f: f["severity"] == "established"), F.lit(L.POSITIVE)
    ).otherwise(F.lit(L.NEGATIVE))
    return {
        "findings": findings,
        "overall_verdict": F.when(stated.isin(L.POSITIVE, L.NEGATIVE), stated).otherwise(derived),
        "key_reasoning": F.when(parsed.isNull(), F.lit("(parse_failed)")).otherwise(
            F.substring(F.coalesce(parsed["key_reasoning"], F.lit("")), 1, 500)
        ),
    }


def pick_flags(record: Column) -> Column:
    """Flags of either record layout, nulls dropped."""
    none = F.array().cast(f"array<{FLAG}>")
    raw = F.when(record["parsed"].isNotNull(), record["parsed"]["risk_flags"]).otherwise(
        record["risk_flags"]
    )
    return F.filter(F.coalesce(raw, none), F.isnotnull)


def facts_with_defaults(json_text: Column) -> Column:
    """Typed fact record: absent lists empty, completeness true, three-valued flags null."""
    f = F.from_json(json_text, FACTS)

    def arr(c: Column, t: str) -> Column:
        return F.coalesce(c, F.array().cast(f"array<{t}>"))

    def flag(group: str, name: str, default: bool | None) -> Column:
        c = f[group][name]
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    brand = "struct<name:string,has_equivalent_clause:boolean,equivalent_text:string,quote:string>"
    return F.struct(
        F.coalesce(f["doc_type"], F.lit("tz")).alias("doc_type"),
        F.transform(
            arr(f["brands"], brand),
            lambda b: F.struct(
                b["name"].alias("name"),
                F.coalesce(b["has_equivalent_clause"], F.lit(False)).alias("has_equivalent_clause"),
                b["equivalent_text"].alias("equivalent_text"),
                F.coalesce(b["quote"], F.lit("")).alias("quote"),
            ),
        ).alias("brands"),
        F.struct(
            flag("measurements", "has_units", False),
            flag("measurements", "has_ranges", False),
            arr(f["measurements"]["units_found"], "string").alias("units_found"),
            arr(f["measurements"]["missing_characteristics"], "string").alias(
                "missing_characteristics"
            ),
        ).alias("measurements"),
        F.transform(
            arr(f["restrictive_phrases"], "struct<phrase:string,quote:string>"),
            lambda p: F.struct(
                p["phrase"].alias("phrase"), F.coalesce(p["quote"], F.lit("")).alias("quote")
            ),
        ).alias("restrictive_phrases"),
        F.struct(
            arr(f["standards"]["gost_references"], "string").alias("gost_references"),
            f["standards"]["ktru_code"].alias("ktru_code"),
            flag("standards", "has_additional_beyond_ktru", False),
        ).alias("standards"),
        F.struct(
            *[
                flag("completeness", n, True)
                for n in (
                    "has_functional_requirements", "has_technical_requirements",
                    "has_quality_requirements", "has_acceptance_criteria",
                    "has_warranty_terms", "has_delivery_terms",
                )
            ]
        ).alias("completeness"),
        F.struct(
            *[
                flag("contract_specific", n, None)
                for n in (
                    "has_penalty_clause", "has_guarantee_provisions",
                    "has_acceptance_procedure", "payment_terms_defined",
                )
            ]
        ).alias("contract_specific"),
        F.struct(
            *[
                flag("notice_specific", n, None)
                for n in (
                    "has_nmck", "has_submission_deadline",
                    "procurement_method_stated", "has_eligibility_criteria",
                )
            ]
        ).alias("notice_specific"),
    )
