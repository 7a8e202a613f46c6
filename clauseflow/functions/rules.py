"""Compliance rules: Column functions from typed facts to arrays of findings.

A rule takes the fact columns and returns ``array<finding>``; the registry maps a document
type to its ordered rules, so a user adds a rule by adding a function and a registry entry,
and everything stays inside one projection.

Fact columns: ``brands`` array<struct<name, guarded, quote>>, ``phrases``
array<struct<phrase, quote>>, ``missing`` array<string>, ``ktru_code`` string, and the
boolean columns named in the rules (contract and notice ones may be null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from clauseflow.functions.scalar import either
from clauseflow.lexicon import BENCHMARK_PHRASES, RULE_TEXTS as T

Rule = Callable[[], Column]
FINDING = (
    "array<struct<flag_type:string,confidence:double,quote:string,description:string,"
    "extra:map<string,string>>>"
)


def finding(kind: str, confidence: float, quote=None, text=None, extra=None) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(kind).alias("flag_type"),
        F.lit(confidence).alias("confidence"),
        (F.lit("") if quote is None else F.coalesce(quote, F.lit(""))).alias("quote"),
        (F.lit("") if text is None else text).alias("description"),
        (none if extra is None else extra).alias("extra"),
    )


def no_findings() -> Column:
    return F.array().cast(FINDING)


def one_if(cond: Column, item: Column) -> Column:
    return F.when(cond, F.array(item)).otherwise(no_findings())


def yardstick(quote: Column, phrases=BENCHMARK_PHRASES) -> Column:
    low = F.lower(F.coalesce(quote, F.lit("")))
    return either([F.contains(low, F.lit(p)) for p in phrases])


def brand_rule(phrases=BENCHMARK_PHRASES) -> Rule:
    def rule() -> Column:
        open_ = F.filter("brands", lambda b: ~b["guarded"] & ~yardstick(b["quote"], phrases))
        return F.transform(
            open_,
            lambda b: finding(
                "brand_without_equivalent", 0.95, b["quote"],
                F.replace(F.lit(T["brand"]), F.lit("{}"), b["name"]),
                F.create_map(F.lit("brand"), b["name"]),
            ),
        )

    return rule


def restrictive_phrases() -> Column:
    """Phrases that do not repeat a brand carrying an equivalence clause."""

    def guarded_brand_inside(p: Column) -> Column:
        return F.exists(
            "brands",
            lambda b: b["guarded"] & (F.length(b["name"]) > 0)
            & F.contains(F.lower(p), F.lower(b["name"])),
        )

    kept = F.filter(
        "phrases",
        lambda p: (F.length(F.coalesce(p["phrase"], F.lit(""))) > 0)
        & ~guarded_brand_inside(p["phrase"]),
    )
    return F.transform(
        kept,
        lambda p: finding(
            "restrictive_requirement", 0.7,
            F.when(F.length(p["quote"]) > 0, p["quote"]).otherwise(p["phrase"]),
            F.replace(F.lit(T["phrase"]), F.lit("{}"), p["phrase"]),
            F.create_map(F.lit("phrase"), p["phrase"]),
        ),
    )


def missing_acceptance() -> Column:
    return one_if(
        ~F.coalesce("has_acceptance", F.lit(True)),
        finding("missing_acceptance_terms", 0.85, text=F.lit(T["acceptance"])),
    )


def incomplete_description() -> Column:
    own = F.filter(
        F.array(
            F.when(~F.coalesce("has_functional", F.lit(True)), F.lit(T["functional"])),
            F.when(~F.coalesce("has_technical", F.lit(True)), F.lit(T["technical"])),
            F.when(~F.coalesce("has_units", F.lit(False)), F.lit(T["units"])),
        ),
        F.isnotnull,
    )
    listed = F.array_distinct(
        F.concat(own, F.filter("missing", lambda m: F.length(F.coalesce(m, F.lit(""))) > 0))
    )
    text = F.array_join(listed, ", ")
    return one_if(
        F.size(listed) > 0,
        finding(
            "incomplete_description", 0.8, text=F.concat(F.lit(T["missing_head"]), text),
            extra=F.create_map(F.lit("missing"), text),
        ),
    )


def catalogue_mismatch() -> Column:
    no_code = F.coalesce("ktru_code", F.lit("")) == ""
    beyond = F.coalesce("has_additional", F.lit(False))
    return (
        F.when(no_code, F.array(finding("ktru_mismatch", 0.5, text=F.lit(T["no_code"]))))
        .when(
            beyond,
            F.array(
                finding(
                    "ktru_mismatch", 0.65, text=F.lit(T["beyond_code"]),
                    extra=F.create_map(F.lit("ktru_code"), F.col("ktru_code")),
                )
            ),
        )
        .otherwise(no_findings())
    )


def stated_false(column: str, kind: str, confidence: float, text: str) -> Rule:
    """Fires only when the flag is stated and false; null means not stated."""

    def rule() -> Column:
        stated = F.col(column).isNotNull() & ~F.col(column)
        return one_if(stated, finding(kind, confidence, text=F.lit(T[text])))

    return rule


no_penalty = stated_false("has_penalty", "missing_acceptance_terms", 0.9, "penalty")
no_guarantee = stated_false("has_guarantee", "missing_acceptance_terms", 0.85, "guarantee")
no_acceptance_procedure = stated_false(
    "has_acceptance_procedure", "missing_acceptance_terms", 0.8, "acceptance_procedure"
)
no_price = stated_false("has_price", "incomplete_description", 0.95, "price")
no_deadline = stated_false("has_deadline", "incomplete_description", 0.9, "deadline")
no_method = stated_false("has_method", "incomplete_description", 0.85, "method")


def rule_sets(phrases=BENCHMARK_PHRASES) -> dict[str, list[Rule]]:
    """Ordered rules per document type; an unknown type uses the ``tz`` set."""
    brand = brand_rule(phrases)
    return {
        "tz": [brand, restrictive_phrases, missing_acceptance, incomplete_description,
               catalogue_mismatch],
        "contract": [brand, restrictive_phrases, no_penalty, no_guarantee,
                     no_acceptance_procedure],
        "notice": [no_price, no_deadline, no_method, restrictive_phrases],
        "documentation": [brand, restrictive_phrases, missing_acceptance,
                          incomplete_description],
    }


def evaluate(doc_type: Column, sets: dict[str, list[Rule]] | None = None) -> Column:
    """Findings of the rules of one document's type, in rule order."""
    sets = sets or rule_sets()
    expr = None
    for name, rules in sets.items():
        found = F.concat(*[r() for r in rules])
        expr = F.when(doc_type == name, found) if expr is None else expr.when(doc_type == name, found)
    return expr.otherwise(F.concat(*[r() for r in sets["tz"]]))
