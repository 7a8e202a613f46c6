"""Scalar columns: ids, verdicts, tiers, statuses, costs, lanes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from clauseflow import lexicon as L


def either(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def ratio(num: Column, den: Column) -> Column:
    """Quotient with 0 for a zero or missing denominator."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def normalize_notice_id(c: Column, width: int = L.NOTICE_ID_WIDTH) -> Column:
    """Zero-pad digit strings that are too short; longer and non-digit ids stay."""
    return F.when(c.rlike("^[0-9]+$") & (F.length(c) < width), F.lpad(c, width, "0")).otherwise(c)


def decision_id(episode_id: Column) -> Column:
    return F.regexp_replace(episode_id, "_[^_]*$", "")


def verdict_name(c: Column) -> Column:
    pairs = [F.lit(x) for kv in L.VERDICT_NAMES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)


def not_specification(text: Column, patterns, case_flags: str = "(?iuU)", probe: int = 500) -> Column:
    """None of the document-family phrases occurs in the opening characters.

    The opening is the definition of the probe, not a shortcut.
    """
    head = F.substring(text, 1, probe)
    return ~either([head.rlike(case_flags + p) for p in patterns])


def quality_tier(chars: Column, not_spec: Column, missing: Column) -> Column:
    """struct(tier, reason); the first condition that holds wins."""

    def out(tier: str, reason: str = "") -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"))

    return (
        F.when(missing, out("drop", "file_missing"))
        .when(not_spec, out("drop", "not_tz"))
        .when(chars < 1000, out("drop", "too_short"))
        .when(chars < 3000, out("thin"))
        .when(chars <= 200_000, out("normal"))
        .otherwise(out("chunking_risk"))
    )


def stratum_override(cluster: Column, stratum: Column, target: int = 16) -> Column:
    return F.when(cluster == target, F.lit("conditional")).otherwise(stratum)


def truncated(text: Column, limit: int = L.DOC_CHAR_LIMIT) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(L.TRUNCATION_MARK))
    ).otherwise(text)


def tier_instruction(tier: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(""))
    for name, text in L.TIER_INSTRUCTIONS.items():
        expr = expr.when(tier == name, F.lit(text))
    return expr.otherwise(F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(text: Column, doc_type: Column) -> Column:
    return F.concat_ws(":", content_hash(text), doc_type)


def fallback_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Cost from the price table; a model outside the table costs 0."""

    def price(i: int) -> Column:
        pairs = [x for m, p in L.TOKEN_PRICES.items() for x in (F.lit(m), F.lit(p[i]))]
        return F.coalesce(F.create_map(*pairs)[model], F.lit(0.0))

    return (tokens_in * price(0) + tokens_out * price(1)) / F.lit(1e6)


def inclusion(scope: Column, has_docs: Column) -> tuple[Column, Column]:
    """(status, reason) of an episode by scope tag and document flag."""
    keep, say = scope.isin(*L.INCLUDED_SCOPES) & has_docs, {k: F.lit(v) for k, v in L.INCLUSION.items()}
    status = F.when(keep, say["included"]).otherwise(say["excluded"])
    reason = (
        F.when(keep, say["core"])
        .when(~has_docs, say["no_documents"])
        .otherwise(F.concat(say["other_scope"], scope))
    )
    return status, reason


def cluster_shape(
    cluster: Column, size: Column, top_count: Column, n_scopes: Column, overrides=None
) -> tuple[Column, Column]:
    """(shape flag, attention reason) with manual overrides first."""
    mixed = (ratio(top_count, size) < 0.75) | (n_scopes >= 3)

    def ladder(part: int) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for cid, given in (L.SHAPE_OVERRIDES if overrides is None else overrides).items():
            out = out.when(cluster == cid, F.lit(given[part]))
        mixed_, broad, coherent = (F.lit(L.SHAPES[k][part]) for k in ("mixed", "broad", "coherent"))
        return out.when(mixed, mixed_).when(size >= 200, broad).otherwise(coherent)

    return ladder(0), ladder(1)


def benchmark_signal(shape: Column, dependency: Column, knowledge: Column, size: Column) -> Column:
    open_knowledge = knowledge.isin("none", "market_knowledge", "regulatory_history")
    likely = (dependency == "full") & (knowledge == "none") & (size >= 20)
    say = {k: F.lit(v) for k, v in L.SIGNALS.items()}
    return (
        F.when(F.startswith(shape, F.lit("mixed")), say["mixed"])
        .when(F.startswith(shape, F.lit("broad")), say["broad"])
        .when(likely, say["likely"])
        .when(dependency.isin("full", "partial") & open_knowledge, say["conditional"])
        .otherwise(say["none"])
    )


def family_status(
    size: Column, dependency: Column, knowledge: Column, qc: Column, attention: Column
) -> tuple[Column, Column]:
    """(status, reason) of a family; conditional families list every unmet criterion."""
    mis_scoped = F.startswith(attention, F.lit("mis_scoped")) | F.startswith(attention, F.lit("out_of_scope"))
    ladder = {
        "mis_scoped": mis_scoped,
        "small": size < 10,
        "strict": (dependency == "full") & (knowledge == "none") & (qc == "coherent") & (size >= 20),
        "expert": knowledge.isin("expert_judgment", "physical_measurement"),
        "undetectable": dependency == "none",
        "market": (knowledge == "market_knowledge") & (dependency != "full"),
    }
    say = {k: F.lit(v) for k, v in L.UNMET.items()}
    unmet = F.concat_ws(
        "; ",
        F.when(dependency != "full", F.concat(say["dependency"], dependency)),
        F.when(knowledge == "regulatory_history", say["history"]).when(
            knowledge != "none", F.concat(say["knowledge"], knowledge)
        ),
        F.when(qc != "coherent", F.concat(say["qc"], qc)),
        F.when(size < 20, say["size"]),
    )
    status, reason = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, holds in ladder.items():
        means, text = L.FAMILY_REASONS[name]
        status, reason = status.when(holds, F.lit(means)), reason.when(holds, F.lit(text))
    means, text = L.FAMILY_REASONS["rest"]
    return (
        status.otherwise(F.lit(means)),
        reason.otherwise(F.when(unmet == "", F.lit(text)).otherwise(unmet)),
    )


def keyword_lanes(text: Column, lanes=L.KEYWORD_LANES) -> tuple[Column, Column, Column]:
    """(primary, secondary, note) of the keyword lanes hit by lower-cased text.

    Short terms match as whole words and stems at word start.
    """

    def hit(term: str) -> Column:
        if term in L.WHOLE_WORD_TERMS:
            return text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){term}(?:$|[^\p{{L}}\p{{N}}_])")
        if term in L.WORD_START_TERMS:
            return text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}_]){term}")
        return F.contains(text, F.lit(term))

    hits = F.filter(
        F.array(*[F.when(either([hit(t) for t in terms]), F.lit(name)) for name, terms in lanes]),
        F.isnotnull,
    )
    none = F.size(hits) == 0
    confidence = F.when(F.size(hits) == 1, F.lit("high")).otherwise(F.lit("mixed"))
    return (
        F.when(none, F.lit(L.NO_LANE)).otherwise(F.get(hits, F.lit(0))),
        F.when(none, F.lit("")).otherwise(F.array_join(F.slice(hits, 2, len(lanes)), ";")),
        F.when(none, F.lit(L.NO_LANE_NOTE)).otherwise(
            F.concat(
                F.lit(L.LANE_NOTE[0]), F.array_join(hits, ", "), F.lit(L.LANE_NOTE[1]), confidence,
            )
        ),
    )


def has_phrase(text: Column, phrases=L.BENCHMARK_PHRASES) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return either([F.contains(low, F.lit(p)) for p in phrases])


def embedding_text(label: Column, summary: Column) -> Column:
    from clauseflow.functions.text import collapse_spaces

    return F.concat(F.lit("passage: "), collapse_spaces(label), F.lit(". "), collapse_spaces(summary))


def corpus_text(reasoning: Column, descriptions: Column) -> Column:
    """Reasoning and the non-empty descriptions, one per line."""
    parts = F.concat(F.array(F.coalesce(reasoning, F.lit(""))), descriptions)
    return F.array_join(F.filter(parts, lambda x: F.length(F.trim(x)) > 0), "\n")


def risk_level(n: Column, max_conf: Column) -> Column:
    """Three-level label of the first service version."""
    return (
        F.when(n == 0, F.lit("Низкий"))
        .when((n >= 3) | (max_conf >= 0.8), F.lit("Высокий"))
        .otherwise(F.lit("Средний"))
    )
