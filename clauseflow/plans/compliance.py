"""U*: compliance rules, risk report and recommendations on facts derived from documents."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import rules as RU, text as X
from clauseflow.operators import report as RP
from clauseflow.plans.base import documents, quoted
from clauseflow.plans.registry import query, table
from clauseflow.session import scratch_path

q = quoted
_W = r"[^\p{L}\p{N}_]"
CODE = rf"(?:^|{_W})([A-Z][A-Z0-9-]{{2,}})"
PHRASE = rf"(?i)(?:^|{_W})((?:only|solo|nur|seulement)(?: [^ \n\t\r]{{1,20}}){{0,2}})"
MISSING = r"([0-9]{2,6}%|[a-z]+\$\$\$)"
YARD = ("that", "than", "der ")


def ordered_distinct(e: str) -> str:
    """SQL for a distinct list in first-seen order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


FACTS_SQL = f"""
  SELECT d.doc_id, length(text)::BIGINT AS chars,
   CASE lang WHEN 'en' THEN 'tz' WHEN 'fr' THEN 'contract' WHEN 'de' THEN 'notice' WHEN 'es' THEN 'documentation' ELSE lang END AS doc_type,
   list_transform({ordered_distinct('codes')}, lambda c: {{'name': c,
      'guarded': contains(text, c || ' AND') OR length(c) % 4 = 0, 'quote': substr(text, greatest(1, strpos(text, c) - 30), 100)}}) AS brands,
   list_transform(regexp_extract_all(text, {q(PHRASE)}, 1), lambda p: {{'phrase': p, 'quote': CASE WHEN length(p) > 12 THEN '> ' || p ELSE '' END}}) AS phrases,
   {ordered_distinct('miss')} AS missing,
   nullif(regexp_extract(text, '([0-9]{{10,}})', 1), '') AS ktru_code, contains(text, '@') AS has_additional,
   regexp_matches(text, '[0-9]') AS has_units, contains(text, '|') AS has_ranges, contains(lower(text), 'that') AS has_functional,
   length(text) > 300 AS has_technical, contains(text, ',') AS has_quality, NOT contains(lower(text), 'license') AS has_acceptance,
   CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 END AS has_penalty, CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 0 END AS has_guarantee,
   CASE WHEN l.quality IS NOT NULL THEN length(text) % 2 = 0 END AS has_acceptance_procedure,
   CASE WHEN l.quality IS NOT NULL THEN l.quality = 1 END AS has_price, CASE WHEN l.toxic IS NOT NULL THEN l.toxic = 0 END AS has_deadline,
   CASE WHEN l.quality IS NOT NULL THEN length(text) % 3 > 0 END AS has_method
  FROM (SELECT *, regexp_extract_all(text, {q(CODE)}, 1) AS codes, regexp_extract_all(text, {q(MISSING)}, 1) AS miss
    FROM documents) d LEFT JOIN labels l USING (doc_id)"""


def facts(spark, sf):
    """Typed facts per document; contract and notice flags stay null without a label."""
    t = F.col("text")
    d = documents(spark, sf, "doc_id", "text", "lang")
    n = F.length(t)
    kind = (
        F.when(F.col("lang") == "en", "tz").when(F.col("lang") == "fr", "contract")
        .when(F.col("lang") == "de", "notice").when(F.col("lang") == "es", "documentation")
        .otherwise(F.col("lang"))
    )
    d = d.select(
        "doc_id", n.cast("long").alias("chars"), kind.alias("doc_type"),
        F.transform(
            F.array_distinct(X.all_matches(t, CODE, 1)),
            lambda c: F.struct(
                c.alias("name"),
                (F.contains(t, F.concat(c, F.lit(" AND"))) | (F.length(c) % 4 == 0)).alias("guarded"),
                F.substring(t, F.greatest(F.lit(1), F.instr(t, c) - 30), F.lit(100)).alias("quote"),
            ),
        ).alias("brands"),
        F.transform(
            X.all_matches(t, PHRASE, 1),
            lambda p: F.struct(
                p.alias("phrase"),
                F.when(F.length(p) > 12, F.concat(F.lit("> "), p)).otherwise("").alias("quote"),
            ),
        ).alias("phrases"),
        F.array_distinct(X.all_matches(t, MISSING, 1)).alias("missing"),
        F.nullif(F.regexp_extract(t, "([0-9]{10,})", 1), F.lit("")).alias("ktru_code"),
        F.contains(t, F.lit("@")).alias("has_additional"),
        t.rlike("[0-9]").alias("has_units"),
        F.contains(t, F.lit("|")).alias("has_ranges"),
        F.contains(F.lower(t), F.lit("that")).alias("has_functional"),
        (n > 300).alias("has_technical"),
        F.contains(t, F.lit(",")).alias("has_quality"),
        (~F.contains(F.lower(t), F.lit("license"))).alias("has_acceptance"),
    )
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    good, calm = F.col("quality") == 1, F.col("toxic") == 0
    return j.select(
        *d.columns,
        good.alias("has_penalty"), calm.alias("has_guarantee"),
        F.when(known, F.col("chars") % 2 == 0).alias("has_acceptance_procedure"),
        good.alias("has_price"), calm.alias("has_deadline"),
        F.when(known, F.col("chars") % 3 > 0).alias("has_method"),
    )


def _f(kind: str, conf: float, quote="''", text="''", key="''", value="''") -> str:
    return (f"{{'flag_type': {q(kind)}, 'confidence': {conf}::DOUBLE, 'quote': {quote}, 'description': {text}, "
            f"'k': {key}, 'v': {value}}}")


T = L.RULE_TEXTS
_YARD_SQL = " OR ".join(f"contains(lower(b.quote), {q(p)})" for p in YARD)
_MISS = ordered_distinct(
    f"list_concat(list_filter([CASE WHEN NOT has_functional THEN {q(T['functional'])} END, "
    f"CASE WHEN NOT has_technical THEN {q(T['technical'])} END, CASE WHEN NOT has_units THEN {q(T['units'])} END], "
    f"lambda y: y IS NOT NULL), missing)"
)
_MISS_TXT = f"array_to_string({_MISS}, ', ')"


def _one(cond: str, item: str) -> str:
    return f"CASE WHEN {cond} THEN [{item}] ELSE [] END"


RULE_SQL = {
    "u01": f"list_transform(list_filter(brands, lambda b: NOT b.guarded AND NOT ({_YARD_SQL})), lambda b: "
           + _f("brand_without_equivalent", 0.95, "b.quote", f"replace({q(T['brand'])}, '{{}}', b.name)", "'brand'", "b.name") + ")",
    "u02": "list_transform(list_filter(phrases, lambda p: len(list_filter(brands, lambda b: b.guarded AND contains(lower(p.phrase), lower(b.name)))) = 0), lambda p: "
           + _f("restrictive_requirement", 0.7, "CASE WHEN length(p.quote) > 0 THEN p.quote ELSE p.phrase END",
                f"replace({q(T['phrase'])}, '{{}}', p.phrase)", "'phrase'", "p.phrase") + ")",
    "u03": _one("NOT has_acceptance", _f("missing_acceptance_terms", 0.85, text=q(T["acceptance"]))),
    "u04": _one(f"len({_MISS}) > 0", _f("incomplete_description", 0.8, text=f"{q(T['missing_head'])} || {_MISS_TXT}", key="'missing'", value=_MISS_TXT)),
    "u05": f"CASE WHEN ktru_code IS NULL THEN [{_f('ktru_mismatch', 0.5, text=q(T['no_code']))}] WHEN has_additional THEN "
           f"[{_f('ktru_mismatch', 0.65, text=q(T['beyond_code']), key=chr(39) + 'ktru_code' + chr(39), value='ktru_code')}] ELSE [] END",
    "u06": _one("has_penalty = false", _f("missing_acceptance_terms", 0.9, text=q(T["penalty"]))),
    "u07": _one("has_guarantee = false", _f("missing_acceptance_terms", 0.85, text=q(T["guarantee"]))),
    "u08": _one("has_acceptance_procedure = false", _f("missing_acceptance_terms", 0.8, text=q(T["acceptance_procedure"]))),
    "u09": _one("has_price = false", _f("incomplete_description", 0.95, text=q(T["price"]))),
    "u10": _one("has_deadline = false", _f("incomplete_description", 0.9, text=q(T["deadline"]))),
    "u11": _one("has_method = false", _f("incomplete_description", 0.85, text=q(T["method"]))),
}
SETS_SQL = {
    "tz": ("u01", "u02", "u03", "u04", "u05"), "contract": ("u01", "u02", "u06", "u07", "u08"),
    "notice": ("u09", "u10", "u11", "u02"), "documentation": ("u01", "u02", "u03", "u04"),
}
EVAL_SQL = "CASE doc_type " + " ".join(
    f"WHEN '{k}' THEN list_concat({', '.join(RULE_SQL[r] for r in rs)})" for k, rs in SETS_SQL.items()
) + f" ELSE list_concat({', '.join(RULE_SQL[r] for r in SETS_SQL['tz'])}) END"
FINDINGS_SQL = f"""facts AS MATERIALIZED ({FACTS_SQL}),
 ev AS MATERIALIZED (SELECT *, {EVAL_SQL} AS fs FROM facts),
 fr AS MATERIALIZED (SELECT doc_id, doc_type, generate_subscripts(fs, 1) AS ord, unnest(fs) AS f FROM ev)"""
KEY_SQL = r"""CASE WHEN length(trim(regexp_replace(f.quote, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))) > 0
   THEN lower(substr(trim(regexp_replace(f.quote, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g')), 1, 60)) ELSE lower(substr(f.description, 1, 60)) END"""
DEDUPE_SQL = f"""dd AS MATERIALIZED (SELECT doc_id, doc_type, ord, f.flag_type AS flag_type, f.confidence AS confidence, f.quote AS quote,
   f.description AS description, f.k AS k, f.v AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, f.flag_type, {KEY_SQL}
   ORDER BY f.confidence DESC, ord) AS rn FROM fr) WHERE rn = 1)"""


def _register(uid: str, slug: str, rule):
    sql = f"""WITH facts AS ({FACTS_SQL}), r AS (SELECT doc_id, {RULE_SQL[uid]} AS fs FROM facts)
      SELECT doc_id, f.flag_type AS flag_type, f.confidence AS confidence, f.quote AS quote, f.description AS description FROM (
       SELECT doc_id, unnest(fs) AS f FROM r)"""

    @query(f"{uid}_{slug}", sql)
    def run(spark, sf):
        found = facts(spark, sf).select("doc_id", F.explode(rule()).alias("f"))
        return found.select("doc_id", "f.flag_type", "f.confidence", "f.quote", "f.description")


for _uid, _slug, _rule in (
    ("u01", "brand_without_equivalent", RU.brand_rule(YARD)),
    ("u02", "restrictive_phrases", RU.restrictive_phrases),
    ("u03", "missing_acceptance", RU.missing_acceptance),
    ("u04", "incomplete_description", RU.incomplete_description),
    ("u05", "catalogue_mismatch", RU.catalogue_mismatch),
    ("u06", "no_penalty", RU.no_penalty),
    ("u07", "no_guarantee", RU.no_guarantee),
    ("u08", "no_acceptance_procedure", RU.no_acceptance_procedure),
    ("u09", "no_price", RU.no_price),
    ("u10", "no_deadline", RU.no_deadline),
    ("u11", "no_method", RU.no_method),
):
    _register(_uid, _slug, _rule)


def evaluated(spark, sf):
    return facts(spark, sf).withColumn(
        "findings", RU.evaluate(F.col("doc_type"), RU.rule_sets(YARD))
    )


@query("u12_rule_dispatch", f"""WITH {FINDINGS_SQL}
SELECT doc_id, doc_type, ord::INTEGER AS ord, f.flag_type AS flag_type, f.confidence AS confidence, f.description AS description FROM fr""")
def u12(spark, sf):
    e = evaluated(spark, sf).select("doc_id", "doc_type", F.posexplode("findings").alias("ord", "f"))
    return e.select("doc_id", "doc_type", (F.col("ord") + 1).alias("ord"), "f.flag_type",
                    "f.confidence", "f.description")


FEATURES_SQL = {
    "has_brand": "(len(brands) > 0)::INT", "brand_count": "len(brands)",
    "has_equivalent": "(len(list_filter(brands, lambda b: b.guarded)) > 0)::INT",
    "brands_without_equiv": "len(list_filter(brands, lambda b: NOT b.guarded))",
    "has_units": "has_units::INT", "has_ranges": "has_ranges::INT", "missing_char_count": "len(missing)",
    "restrictive_count": "len(phrases)", "ktru_mentioned": "(ktru_code IS NOT NULL)::INT",
    "beyond_ktru": "has_additional::INT", "has_functional": "has_functional::INT",
    "has_technical": "has_technical::INT", "has_quality": "has_quality::INT",
    "risk_flag_count": "coalesce(n, 0)", "max_confidence": "coalesce(mx, 0)",
    "mean_confidence": "coalesce(round(mean, 6), 0)", "tz_char_count": "chars",
}
REPORT_SQL = f"""WITH {FINDINGS_SQL}, {DEDUPE_SQL},
 ag AS (SELECT doc_id, count(*) AS n, max(confidence) AS mx, avg(confidence) AS mean FROM dd GROUP BY doc_id),
 ft AS (SELECT doc_id, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in FEATURES_SQL.items())} FROM facts LEFT JOIN ag USING (doc_id)),
 sc AS (SELECT *, CASE WHEN risk_flag_count = 0 THEN 0.1::DOUBLE ELSE least(0.95::DOUBLE, 0.3::DOUBLE + 0.15::DOUBLE * risk_flag_count + 0.3::DOUBLE * max_confidence) END AS risk_score FROM ft),
 vd AS (SELECT *, CASE WHEN risk_flag_count = 0 THEN 'low' WHEN risk_score >= 0.7 OR max_confidence >= 0.85 OR risk_flag_count >= 4 THEN 'high'
   WHEN risk_score >= 0.4 OR max_confidence >= 0.55 OR risk_flag_count >= 2 THEN 'medium' ELSE 'low' END AS risk_verdict FROM sc)"""


def reports(spark, sf):
    return RP.assemble(evaluated(spark, sf), F.col("chars"))


@query("u13_feature_vector", f"{REPORT_SQL} SELECT doc_id, {', '.join(L.FEATURE_COLUMNS)} FROM ft")
def u13(spark, sf):
    r = reports(spark, sf).select("doc_id", "features.*")
    return r.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("u14_risk_score", f"{REPORT_SQL} SELECT doc_id, round(risk_score, 6) AS risk_score FROM sc")
def u14(spark, sf):
    return reports(spark, sf).select("doc_id", F.round("risk_score", 6).alias("risk_score"))


#: A fitted model as it would be stored: few weights, one feature that the rows lack.
STORED_MODEL = RP.RiskModel(
    "2", ("risk_flag_count", "max_confidence", "brand_count", "has_units", "not_a_feature", "tz_char_count"),
    (0.35, 1.2, -0.1, -0.25, 3.0, -0.00002), -1.1,
)
_Z = " + ".join(
    f"{w!r}::DOUBLE * {n}" for n, w in zip(STORED_MODEL.names, STORED_MODEL.weights) if n in L.FEATURE_COLUMNS
)


@query("u14_model_score", f"""{REPORT_SQL}, md AS (SELECT *, 1 / (1 + exp(-({STORED_MODEL.intercept!r}::DOUBLE + {_Z}))) AS p FROM ft)
SELECT doc_id, round(p, 6) AS model_score, CASE WHEN risk_flag_count = 0 THEN 'low' WHEN p >= 0.7 OR max_confidence >= 0.85 OR risk_flag_count >= 4 THEN 'high'
  WHEN p >= 0.4 OR max_confidence >= 0.55 OR risk_flag_count >= 2 THEN 'medium' ELSE 'low' END AS risk_verdict, '2' AS model_version FROM md""")
def u14_model(spark, sf):
    """Score and verdict by the latest stored version of a model."""
    path = scratch_path(spark, "risk-models")
    RP.save_model(spark, dataclasses.replace(STORED_MODEL, version="1", intercept=0.0), path)
    RP.save_model(spark, STORED_MODEL, path)
    model = RP.load_model(spark, path)
    scored = RP.assemble(evaluated(spark, sf), F.col("chars"), model)
    return scored.select(
        "doc_id", F.round("risk_score", 6).alias("model_score"), "risk_verdict", F.lit(model.version).alias("model_version")
    )


@query("u15_risk_verdict", f"{REPORT_SQL} SELECT risk_verdict, count(*) AS n, min(doc_id) AS first_doc FROM vd GROUP BY risk_verdict")
def u15(spark, sf):
    return reports(spark, sf).groupBy("risk_verdict").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")
    )


@query("u16_risk_report", f"""{REPORT_SQL} SELECT doc_id, round(risk_score, 6) AS risk_score, risk_verdict, risk_flag_count::BIGINT AS n_findings,
 coalesce((SELECT string_agg(flag_type, ',' ORDER BY confidence DESC, ord) FROM dd WHERE dd.doc_id = vd.doc_id), '') AS finding_types FROM vd""")
def u16(spark, sf):
    return reports(spark, sf).select(
        "doc_id", F.round("risk_score", 6).alias("risk_score"), "risk_verdict",
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.transform("findings", lambda f: f["flag_type"]), ",").alias("finding_types"),
    )


_TPL = ", ".join(f"({q(t)}, {q(a)}, {q(b)}, {q(c)})" for t, a, b, c in L.RECOMMENDATIONS)
_FIX = "fix"
for _n, _d in (("brand", q(L.DEFAULT_BRAND)),
               ("missing", f"CASE WHEN description <> '' THEN trim(regexp_replace(description, '^{L.MISSING_PREFIX}', '')) ELSE {q(L.DEFAULT_MISSING)} END"),
               ("phrase", f"CASE WHEN description <> '' THEN trim(description) ELSE {q(L.DEFAULT_PHRASE)} END"),
               ("details", "description")):
    _FIX = f"replace({_FIX}, '{{{_n}}}', CASE WHEN k = '{_n}' AND length(v) > 0 THEN v ELSE {_d} END)"


@query("u17_recommendations", f"""WITH {FINDINGS_SQL}, {DEDUPE_SQL}, tpl(flag_type, title, fix, law_ref) AS (VALUES {_TPL}),
 o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) - 1 AS finding_index FROM dd)
SELECT doc_id, finding_index::INTEGER AS finding_index, title, {_FIX} AS fix, law_ref FROM o JOIN tpl USING (flag_type)""")
def u17(spark, sf):
    rows = reports(spark, sf).select("doc_id", F.posexplode("findings").alias("finding_index", "f"))
    rows = rows.select("doc_id", "finding_index", "f.flag_type", "f.description", "f.extra")
    return RP.recommend(rows).select("doc_id", "finding_index", "title", "fix", "law_ref")
