"""G*: aggregations and report tables; M* counts and scores."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clauseflow import lexicon as L
from clauseflow.functions import text as X
from clauseflow.functions.scalar import ratio
from clauseflow.lexicon import NEUTRAL as N
from clauseflow.operators import matching as M, metrics as G
from clauseflow.operators.windows import top_per_group
from clauseflow.plans.base import (
    NEG, POS, documents, episodes, findings_of_both, flags, gold, quoted, records, with_ctes,
)
from clauseflow.plans.extraction import entity_sql
from clauseflow.plans.projections import CLUSTER_STATS_SQL, FAMILY_SQL, STATUS_SQL, families
from clauseflow.plans.registry import query, table

q = quoted
SPEC = ", ".join(q(t) for t in L.SPECIFIC_TYPES)


def r6(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0::DOUBLE END)"


P_, R_ = div("matched", "pred"), div("matched", "gold")
F1_ = div(f"2 * {P_} * {R_}", f"{P_} + {R_}")
PRF_SQL = f"{r6(P_)} AS precision, {r6(R_)} AS recall, {r6(F1_)} AS f1"


def binary_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    n = f"({tp} + {fp} + {fn} + {tn})"
    acc = div(f"{tp} + {tn}", n)
    f1p = div(f"2.0 * {tp}", f"2 * {tp} + {fp} + {fn}")
    f1n = div(f"2.0 * {tn}", f"2 * {tn} + {fp} + {fn}")
    gp, pp = div(f"{tp} + {fn}", n), div(f"{tp} + {fp}", n)
    pe = f"({gp} * {pp} + (1 - {gp}) * (1 - {pp}))"
    return {
        "accuracy": acc, "f1_pos": f1p, "f1_neg": f1n, "f1_macro": f"({f1p} + {f1n}) / 2",
        "kappa": div(f"{acc} - {pe}", f"1 - {pe}"),
    }


BIN_SQL = ", ".join(f"{r6(e)} AS {n}" for n, e in binary_sql().items())
CONF = f"""count(*) FILTER (verdict = '{POS}' AND pred = '{POS}') AS tp,
  count(*) FILTER (verdict = '{NEG}' AND pred = '{POS}') AS fp,
  count(*) FILTER (verdict = '{POS}' AND pred = '{NEG}') AS fn,
  count(*) FILTER (verdict = '{NEG}' AND pred = '{NEG}') AS tn"""


def fact_sql(mode: str, by: str = "stratum") -> str:
    s = "_specific" if mode == "specific" else ""
    return with_ctes("records", f"""
    SELECT {by}, episodes, matched, gold, pred, {PRF_SQL} FROM (
     SELECT CASE WHEN grouping({by}) = 1 THEN 'pooled' ELSE {by}::VARCHAR END AS {by}, count(*) AS episodes,
      sum(matched{s})::BIGINT AS matched, sum(n_gold{s})::BIGINT AS gold, sum(n_pred{s})::BIGINT AS pred
     FROM records WHERE verdict = '{POS}' GROUP BY GROUPING SETS (({by}), ()))""")


@query("g01_fact_pr", fact_sql("specific"))
def g01(spark, sf):
    return G.fact_pr(records(spark, sf), mode="specific")


@query("g01_fact_pr_all_types", fact_sql("all"))
def g01_all(spark, sf):
    return G.fact_pr(records(spark, sf), mode="all")


def episode_sql(pred: str) -> str:
    return with_ctes("records", f"""
    SELECT stratum, tp, fp, fn, tn, {BIN_SQL} FROM (
     SELECT CASE WHEN grouping(stratum) = 1 THEN 'pooled' ELSE stratum END AS stratum, {CONF}
     FROM (SELECT *, {pred} AS pred FROM records) GROUP BY GROUPING SETS ((stratum), ()))""")


@query("g02_episode_metrics", episode_sql("pred_strict"))
def g02(spark, sf):
    return G.episode_metrics(records(spark, sf), "pred_strict")


@query("g02_episode_metrics_loose", episode_sql("pred_loose"))
def g02_loose(spark, sf):
    return G.episode_metrics(records(spark, sf), "pred_loose")


# prediction levels: subsets of the flag types, as in a knowledge ladder
LEVELS = {
    "L0": ("brand_without_equivalent",),
    "L1": L.SPECIFIC_TYPES,
    "A3": ("restrictive_requirement", "ktru_mismatch", "missing_acceptance_terms"),
}
LEVEL_SQL = " UNION ALL ".join(
    f"SELECT '{lv}' AS level, * FROM flags WHERE flag_type IN ({', '.join(q(t) for t in ts)})"
    for lv, ts in LEVELS.items()
)


def level_flags(spark, sf):
    """Flags repeated for each level that keeps their type (at most three copies)."""
    kept = F.filter(
        F.array(*[F.when(F.col("flag_type").isin(*ts), F.lit(lv)) for lv, ts in LEVELS.items()]),
        F.isnotnull,
    )
    return flags(spark, sf).withColumn("level", F.explode(kept))


def level_gold(spark, sf):
    g = gold(spark, sf).where(F.col("severity") == "established")
    return g.withColumn("level", F.explode(F.array(*[F.lit(lv) for lv in LEVELS])))


LEVEL_COUNTS_SQL = f"""
  lf AS ({LEVEL_SQL}), lg AS (SELECT level, g.* FROM gold g, (VALUES ('L0'), ('L1'), ('A3')) v(level)
   WHERE severity = 'established'),
  lc AS (SELECT level, doc_id, ftype, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS pred, least(sum(g), sum(p))::BIGINT AS matched
   FROM (SELECT level, doc_id, finding_type AS ftype, 1 AS g, 0 AS p FROM lg
     UNION ALL SELECT level, doc_id, flag_type, 0, 1 FROM lf) GROUP BY ALL)"""


def level_counts(spark, sf):
    return M.type_counts(level_gold(spark, sf), level_flags(spark, sf), ["level", "doc_id"])


@query("g03_brand_ladder", with_ctes("gold flags episodes", f"""
WITH {LEVEL_COUNTS_SQL}
SELECT level, matched, gold, pred, {PRF_SQL} FROM (
  SELECT level, sum(matched)::BIGINT AS matched, sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred
  FROM lc JOIN episodes USING (doc_id) WHERE verdict = '{POS}' AND ftype = 'brand_without_equivalent' GROUP BY level)"""))
def g03(spark, sf):
    pos = episodes(spark, sf).where(F.col("verdict") == POS).select("doc_id")
    c = level_counts(spark, sf).where(F.col("ftype") == "brand_without_equivalent")
    a = c.join(pos, "doc_id").groupBy("level").agg(
        *[F.sum(x).alias(x) for x in ("matched", "gold", "pred")]
    )
    return a.select("level", "matched", "gold", "pred",
                    *G.rounded(G.prf(F.col("matched"), F.col("gold"), F.col("pred"))))


#: ASCII letters and digits and their full-width forms, which NFKC folds back.
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
WIDE = "".join(chr(ord(c) + 0xFEE0) for c in PLAIN)
_NQ = r"trim(regexp_replace(lower(translate(%s, '" + WIDE + r"', '" + PLAIN + r"')), '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))"
#: Citations as a reader might write them: as they stand, in full-width forms, in capitals with
#: wider spaces, or with a word that the document lacks.
CITED_SQL = f"""CASE ('0x' || md5(concat_ws(':', doc_id, type_ord, idx))[1])::BIGINT % 4
  WHEN 1 THEN translate(quote, '{PLAIN}', '{WIDE}') WHEN 2 THEN quote || ' ' || md5(quote)
  WHEN 3 THEN replace(translate(quote, '{PLAIN[26:52]}', '{PLAIN[:26]}'), ' ', '  ') ELSE quote END"""
CONTAIN_SQL = f"""SELECT g.*, contains({_NQ % 'd.text'}, {_NQ % 'g.cited'}) AND length({_NQ % 'g.cited'}) > 0 AS hit
   FROM (SELECT *, {CITED_SQL} AS cited FROM gold) g JOIN documents d USING (doc_id)"""


def cited(doc, x):
    """The citation of a finding ``x``, see ``CITED_SQL``."""
    q = x["quote"]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", doc, x["type_ord"], x["idx"])), 1, 1), 16, 10).cast("int") % 4
    shouted = F.replace(F.translate(q, PLAIN[26:52], PLAIN[:26]), F.lit(" "), F.lit("  "))
    return (
        F.when(draw == 1, F.translate(q, PLAIN, WIDE))
        .when(draw == 2, F.concat(q, F.lit(" "), F.md5(q)))
        .when(draw == 3, shouted)
        .otherwise(q)
    )


def exact_hits(spark, sf):
    """Gold findings with the exact part of citation containment in their own document.

    Findings, citations and the test share the document's row; texts are neither joined nor
    copied for each finding, and NFKC runs once over all citations of a document.
    """
    t = F.col("text")
    d = documents(spark, sf, "doc_id", "text").select(
        "doc_id", "text", X.pack_findings(t, N.gold, "finding_type").alias("g")
    )
    # texts without a finding are nothing to normalise, nor do they leave the JVM
    # a line feed joins the citations: normalisation keeps it apart from none of them
    each = F.transform("g", lambda x: cited(F.col("doc_id"), x))
    d = d.select("doc_id", "g", X.normalize_text(F.when(F.size("g") > 0, t), compat=True).alias("t"), each.alias("cited"))
    d = d.withColumn("q", X.normalize_each(F.col("cited")))
    # as the argument of a lambda the text is evaluated once a row
    hits = F.when(
        F.size("q") > 0,
        F.get(
            F.transform(F.array("t"), lambda t: F.transform("q", lambda q: (F.length(q) > 0) & F.contains(t, q))),
            F.lit(0),
        ),
    )
    found = d.select("doc_id", F.explode(F.arrays_zip("g", hits.alias("hit"))).alias("z")).select(
        "doc_id", "z.g.*", "z.hit"
    )
    sev = table(spark, sf, "labels").select(
        "doc_id",
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit("established"))
        .otherwise(F.lit("not_established")).alias("severity"),
    )
    return found.join(sev, "doc_id")


@query("g04_citation_rates", with_ctes("gold", f"""
SELECT severity, count(*) AS n, count(*) FILTER (hit) AS contained, {r6('avg(hit::INT)')} AS rate,
  {r6('1 - avg(hit::INT)')} AS hallucination, count(*) FILTER (trim(quote) = '') AS empty_quotes
FROM ({CONTAIN_SQL}) GROUP BY severity"""))
def g04(spark, sf):
    rate = F.avg(F.col("hit").cast("int"))
    return exact_hits(spark, sf).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("contained"),
        F.round(rate, 6).alias("rate"), F.round(1 - rate, 6).alias("hallucination"),
        F.count_if(F.trim("quote") == "").alias("empty_quotes"),
    )


# cosine of every quote vector with its cluster centroid: a similarity per row
SIM_SQL = """
  x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
  cn AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-12) AS nrm FROM c GROUP BY label),
  sim AS (SELECT x.vec_id, any_value(x.label)::BIGINT AS cluster_id, round(sum(x.v * c.m) / any_value(cn.nrm), 6) AS sim
    FROM x JOIN c ON x.label = c.label AND x.i = c.i JOIN cn ON cn.label = x.label GROUP BY x.vec_id)"""


def centroid_similarity(spark, sf):
    from clauseflow.operators.vectors import similarity_to_centroid

    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("cluster_id"), "embedding"
    )
    return similarity_to_centroid(e, "cluster_id", "embedding").withColumn(
        "sim", F.round("sim", 6)
    )


@query("g05_score_distribution", f"""
WITH {SIM_SQL}, o AS (SELECT sim, row_number() OVER (ORDER BY sim) AS rn, count(*) OVER () AS n FROM sim)
SELECT count(*) AS n, {r6('avg(sim)')} AS mean, {r6('median(sim)')} AS median,
  max(sim) FILTER (rn = n // 10 + 1) AS p10, max(sim) FILTER (rn = n * 9 // 10 + 1) AS p90,
  count(*) FILTER (sim >= 0.5) AS ge_5, count(*) FILTER (sim >= 0.6) AS ge_6,
  count(*) FILTER (sim >= 0.7) AS ge_7, count(*) FILTER (sim >= 0.8) AS ge_8 FROM o""")
def g05(spark, sf):
    s = centroid_similarity(spark, sf).select("sim")
    marks = {
        "p10": G.floor_rank(1, 10), "p90": G.floor_rank(9, 10),
        "_m1": F.floor((F.col("n") + 1) / 2), "_m2": F.floor((F.col("n") + 2) / 2),
    }
    one = s.withColumn("all", F.lit(1))
    order = G.positional(one, ["all"], "sim", marks)
    base = one.groupBy("all").agg(
        F.round(F.avg("sim"), 6).alias("mean"),
        *[F.count_if(F.col("sim") >= t / 10).alias(f"ge_{t}") for t in (5, 6, 7, 8)],
    )
    return order.join(base, "all").select(
        "n", "mean", F.round((F.col("_m1") + F.col("_m2")) / 2, 6).alias("median"),
        "p10", "p90", "ge_5", "ge_6", "ge_7", "ge_8",
    )


@query("g06_containment_by_type", with_ctes("gold", f"""
SELECT finding_type, count(*) AS n, {r6('avg(hit::INT)')} AS rate FROM ({CONTAIN_SQL})
GROUP BY finding_type ORDER BY n DESC, finding_type"""))
def g06(spark, sf):
    return exact_hits(spark, sf).groupBy("finding_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate")
    ).orderBy(F.desc("n"), "finding_type")


@query("g07_family_diagnostic", with_ctes("records", f"""
SELECT cluster_id, stratum, n, matched, gold, pred, {PRF_SQL}, accuracy, positives FROM (
 SELECT cluster_id, min(stratum) AS stratum, count(*) AS n,
  coalesce(sum(matched_specific) FILTER (verdict = '{POS}'), 0)::BIGINT AS matched,
  coalesce(sum(n_gold_specific) FILTER (verdict = '{POS}'), 0)::BIGINT AS gold,
  coalesce(sum(n_pred_specific) FILTER (verdict = '{POS}'), 0)::BIGINT AS pred,
  {r6('avg((verdict = pred_strict)::INT)')} AS accuracy, count(*) FILTER (verdict = '{POS}') AS positives
 FROM records GROUP BY cluster_id)"""))
def g07(spark, sf):
    pos = F.col("verdict") == POS
    rank = F.when(F.col("stratum") == "en", 0).when(F.col("stratum") == "fr", 1).otherwise(9)
    a = records(spark, sf).groupBy("cluster_id").agg(
        F.min("stratum").alias("stratum"), F.count(F.lit(1)).alias("n"),
        *[
            F.coalesce(F.sum(F.when(pos, F.col(src))), F.lit(0)).cast("long").alias(out)
            for src, out in (("matched_specific", "matched"), ("n_gold_specific", "gold"),
                             ("n_pred_specific", "pred"))
        ],
        F.round(F.avg((F.col("verdict") == F.col("pred_strict")).cast("int")), 6).alias("accuracy"),
        F.count_if(pos).alias("positives"),
    )
    return a.select(
        "cluster_id", "stratum", "n", "matched", "gold", "pred",
        *G.rounded(G.prf(F.col("matched"), F.col("gold"), F.col("pred"))), "accuracy", "positives",
    ).orderBy(rank, "cluster_id")


@query("g08_threshold_sweep", f"""
WITH {SIM_SQL}, t(threshold) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in L.SIMILARITY_STEPS)}),
e AS (SELECT s.sim, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS is_gold FROM sim s JOIN documents d ON d.doc_id = s.vec_id)
SELECT threshold, matched, gold, pred, {PRF_SQL} FROM (
 SELECT threshold, count(*) FILTER (sim >= threshold AND is_gold = 1) AS matched,
  sum(is_gold)::BIGINT AS gold, count(*) AS pred FROM e, t GROUP BY threshold)""")
def g08(spark, sf):
    """Kept pairs per threshold over constant denominators, in one pass over the pairs."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    e = centroid_similarity(spark, sf).join(d, "vec_id")
    gold_ = F.col("lang") == "en"
    kept = [
        F.count_if((F.col("sim") >= t) & gold_).alias(f"k{i}")
        for i, t in enumerate(L.SIMILARITY_STEPS)
    ]
    one = e.agg(F.count_if(gold_).alias("gold"), F.count(F.lit(1)).alias("pred"), *kept)
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("matched"))
            for i, t in enumerate(L.SIMILARITY_STEPS)
        ]
    )
    return one.select("gold", "pred", F.inline(rows)).select(
        "threshold", "matched", "gold", "pred",
        *G.rounded(G.prf(F.col("matched"), F.col("gold"), F.col("pred"))),
    )


TIER_OF_CHARS = "CASE WHEN char_count < 1000 THEN 'thin' WHEN char_count < 3000 THEN 'normal' ELSE 'chunking_risk' END"


@query("g09_recall_by_tier", with_ctes("records", f"""
WITH p AS (SELECT {TIER_OF_CHARS} AS tier, round(matched_specific / n_gold_specific::DOUBLE, 6) AS recall, char_count
   FROM records WHERE n_gold_specific > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY recall) AS rn, count(*) OVER (PARTITION BY tier) AS n FROM p)
SELECT tier, count(*) AS n, {r6('avg(recall)')} AS mean, max(recall) FILTER (rn = n // 2 + 1) AS median,
 max(recall) FILTER (rn = CASE WHEN n >= 4 THEN n // 4 + 1 ELSE 1 END) AS p25,
 max(recall) FILTER (rn = CASE WHEN n >= 4 THEN n * 3 // 4 + 1 ELSE n END) AS p75,
 floor(avg(char_count))::BIGINT AS mean_chars FROM o GROUP BY tier"""))
def g09(spark, sf):
    c = F.col("char_count")
    tier = F.when(c < 1000, "thin").when(c < 3000, "normal").otherwise("chunking_risk")
    p = records(spark, sf).where(F.col("n_gold_specific") > 0).select(
        tier.alias("tier"),
        F.round(F.col("matched_specific") / F.col("n_gold_specific"), 6).alias("recall"),
        "char_count",
    )
    few = F.col("n") < 4
    order = G.positional(p, ["tier"], "recall", {
        "median": G.floor_rank(1, 2),
        "p25": F.when(few, F.lit(1)).otherwise(G.floor_rank(1, 4)),
        "p75": F.when(few, F.col("n")).otherwise(G.floor_rank(3, 4)),
    })
    base = p.groupBy("tier").agg(
        F.round(F.avg("recall"), 6).alias("mean"),
        F.floor(F.avg("char_count")).alias("mean_chars"),
    )
    return order.join(base, "tier").select("tier", "n", "mean", "median", "p25", "p75", "mean_chars")


UNMATCHED_SQL = f"""SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY g.doc_id, g.finding_type ORDER BY g.idx) AS rn,
   CASE WHEN g.finding_type IN ({SPEC}) THEN greatest(0, t.g - t.p) ELSE t.g END AS n_open
   FROM gold g JOIN type_counts t ON t.doc_id = g.doc_id AND t.ftype = g.finding_type
   WHERE g.severity = 'established') WHERE rn <= n_open"""


def unmatched(spark, sf):
    """Established findings left over: the first max(0, gold - predicted) of each type."""
    g = gold(spark, sf).where(F.col("severity") == "established")
    c = M.type_counts(g, flags(spark, sf), ["doc_id"]).withColumnRenamed("ftype", "finding_type")
    open_ = F.when(
        F.col("finding_type").isin(*L.SPECIFIC_TYPES),
        F.greatest(F.lit(0), F.col("gold") - F.col("pred")),
    ).otherwise(F.col("gold"))
    need = c.where(F.col("gold") > 0).select("doc_id", "finding_type", open_.alias("n_open"))
    w = Window.partitionBy("doc_id", "finding_type").orderBy("idx")
    return (
        g.join(need.where(F.col("n_open") > 0), ["doc_id", "finding_type"])
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= F.col("n_open"))
    )


@query("g10_error_typology", with_ctes("type_counts gold", f"""
WITH u AS ({UNMATCHED_SQL}), h AS (SELECT u.finding_type, CASE WHEN u.finding_type = 'other' THEN 'granularity_mismatch'
  WHEN trim(u.quote) = '' THEN 'context_gap' WHEN contains({_NQ % 'd.text'}, {_NQ % 'u.quote'}) THEN 'extraction_miss'
  ELSE 'context_gap' END AS error_type FROM u JOIN documents d USING (doc_id))
SELECT CASE WHEN grouping(finding_type) = 1 THEN 'all' ELSE finding_type END AS finding_type, error_type, count(*) AS n
FROM h GROUP BY GROUPING SETS ((finding_type, error_type), (error_type))"""))
def g10(spark, sf):
    """Typology without moving a text: findings, open counts and the quote test share the row."""
    t = F.col("text")
    flag_patterns = {p.finding_type: p for p in N.flags}

    def left_over(p):
        """First max(0, gold - predicted) findings of a type (all of them for ``other``)."""
        found = F.col(f"m_{p.finding_type}")
        if p.finding_type in L.SPECIFIC_TYPES:
            seen = X.pattern_count(t, flag_patterns[p.finding_type])
            found = F.slice(found, F.lit(1), F.greatest(F.lit(0), F.size(found) - seen))
        return F.transform(
            found, lambda x: F.struct(F.lit(p.finding_type).alias("finding_type"), x.alias("quote"))
        )

    # matches become columns first, so each pattern runs once over the text
    m = documents(spark, sf, "doc_id", "text").select(
        "doc_id", "text",
        *[X.pattern_matches(t, p).alias(f"m_{p.finding_type}") for p in N.gold],
    )
    m = m.select("doc_id", "text", F.concat(*[left_over(p) for p in N.gold]).alias("open"))
    # the quotes are tested inside the row: an explode would copy the text per finding
    m = m.select(
        "doc_id", X.normalize_text(F.when(F.size("open") > 0, t), compat=True).alias("t"), "open",
        X.normalize_each(F.transform("open", lambda o: o["quote"])).alias("q"),
    )
    m = M.contained_each(m, "t", "q", "hits").select("doc_id", "open", "hits")
    u = m.select("doc_id", F.explode(F.arrays_zip("open", "hits")).alias("z")).select(
        "doc_id", "z.open.finding_type", "z.open.quote", F.col("z.hits").alias("hit")
    )
    sev = table(spark, sf, "labels").where((F.col("quality") == 0) | (F.col("toxic") == 1))
    u = u.join(sev.select("doc_id"), "doc_id")
    kind = (
        F.when(F.col("finding_type") == "other", "granularity_mismatch")
        .when(F.col("hit") & (F.trim("quote") != ""), "extraction_miss")
        .otherwise("context_gap")
    )
    h = u.select("finding_type", kind.alias("error_type"))
    g = h.groupingSets(
        [[F.col("finding_type"), F.col("error_type")], [F.col("error_type")]],
        F.col("finding_type"), F.col("error_type"),
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping("finding_type").alias("_all"))
    return g.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("finding_type")).alias("finding_type"),
        "error_type", "n",
    )


@query("g11_tier_by_stratum", with_ctes("episodes", f"""
SELECT tier, count(*) FILTER (stratum = 'en') AS en, count(*) FILTER (stratum = 'fr') AS fr,
  count(*) FILTER (stratum = 'de') AS de, count(*) FILTER (stratum NOT IN ('en','fr','de')) AS other, count(*) AS total
FROM (SELECT {TIER_OF_CHARS} AS tier, stratum FROM episodes) GROUP BY tier"""))
def g11(spark, sf):
    c = F.col("char_count")
    tier = F.when(c < 1000, "thin").when(c < 3000, "normal").otherwise("chunking_risk")
    named = ("en", "fr", "de")
    return episodes(spark, sf).groupBy(tier.alias("tier")).agg(
        *[F.count_if(F.col("stratum") == s).alias(s) for s in named],
        F.count_if(~F.col("stratum").isin(*named)).alias("other"),
        F.count(F.lit(1)).alias("total"),
    )


@query("g12_top_values", with_ctes("flags episodes", """
WITH v AS (SELECT cluster_id, 'stratum' AS field, stratum AS value FROM episodes
  UNION ALL SELECT cluster_id, 'flag_type', flag_type FROM episodes JOIN flags USING (doc_id)),
c AS (SELECT cluster_id, field, value, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, field ORDER BY n DESC, value) AS rn FROM c)
SELECT cluster_id, field, string_agg(value || '=' || n, ';' ORDER BY rn) AS top FROM r WHERE rn <= 3 GROUP BY ALL"""))
def g12(spark, sf):
    e = episodes(spark, sf).select("doc_id", "cluster_id", "stratum")
    v = e.select("cluster_id", F.lit("stratum").alias("field"), F.col("stratum").alias("value"))
    f = flags(spark, sf).select("doc_id", "flag_type").join(e.select("doc_id", "cluster_id"), "doc_id")
    v = v.unionByName(f.select("cluster_id", F.lit("flag_type").alias("field"), F.col("flag_type").alias("value")))
    from clauseflow.operators.taxonomy import top_values

    return top_values(v, ["cluster_id", "field"], "value", 3)


@query("g13_extraction_qc", f"""
WITH d AS (SELECT conv_id, count(*) AS n, max((text IS NULL)::INT) AS bad FROM conversations GROUP BY conv_id)
SELECT (SELECT count(*) FROM d) AS decision_rows, (SELECT count(*) FROM conversations) AS episode_rows,
 (SELECT round(1 - sum(bad) / count(*), 4)::DOUBLE FROM d) AS valid_rate,
 (SELECT median(n)::DOUBLE FROM d) AS median_episodes, (SELECT quantile_disc(n, 0.95) FROM d) AS p95_episodes,
 (SELECT max(n) FROM d) AS max_episodes, (SELECT count(*) FROM conversations WHERE length(text) < 80) AS too_short,
 (SELECT count(*) FROM conversations WHERE length(text) > 900) AS too_long,
 (SELECT count(*) FROM conversations WHERE role = 'user') AS user_rows""")
def g13(spark, sf):
    c = table(spark, sf, "conversations")
    per = c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("text").isNull().cast("int")).alias("bad"),
        F.count_if(F.length("text") < 80).alias("short"),
        F.count_if(F.length("text") > 900).alias("long"),
        F.count_if(F.col("role") == "user").alias("users"),
    )
    # episode counts take few distinct values, so the order statistics run on a histogram
    return per.agg(
        F.count(F.lit(1)).alias("decision_rows"), F.sum("n").alias("episode_rows"),
        F.round(1 - F.sum("bad") / F.count(F.lit(1)), 4).alias("valid_rate"),
        F.median("n").alias("median_episodes"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95_episodes"),
        F.max("n").alias("max_episodes"), F.sum("short").alias("too_short"),
        F.sum("long").alias("too_long"), F.sum("users").alias("user_rows"),
    )


SANITY_SQL = f"""SELECT count(*) AS n, count(*) FILTER (n_gold = 0) AS empty_findings,
   count(*) FILTER (n_gold = 0 AND verdict = '{POS}') AS empty_violations, count(*) FILTER (verdict = '{POS}') AS n_violations,
   count(*) FILTER (verdict = (CASE WHEN n_gold > 0 THEN '{POS}' ELSE '{NEG}' END)) AS agreement FROM records"""


def sanity(spark, sf):
    overall = F.when(F.col("n_gold") > 0, POS).otherwise(NEG)
    return records(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_gold") == 0).alias("empty_findings"),
        F.count_if((F.col("n_gold") == 0) & (F.col("verdict") == POS)).alias("empty_violations"),
        F.count_if(F.col("verdict") == POS).alias("n_violations"),
        F.count_if(F.col("verdict") == overall).alias("agreement"),
    )


@query("g14_findings_sanity", with_ctes("records gold", f"""
WITH s AS ({SANITY_SQL}) SELECT 'empty_rate' AS item, {r6(div('empty_findings', 'n'))} AS value FROM s
UNION ALL SELECT 'empty_rate_violations', {r6(div('empty_violations', 'n_violations'))} FROM s
UNION ALL SELECT 'agreement', {r6(div('agreement', 'n'))} FROM s
UNION ALL SELECT 'type:' || finding_type, count(*)::DOUBLE FROM gold GROUP BY finding_type
UNION ALL SELECT 'severity:' || severity, count(*)::DOUBLE FROM gold GROUP BY severity"""))
def g14(spark, sf):
    s = sanity(spark, sf)
    pairs = F.array(
        *[
            F.struct(F.lit(k).alias("item"), F.round(ratio(F.col(a), F.col(b)), 6).alias("value"))
            for k, a, b in (
                ("empty_rate", "empty_findings", "n"),
                ("empty_rate_violations", "empty_violations", "n_violations"),
                ("agreement", "agreement", "n"),
            )
        ]
    )
    g = gold(spark, sf)
    tags = F.explode(
        F.array(F.concat(F.lit("type:"), "finding_type"), F.concat(F.lit("severity:"), "severity"))
    )
    counts = g.select(tags.alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return s.select(F.inline(pairs)).unionByName(counts)


def stop_reason(n, violations, empty_violations, agreement):
    """Stop reason of the quality gate, null when the run may go on."""
    empty = ratio(empty_violations, violations)
    agree = ratio(agreement, n)
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    return F.when(
        (violations >= 5) & (empty > 0.30),
        F.concat(F.lit("empty_findings on "), pct(empty), F.lit(" of violation episodes")),
    ).when((n >= 5) & (agree < 0.70), F.concat(F.lit("verdict agreement "), pct(agree), F.lit(" < 70%")))


@query("g15_quality_gate", with_ctes("records", f"""
WITH s AS ({SANITY_SQL}), p AS (SELECT count(*) AS n_out, count(DISTINCT pred_strict) AS classes FROM records)
SELECT CASE WHEN n_violations >= 5 AND {div('empty_violations', 'n_violations')} > 0.30
   THEN 'empty_findings on ' || printf('%.1f%%', {div('empty_violations', 'n_violations')} * 100) || ' of violation episodes'
  WHEN n >= 5 AND {div('agreement', 'n')} < 0.70 THEN 'verdict agreement ' || printf('%.1f%%', {div('agreement', 'n')} * 100) || ' < 70%'
  END AS stop_reason, n_out >= 30 AND classes = 1 AS degenerate FROM s, p"""))
def g15(spark, sf):
    overall = F.when(F.col("n_gold") > 0, POS).otherwise(NEG)
    a = records(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("n_gold") == 0) & (F.col("verdict") == POS)).alias("ev"),
        F.count_if(F.col("verdict") == POS).alias("v"),
        F.count_if(F.col("verdict") == overall).alias("ag"),
        F.count_if(F.col("pred_strict") == POS).alias("p"),
    )
    one_class = (F.col("p") == 0) | (F.col("p") == F.col("n"))
    return a.select(
        stop_reason(F.col("n"), F.col("v"), F.col("ev"), F.col("ag")).alias("stop_reason"),
        ((F.col("n") >= 30) & one_class).alias("degenerate"),
    )


@query("g16_flag_rates", with_ctes("records", f"""
WITH r AS (SELECT stratum, cluster_id, {TIER_OF_CHARS} AS tier, n_pred, char_count FROM records)
SELECT CASE WHEN grouping(stratum) = 0 THEN 'stratum' WHEN grouping(cluster_id) = 0 THEN 'cluster' ELSE 'tier' END AS dim,
  coalesce(stratum, cluster_id::VARCHAR, tier) AS value, count(*) AS n, count(*) FILTER (n_pred > 0) AS with_flags,
  {r6('avg((n_pred > 0)::INT)')} AS flag_rate, {r6('avg(char_count)')} AS mean_chars
FROM r GROUP BY GROUPING SETS ((stratum), (cluster_id), (tier))"""))
def g16(spark, sf):
    c = F.col("char_count")
    tier = F.when(c < 1000, "thin").when(c < 3000, "normal").otherwise("chunking_risk")
    r = records(spark, sf).select(
        "stratum", F.col("cluster_id").cast("string").alias("cluster"), tier.alias("tier"),
        "n_pred", "char_count",
    )
    dims = [F.col(x) for x in ("stratum", "cluster", "tier")]
    return r.groupingSets([[d] for d in dims], *dims).agg(
        F.when(F.grouping("stratum") == 0, "stratum").when(F.grouping("cluster") == 0, "cluster")
        .otherwise("tier").alias("dim"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_pred") > 0).alias("with_flags"),
        F.round(F.avg((F.col("n_pred") > 0).cast("int")), 6).alias("flag_rate"),
        F.round(F.avg("char_count"), 6).alias("mean_chars"),
    ).select("dim", F.coalesce("stratum", "cluster", "tier").alias("value"), "n", "with_flags",
             "flag_rate", "mean_chars")


@query("g16_flag_types", with_ctes("flags", f"""
WITH o AS (SELECT flag_type, confidence, row_number() OVER (PARTITION BY flag_type ORDER BY confidence) AS rn,
   count(*) OVER (PARTITION BY flag_type) AS n FROM flags)
SELECT flag_type, count(*) AS n, {r6('avg(confidence)')} AS mean_conf, max(confidence) FILTER (rn = n // 10 + 1) AS p10,
  max(confidence) FILTER (rn = n * 9 // 10 + 1) AS p90 FROM o GROUP BY flag_type"""))
def g16_types(spark, sf):
    f = flags(spark, sf).select("flag_type", "confidence")
    order = G.positional(f, ["flag_type"], "confidence",
                         {"p10": G.floor_rank(1, 10), "p90": G.floor_rank(9, 10)})
    mean = f.groupBy("flag_type").agg(F.round(F.avg("confidence"), 6).alias("mean_conf"))
    return order.join(mean, "flag_type").select("flag_type", "n", "mean_conf", "p10", "p90")


@query("g17_usage_rollup", """
SELECT coalesce(event_type, 'TOTAL') AS detector, coalesce(status, 'ALL') AS status, count(*) AS n_calls,
  sum(tok)::BIGINT AS tokens, round(sum(cents) / 100.0::DOUBLE, 2) AS cost,
  CASE WHEN grouping(event_type) = 1 THEN round(100000.0::DOUBLE - sum(cents) / 100.0::DOUBLE, 2) END AS remaining
FROM (SELECT event_type, CASE WHEN value < 10 THEN 'ok' ELSE 'parse_failed' END AS status,
   round(value * 100)::BIGINT AS cents, length(props) AS tok FROM events) GROUP BY ROLLUP (event_type, status)""")
def g17(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type",
        F.when(F.col("value") < 10, "ok").otherwise("parse_failed").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), F.length("props").alias("tok"),
    )
    cost = F.sum("cents") / 100.0
    return e.rollup("event_type", "status").agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("tok").alias("tokens"),
        F.round(cost, 2).alias("cost"),
        F.when(F.grouping("event_type") == 1, F.round(100000.0 - cost, 2)).alias("remaining"),
    ).select(F.coalesce("event_type", F.lit("TOTAL")).alias("detector"),
             F.coalesce("status", F.lit("ALL")).alias("status"), "n_calls", "tokens", "cost", "remaining")


@query("g18_recall_matrix", with_ctes("gold flags episodes", f"""
WITH {LEVEL_COUNTS_SQL}, r AS (SELECT ftype, level, {r6(div('sum(matched)', 'sum(gold)'))} AS recall
 FROM lc JOIN episodes USING (doc_id) WHERE verdict = '{POS}' AND ftype IN ({SPEC}) GROUP BY ftype, level)
SELECT ftype AS finding_type, max(recall) FILTER (level = 'L0') AS "L0", max(recall) FILTER (level = 'L1') AS "L1",
  max(recall) FILTER (level = 'A3') AS "A3" FROM r GROUP BY ftype"""))
def g18(spark, sf):
    pos = episodes(spark, sf).where(F.col("verdict") == POS).select("doc_id")
    c = level_counts(spark, sf).where(F.col("ftype").isin(*L.SPECIFIC_TYPES)).join(pos, "doc_id")
    recall = F.round(ratio(F.sum("matched"), F.sum("gold")), 6)
    return (
        c.groupBy(F.col("ftype").alias("finding_type"), "level").agg(recall.alias("r"))
        .groupBy("finding_type").pivot("level", list(LEVELS)).agg(F.max("r"))
    )


@query("g19_detector_or", with_ctes("flags", """
SELECT d.doc_id, CASE WHEN bool_or(coalesce(f.confidence, 0) >= 0.8) THEN 'violation' ELSE 'not_established' END AS verdict,
  count(DISTINCT flag_type) FILTER (f.confidence >= 0.8) AS n_detectors,
  coalesce(sum(length(quote)), 0)::BIGINT AS tokens FROM documents d LEFT JOIN flags f USING (doc_id) GROUP BY d.doc_id"""))
def g19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    f = flags(spark, sf).groupBy("doc_id").agg(
        F.bool_or(F.col("confidence") >= 0.8).alias("hit"),
        F.count_distinct(F.when(F.col("confidence") >= 0.8, F.col("flag_type"))).alias("nd"),
        F.sum(F.length("quote")).alias("tok"),
    )
    return d.join(f, "doc_id", "left").select(
        "doc_id", F.when(F.col("hit"), "violation").otherwise("not_established").alias("verdict"),
        F.coalesce("nd", F.lit(0)).alias("n_detectors"), F.coalesce("tok", F.lit(0)).alias("tokens"),
    )


@query("g23_variant_delta", with_ctes("gold flags episodes", f"""
WITH {LEVEL_COUNTS_SQL}, a AS (SELECT level, sum(matched)::BIGINT AS matched, sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred
  FROM lc JOIN episodes USING (doc_id) WHERE verdict = '{POS}' AND ftype IN ({SPEC}) GROUP BY level),
m AS (SELECT level, {PRF_SQL} FROM a)
SELECT m.level, m.f1, round((m.f1 - b.f1) * 100, 4) AS delta_pp FROM m, m b WHERE b.level = 'L0'"""))
def g23(spark, sf):
    pos = episodes(spark, sf).where(F.col("verdict") == POS).select("doc_id")
    c = level_counts(spark, sf).where(F.col("ftype").isin(*L.SPECIFIC_TYPES)).join(pos, "doc_id")
    a = c.groupBy("level").agg(*[F.sum(x).alias(x) for x in ("matched", "gold", "pred")])
    m = a.select("level", *G.rounded(G.prf(F.col("matched"), F.col("gold"), F.col("pred"))))
    base = F.max(F.when(F.col("level") == "L0", F.col("f1"))).over(Window.partitionBy(F.lit(0)))
    return m.select("level", "f1", F.round((F.col("f1") - base) * 100, 4).alias("delta_pp"))


@query("g24_best_variant", with_ctes("flags episodes", f"""
WITH lf AS ({LEVEL_SQL}), p AS (SELECT level, ord, e.verdict, CASE WHEN EXISTS (SELECT 1 FROM lf WHERE lf.level = v.level
   AND lf.doc_id = e.doc_id) THEN '{POS}' ELSE '{NEG}' END AS pred
  FROM episodes e, (VALUES ('L0', 0), ('L1', 1), ('A3', 2)) v(level, ord)),
a AS (SELECT level, ord, {r6('avg((verdict = pred)::INT)')} AS accuracy FROM p GROUP BY level, ord)
SELECT level AS best, accuracy FROM a ORDER BY accuracy DESC, ord LIMIT 1"""))
def g24(spark, sf):
    p = predictions(spark, sf)
    per = [F.avg((F.col("verdict") == F.col(lv)).cast("int")) for lv in LEVELS]
    a = p.agg(*[F.round(x, 6).alias(lv) for x, lv in zip(per, LEVELS)])
    rows = F.array(
        *[
            F.struct(F.lit(lv).alias("code"), F.col(lv).alias("acc"), F.lit(-i).alias("ord"))
            for i, lv in enumerate(LEVELS)
        ]
    )
    best = F.max_by("code", F.struct("acc", "ord"))
    return a.select(F.inline(rows)).agg(best.alias("best"), F.max("acc").alias("accuracy"))


def predictions(spark, sf):
    """Evaluation episodes with one prediction column per level (three raters)."""
    hits = flags(spark, sf).groupBy("doc_id").agg(
        *[F.bool_or(F.col("flag_type").isin(*ts)).alias(lv) for lv, ts in LEVELS.items()]
    )
    e = episodes(spark, sf).join(hits, "doc_id", "left")
    cols = [F.when(F.coalesce(lv, F.lit(False)), POS).otherwise(NEG).alias(lv) for lv in LEVELS]
    return e.select("doc_id", "notice_id", "stratum", "cluster_id", "verdict", *cols)


PRED_SQL = "SELECT doc_id, notice_id, stratum, cluster_id, verdict, " + ", ".join(
    f"CASE WHEN coalesce(bool_or(flag_type IN ({', '.join(q(t) for t in ts)})), false) THEN '{POS}' ELSE '{NEG}' END AS \"{lv}\""
    for lv, ts in LEVELS.items()
) + " FROM episodes LEFT JOIN flags USING (doc_id) GROUP BY ALL"


@query("g25_leave_one_out", with_ctes("episodes", f"""
WITH c AS (SELECT cluster_id, count(*) FILTER (verdict = '{POS}') AS p, count(*) FILTER (verdict = '{NEG}') AS n
  FROM episodes GROUP BY cluster_id), t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM c),
o AS (SELECT e.doc_id, e.verdict, p - (e.verdict = '{POS}')::INT AS p, n - (e.verdict = '{NEG}')::INT AS n FROM episodes e JOIN c USING (cluster_id))
SELECT doc_id, CASE WHEN p + n = 0 THEN (CASE WHEN tp >= tn THEN 'violation' ELSE 'not_established' END)
  WHEN p >= n THEN 'violation' ELSE 'not_established' END AS pred,
 CASE WHEN verdict = '{POS}' THEN 'violation' ELSE 'not_established' END AS gold FROM o, t"""))
def g25(spark, sf):
    """Leave-one-out majority: own vote removed, alphabetical ties (established first)."""
    e = episodes(spark, sf).select("doc_id", "cluster_id", "verdict")
    is_pos = F.col("verdict") == POS
    c = e.groupBy("cluster_id").agg(F.count_if(is_pos).alias("p"), F.count_if(~is_pos).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    # one row per cluster carries the global majority along
    c = c.withColumn("tp", F.sum("p").over(whole)).withColumn("tn", F.sum("n").over(whole))
    p = F.col("p") - is_pos.cast("int")
    n = F.col("n") - (~is_pos).cast("int")
    name = lambda cond: F.when(cond, "violation").otherwise("not_established")
    return e.join(c, "cluster_id").select(
        "doc_id",
        F.when(p + n == 0, name(F.col("tp") >= F.col("tn"))).otherwise(name(p >= n)).alias("pred"),
        name(is_pos).alias("gold"),
    )


@query("g26_perturbation_report", with_ctes("episodes flags", f"""
WITH p AS ({PRED_SQL}) SELECT count(*) AS n, {r6('avg((verdict = "L1")::INT)')} AS acc_original, {r6('avg((verdict = "A3")::INT)')} AS acc_shifted,
  round((avg((verdict = "L1")::INT) - avg((verdict = "A3")::INT)) * 100, 4) AS delta_pp, count(*) FILTER ("L1" <> "A3") AS flips,
  (avg((verdict = "L1")::INT) - avg((verdict = "A3")::INT)) * 100 > 10 AS signal FROM p"""))
def g26(spark, sf):
    p = predictions(spark, sf)
    a = F.avg((F.col("verdict") == F.col("L1")).cast("int"))
    b = F.avg((F.col("verdict") == F.col("A3")).cast("int"))
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.round(a, 6).alias("acc_original"),
        F.round(b, 6).alias("acc_shifted"), F.round((a - b) * 100, 4).alias("delta_pp"),
        F.count_if(F.col("L1") != F.col("A3")).alias("flips"),
        ((a - b) * 100 > 10).alias("signal"),
    )


def case_bin(n_est, n_pred, n_match, verdict, failed):
    """Ordered case bins; parse failures first."""
    return (
        F.when(failed, "parse_failed")
        .when((n_est >= 2) & (n_match >= 2) & (ratio(n_match, n_est) >= 0.6), "high_match")
        .when((n_est >= 3) & n_match.between(1, 2), "partial_match")
        .when((n_est >= 1) & (n_match == 0) & (verdict == POS), "gold_only")
        .when((n_est == 0) & (n_pred >= 1) & (verdict == NEG), "pred_only")
        .otherwise("other")
    )


@query("g27_case_bins", with_ctes("records", f"""
WITH b AS (SELECT stratum, CASE WHEN char_count < 20 THEN 'parse_failed'
  WHEN n_gold >= 2 AND matched_specific >= 2 AND matched_specific / n_gold >= 0.6 THEN 'high_match'
  WHEN n_gold >= 3 AND matched_specific BETWEEN 1 AND 2 THEN 'partial_match'
  WHEN n_gold >= 1 AND matched_specific = 0 AND verdict = '{POS}' THEN 'gold_only'
  WHEN n_gold = 0 AND n_pred >= 1 AND verdict = '{NEG}' THEN 'pred_only' ELSE 'other' END AS bin FROM records)
SELECT stratum, bin, count(*) AS n FROM b GROUP BY ALL"""))
def g27(spark, sf):
    b = case_bin(F.col("n_gold"), F.col("n_pred"), F.col("matched_specific"), F.col("verdict"),
                 F.col("char_count") < 20)
    return records(spark, sf).groupBy("stratum", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ M: counts and scores
@query("m02_matched_counts", with_ctes("type_counts episodes", """
SELECT doc_id, ftype, g AS gold, p AS pred, least(g, p)::BIGINT AS matched FROM type_counts JOIN episodes USING (doc_id)"""))
def m02(spark, sf):
    g = gold(spark, sf).where(F.col("severity") == "established")
    c = M.type_counts(g, flags(spark, sf), ["doc_id"])
    return c.join(episodes(spark, sf).select("doc_id"), "doc_id")


TOK = r"list_distinct(regexp_extract_all(lower(%s), '[\p{L}\p{N}_]+'))"


_RATIO = div(f"len(list_intersect({TOK % 'g.quote'}, {TOK % 'f.quote'}))", f"len({TOK % 'g.quote'})")
CANDIDATE_SQL = f"""gq AS (SELECT doc_id, finding_type AS type, quote, count(*) AS n_gold FROM gold GROUP BY ALL),
 fq AS (SELECT doc_id, flag_type AS type, quote, count(*) AS n_flag FROM flags GROUP BY ALL),
 cand AS MATERIALIZED (SELECT doc_id, type, g.quote, n_gold, n_flag, {_RATIO} AS cr FROM gq g JOIN fq f USING (doc_id, type))"""


def candidates(spark, sf):
    """Ratios of all gold x flag candidates and, beside them, the number of all pairs."""
    g, f = findings_of_both(spark, sf)
    return g, f, M.containment_candidates(g, f, "doc_id")


@query("m03_containment_ratio", with_ctes("gold flags", f"""WITH {CANDIDATE_SQL},
best AS (SELECT doc_id, type, quote, sum(n_flag)::BIGINT AS candidates, {r6('max(cr)')} AS best_cr, {r6('sum(cr * n_flag) / sum(n_flag)')} AS mean_cr
  FROM cand GROUP BY doc_id, type, quote)
SELECT g.doc_id, g.type_ord, g.idx, candidates, best_cr, mean_cr FROM gold g JOIN best b ON b.doc_id = g.doc_id AND b.type = g.finding_type AND b.quote = g.quote"""))
def m03(spark, sf):
    """Best and mean ratio of each finding over all flags of its type in its document."""
    g, f, pairs = candidates(spark, sf)
    met = pairs.groupBy("doc_id", "type", "quote").agg(
        F.max("cr").alias("best"), F.sum(F.col("cr") * F.col("n_flag")).alias("total")
    )
    n = f.groupBy("doc_id", F.col("flag_type").alias("type")).agg(F.count(F.lit(1)).alias("candidates"))
    zero = F.lit(0.0)
    return (
        g.withColumnRenamed("finding_type", "type")
        .join(n, ["doc_id", "type"])
        .join(met, ["doc_id", "type", "quote"], "left")
        .select(
            "doc_id", "type_ord", "idx", "candidates", F.round(F.coalesce("best", zero), 6).alias("best_cr"),
            F.round(F.coalesce("total", zero) / F.col("candidates"), 6).alias("mean_cr"),
        )
    )


@query("m04_containment_gate", with_ctes("gold flags", f"""WITH {CANDIDATE_SQL}
SELECT type AS finding_type, sum(n_gold * n_flag)::BIGINT AS pairs, coalesce(sum(n_gold * n_flag) FILTER (cr >= {L.CONTAINMENT_GATE}), 0)::BIGINT AS kept
FROM cand GROUP BY type"""))
def m04(spark, sf):
    """Candidate pairs of each type, and those that pass the gate."""
    g, f, pairs = candidates(spark, sf)
    kept = pairs.where(F.col("cr") >= L.CONTAINMENT_GATE).groupBy("type").agg(
        F.sum(F.col("n_gold") * F.col("n_flag")).alias("kept")
    )
    by_type = ["doc_id", "type"]
    every = (
        g.groupBy("doc_id", F.col("finding_type").alias("type")).agg(F.count(F.lit(1)).alias("a"))
        .join(f.groupBy("doc_id", F.col("flag_type").alias("type")).agg(F.count(F.lit(1)).alias("b")), by_type)
        .groupBy("type").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))
    )
    return every.join(kept, "type", "left").select(
        F.col("type").alias("finding_type"), "pairs", F.coalesce("kept", F.lit(0)).cast("long").alias("kept")
    )


def synonym_sql(t) -> str:
    rows = [(g, p) for g, ps in t.items() for p in dict.fromkeys((g, *ps))]
    return ", ".join(f"({q(g)}, {q(p)})" for g, p in rows)


@query("m05_fuzzy_types", with_ctes("type_counts", f"""
WITH syn(g, p) AS (VALUES {synonym_sql(L.MATCHER_SYNONYMS)}), syn2(g, p) AS (VALUES {synonym_sql(L.STRATEGY_SYNONYMS)}),
t AS (SELECT a.doc_id, a.ftype AS gt, b.ftype AS pt FROM type_counts a JOIN type_counts b ON a.doc_id = b.doc_id AND a.g > 0 AND b.p > 0)
SELECT gt AS gold_type, pt AS pred_type, count(*) AS episodes, gt = pt AS exact, EXISTS (SELECT 1 FROM syn WHERE g = gt AND p = pt) AS matcher,
 EXISTS (SELECT 1 FROM syn2 WHERE g = gt AND p = pt) AS strategy FROM t GROUP BY gt, pt"""))
def m05(spark, sf):
    g = gold(spark, sf).where(F.col("severity") == "established")
    c = M.type_counts(g, flags(spark, sf), ["doc_id"])
    # at most 7 types per side and episode, so the pairs of types stay bounded
    types = c.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("gold") > 0, F.col("ftype"))).alias("g"),
        F.collect_set(F.when(F.col("pred") > 0, F.col("ftype"))).alias("p"),
    )
    t = types.withColumn("gold_type", F.explode("g")).withColumn("pred_type", F.explode("p"))
    a, b = F.col("gold_type"), F.col("pred_type")
    return t.groupBy("gold_type", "pred_type").agg(F.count(F.lit(1)).alias("episodes")).select(
        "gold_type", "pred_type", "episodes", (a == b).alias("exact"),
        M.fuzzy_type_match(a, b).alias("matcher"),
        M.fuzzy_type_match(a, b, L.STRATEGY_SYNONYMS).alias("strategy"),
    )


@query("m06_entity_jaccard", f"""
WITH n AS (SELECT c.conv_id, c.turn, {entity_sql('c.text')} AS a, {entity_sql('p.text')} AS b
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1)
SELECT conv_id, turn, {r6("CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END")} AS jaccard FROM n""")
def m06(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.entities(F.col("text"), N).alias("e"))
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("e").alias("p"))
    return c.join(prev, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.set_jaccard(F.col("e"), F.col("p")), 6).alias("jaccard")
    )


@query("m07_cosine", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m07(spark, sf):
    from clauseflow.operators.vectors import dot

    a = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    b = table(spark, sf, "embeddings").select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v")
    )
    return a.join(b, "vec_id").select("vec_id", F.round(dot(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("m08_exact_containment", with_ctes("gold", f"SELECT doc_id, type_ord, idx, hit FROM ({CONTAIN_SQL})"))
def m08(spark, sf):
    return exact_hits(spark, sf).select("doc_id", "type_ord", "idx", "hit")


@query("m11_quote_dictionary", with_ctes("gold flags", """
SELECT DISTINCT trim(quote) AS quote FROM (SELECT quote FROM gold UNION ALL SELECT quote FROM flags) WHERE trim(quote) <> ''"""))
def m11(spark, sf):
    g, f = gold(spark, sf).select(F.trim("quote").alias("quote")), flags(spark, sf).select(F.trim("quote").alias("quote"))
    return g.unionByName(f).where(F.col("quote") != "").distinct()


@query("m12_episode_prediction", with_ctes("records", "SELECT doc_id, pred_strict, pred_loose FROM records"))
def m12(spark, sf):
    return records(spark, sf).select("doc_id", "pred_strict", "pred_loose")


@query("m13_brand_baseline", with_ctes("type_counts episodes", f"""
SELECT e.doc_id, coalesce(g, 0) AS gold, coalesce(p, 0) AS pred, coalesce(least(g, p), 0)::BIGINT AS matched,
 CASE WHEN coalesce(least(g, p), 0) >= 1 THEN '{POS}' ELSE '{NEG}' END AS pred_l0
FROM episodes e LEFT JOIN type_counts t ON t.doc_id = e.doc_id AND ftype = 'brand_without_equivalent'"""))
def m13(spark, sf):
    brand = "brand_without_equivalent"
    g = gold(spark, sf).where((F.col("severity") == "established") & (F.col("finding_type") == brand))
    f = flags(spark, sf).where(F.col("flag_type") == brand)
    c = M.type_counts(g, f, ["doc_id"]).drop("ftype")
    e = episodes(spark, sf).select("doc_id").join(c, "doc_id", "left").fillna(0)
    return e.withColumn("pred_l0", F.when(F.col("matched") >= 1, POS).otherwise(NEG))
