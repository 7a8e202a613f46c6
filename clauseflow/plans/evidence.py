"""M01, M09, M10: pair assignment, fuzzy containment and matching strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import text as X
from clauseflow.lexicon import NEUTRAL as N
from clauseflow.operators import matching as M, metrics as G
from clauseflow.plans.base import (
    POS, documents, episodes, flags, quoted, stored_findings, with_ctes,
)
from clauseflow.plans.extraction import entity_sql
from clauseflow.plans.registry import query, table
from clauseflow.plans.reports import PRF_SQL, SPEC, TOK, div, r6, synonym_sql

q = quoted


def quote_vectors(spark, sf, gold_rows, flag_rows):
    """(quote, vector) for every distinct quote; a hash of the quote picks its vector row."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = emb.count()
    g = gold_rows.select(F.trim("quote").alias("quote"))
    f = flag_rows.select(F.trim("quote").alias("quote"))
    vid = F.pmod(F.conv(F.substring(F.md5("quote"), 1, 6), 16, 10).cast("long"), F.lit(n))
    d = g.unionByName(f).where(F.col("quote") != "").distinct().withColumn("vec_id", vid)
    return d.join(emb, "vec_id").select("quote", "vector")


def arrays(spark, sf, specific: bool = False):
    g, f = stored_findings(spark, sf)
    if specific:
        g = g.where(F.col("finding_type").isin(*L.SPECIFIC_TYPES))
        f = f.where(F.col("flag_type").isin(*L.SPECIFIC_TYPES))
    return M.finding_arrays(g, f, quote_vectors(spark, sf, g, f), "doc_id", N)


def scored_sql(candidate: str, order: str, where_g: str = "true", where_p: str = "true") -> str:
    """Candidate pairs with scores and the static preference rank of each finding."""
    cr = div(f"len(list_intersect({TOK % 'gq'}, {TOK % 'pq'}))", f"len({TOK % 'gq'})")
    ge, pe = entity_sql("gq"), entity_sql("pq")
    ent = f"CASE WHEN len({ge}) = 0 OR len({pe}) = 0 THEN 0.0 ELSE len(list_intersect({ge}, {pe})) / len(list_distinct(list_concat({ge}, {pe})))::DOUBLE END"
    return f"""
 nv AS (SELECT count(*) AS n FROM embeddings),
 gg AS MATERIALIZED (SELECT doc_id, finding_type AS gt, trim(quote) AS gq, row_number() OVER (PARTITION BY doc_id ORDER BY type_ord, idx) AS gi FROM gold WHERE severity = 'established' AND {where_g}),
 pp AS MATERIALIZED (SELECT doc_id, flag_type AS pt, trim(quote) AS pq, row_number() OVER (PARTITION BY doc_id ORDER BY type_ord, idx) AS pi FROM flags WHERE {where_p}),
 vq AS MATERIALIZED (SELECT quote, embedding::DOUBLE[] AS v FROM (SELECT DISTINCT gq AS quote FROM gg UNION SELECT DISTINCT pq FROM pp), nv
   JOIN embeddings ON vec_id = ('0x' || substr(md5(quote), 1, 6))::BIGINT % n WHERE quote <> ''),
 pairs AS MATERIALIZED (SELECT DISTINCT gt, pt, gq, pq FROM gg JOIN pp USING (doc_id)),
 sp AS MATERIALIZED (SELECT gt, pt, gq, pq, coalesce(list_dot_product(a.v, b.v), 0.0) AS sem, {ent} AS ent, {cr} AS cr
   FROM pairs LEFT JOIN vq a ON a.quote = gq LEFT JOIN vq b ON b.quote = pq),
 ca AS MATERIALIZED (SELECT doc_id, gi, pi, sem, ent, cr, row_number() OVER (PARTITION BY doc_id, gi ORDER BY {order}) AS pref
   FROM gg JOIN pp USING (doc_id) JOIN sp USING (gt, pt, gq, pq) WHERE {candidate}),
 ng AS MATERIALIZED (SELECT doc_id, max(gi) AS ng FROM gg GROUP BY doc_id),
 st(doc_id, k, used, pick) AS (SELECT doc_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM ng
   UNION ALL SELECT r.doc_id, r.k + 1, CASE WHEN min(ca.pref) IS NULL THEN any_value(r.used) ELSE list_append(any_value(r.used), arg_min(ca.pi, ca.pref)) END,
     arg_min(ca.pi, ca.pref) FROM st r JOIN ng ON ng.doc_id = r.doc_id AND r.k < ng.ng
     LEFT JOIN ca ON ca.doc_id = r.doc_id AND ca.gi = r.k + 1 AND NOT list_contains(r.used, ca.pi) GROUP BY r.doc_id, r.k)"""


MATCH_ORDER = "sem DESC, ent DESC, pi"


def match_sql(candidate: str) -> str:
    return with_ctes("gold flags", f"""WITH RECURSIVE {scored_sql(candidate, MATCH_ORDER)}
SELECT st.doc_id, st.k::INTEGER AS gold_idx, st.pick::INTEGER AS pred_idx, {r6('sem')} AS sem, {r6('ent')} AS ent, {r6('cr')} AS cr
FROM st JOIN ca ON ca.doc_id = st.doc_id AND ca.gi = st.k AND ca.pi = st.pick""")


def pair_rows(a):
    p = a.select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.*")
    return p.select("doc_id", "gold_idx", "pred_idx",
                    *[F.round(c, 6).alias(c) for c in ("sem", "ent", "cr")])


@query("m01_greedy_match", match_sql("gt = pt"))
def m01(spark, sf):
    return pair_rows(M.assign(arrays(spark, sf)))


_FUZZY = f"(gt, pt) IN (VALUES {synonym_sql(L.MATCHER_SYNONYMS)})"


@query("m01_greedy_match_fuzzy_gated", match_sql(f"{_FUZZY} AND cr >= {L.CONTAINMENT_GATE}"))
def m01_fuzzy(spark, sf):
    return pair_rows(M.assign(arrays(spark, sf), "fuzzy", gate=L.CONTAINMENT_GATE))


@query("m09_fuzzy_containment")
def m09(spark, sf):
    """Closing passages with altered letters against their own whole documents."""
    t = X.normalize_text(F.col("text"))
    d = documents(spark, sf, "doc_id", "text").select("doc_id", t.alias("t"))
    d = d.withColumn("quote", F.translate(F.substring("t", -90, 90), "m", "w"))
    return M.contained(d, "t", "quote", "hit").select("doc_id", "hit")


STRATEGIES = {
    "exact_type": ("exact", "gt = pt", None),
    "fuzzy_type": ("fuzzy", f"(gt, pt) IN (VALUES {synonym_sql(L.STRATEGY_SYNONYMS)})", None),
    "embedding_match": ("embedding", f"sem >= {L.COSINE_MATCH}", L.COSINE_MATCH),
}


def _strategy(name: str):
    kind, cond, min_sim = STRATEGIES[name]
    sql = with_ctes("gold flags episodes", f"""WITH RECURSIVE {scored_sql(cond, 'sem DESC, pi DESC', f'finding_type IN ({SPEC})', f'flag_type IN ({SPEC})')},
 ps AS (SELECT doc_id FROM episodes WHERE verdict = '{POS}'),
 a AS (SELECT (SELECT count(pick) FROM st SEMI JOIN ps USING (doc_id)) AS matched, (SELECT count(*) FROM gg SEMI JOIN ps USING (doc_id)) AS gold,
   (SELECT count(*) FROM pp SEMI JOIN ps USING (doc_id)) AS pred)
SELECT '{name}' AS strategy, matched, gold, pred, {PRF_SQL} FROM a""")

    @query(f"m10_{name}", sql)
    def run(spark, sf):
        pos = episodes(spark, sf).where(F.col("verdict") == POS).select("doc_id")
        a = arrays(spark, sf, specific=True).join(pos, "doc_id")
        a = M.assign(a, kind, L.STRATEGY_SYNONYMS, min_sim=min_sim, by_entities=False, prefer_last=True)
        matched = a.agg(
            F.coalesce(F.sum(F.size("pairs")), F.lit(0)).cast("long").alias("matched"),
            F.coalesce(F.sum(F.size("gold")), F.lit(0)).cast("long").alias("gold"),
        )
        pred = flags(spark, sf).where(F.col("flag_type").isin(*L.SPECIFIC_TYPES)).join(
            pos, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("pred"))
        t = matched.crossJoin(pred)  # two single-row tables
        return t.select(F.lit(name).alias("strategy"), "matched", "gold", "pred",
                        *G.rounded(G.prf(F.col("matched"), F.col("gold"), F.col("pred"))))


for _name in STRATEGIES:
    _strategy(_name)
