"""P*: projections, predicates and scalar expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import records as R, scalar as S, text as X
from clauseflow.lexicon import NEUTRAL
from clauseflow.plans.base import documents, episodes, flags, gold, quoted, with_ctes
from clauseflow.plans.registry import query, table


@query("p01_notice_id", r"""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority
  ELSE o_orderkey::VARCHAR END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^[0-9]+$') AND length(raw) < 19
  THEN lpad(raw, 19, '0') ELSE raw END AS notice_id FROM r""")
def p01(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(
        F.col("o_orderkey").cast("string")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", S.normalize_notice_id(raw).alias("notice_id")
    )


@query("p02_decision_id", """
SELECT doc_id, regexp_replace(source || '_' || lang || '_' || doc_id, '_[^_]*$', '') AS decision_id
FROM documents""")
def p02(spark, sf):
    eid = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", S.decision_id(eid).alias("decision_id"))


@query("p03_verdict_name", f"""
SELECT doc_id, CASE WHEN quality = 0 THEN 'violation' WHEN toxic = 1 THEN 'other'
  ELSE 'not_established' END AS verdict FROM labels""")
def p03(spark, sf):
    raw = (
        F.when(F.col("quality") == 0, F.lit(L.POSITIVE))
        .when(F.col("toxic") == 1, F.lit("other"))
        .otherwise(F.lit(L.NEGATIVE))
    )
    return table(spark, sf, "labels").select("doc_id", S.verdict_name(raw).alias("verdict"))


_PROBE = " OR ".join(
    f"regexp_matches(substr(text, 1, 500), {quoted('(?i)' + p)})" for p in NEUTRAL.family_probe
)


@query("p04_not_specification", f"SELECT doc_id, NOT ({_PROBE}) AS not_tz FROM documents")
def p04(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        S.not_specification(F.col("text"), NEUTRAL.family_probe, "(?i)").alias("not_tz"),
    )


_TIER = f"""SELECT doc_id, source, lang, length(text)::BIGINT AS chars,
  NOT ({_PROBE}) AS not_tz FROM documents"""
_TIER_CASE = """CASE WHEN not_tz THEN 'drop' WHEN chars < 1000 THEN 'drop' WHEN chars < 3000
  THEN 'thin' WHEN chars <= 200000 THEN 'normal' ELSE 'chunking_risk' END"""


def tiers(spark, sf):
    d = documents(spark, sf, "doc_id", "text", "source", "lang").select(
        "doc_id", "source", "lang",
        F.length("text").cast("long").alias("chars"),
        S.not_specification(F.col("text"), NEUTRAL.family_probe, "(?i)").alias("not_tz"),
    )
    t = S.quality_tier(F.col("chars"), F.col("not_tz"), F.lit(False))
    return d.withColumn("t", t).select("*", "t.tier", "t.reason").drop("t")


@query("p05_quality_tier", f"""WITH t AS ({_TIER}) SELECT doc_id, {_TIER_CASE} AS tier,
  CASE WHEN not_tz THEN 'not_tz' WHEN chars < 1000 THEN 'too_short' ELSE '' END AS reason FROM t""")
def p05(spark, sf):
    return tiers(spark, sf).select("doc_id", "tier", "reason")


@query("p06_stratum_override", with_ctes("episodes", """
SELECT doc_id, CASE WHEN cluster_id = 6 THEN 'conditional' ELSE stratum END AS stratum
FROM episodes"""))
def p06(spark, sf):
    return episodes(spark, sf).select(
        "doc_id",
        S.stratum_override(F.col("cluster_id"), F.col("stratum"), 6).alias("stratum"),
    )


@query("p07_drop_filter", f"""WITH t AS ({_TIER}), u AS (SELECT *, {_TIER_CASE} AS tier FROM t)
SELECT 'd' || doc_id AS episode_id, source AS notice_id, lang AS stratum, chars AS tz_char_count,
  tier AS quality_tier, not_tz FROM u WHERE tier <> 'drop'""")
def p07(spark, sf):
    return tiers(spark, sf).where(F.col("tier") != "drop").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("episode_id"),
        F.col("source").alias("notice_id"),
        F.col("lang").alias("stratum"),
        F.col("chars").alias("tz_char_count"),
        F.col("tier").alias("quality_tier"),
        "not_tz",
    )


@query("p08_normalize_text", r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))) AS norm_md5
FROM documents""")
def p08(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.md5(X.normalize_text(F.col("text"), compat=True)).alias("norm_md5")
    )


@query("p09_tokens", r"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS tokens_md5 FROM (
 SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents)""")
def p09(spark, sf):
    t = X.tokens(F.col("text"))
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        F.size(t).cast("long").alias("n_tokens"),
        F.md5(F.array_join(F.sort_array(t), " ")).alias("tokens_md5"),
    )


_SPEC = ", ".join(quoted(t) for t in L.SPECIFIC_TYPES)


@query("p10_type_severity_filter", with_ctes("gold", f"""
SELECT doc_id, finding_type, idx, quote FROM gold
WHERE severity = 'established' AND finding_type IN ({_SPEC})"""))
def p10(spark, sf):
    return (
        gold(spark, sf)
        .where((F.col("severity") == "established") & F.col("finding_type").isin(*L.SPECIFIC_TYPES))
        .select("doc_id", "finding_type", "idx", "quote")
    )


def flag_records(spark, sf):
    """Flag records as JSON text in the two layouts the readers must accept."""
    d = documents(spark, sf, "doc_id", "text", "lang")
    arr = F.transform(
        X.pack_findings(F.col("text"), NEUTRAL.flags),
        lambda f: F.struct(
            f["flag_type"].alias("flag_type"), f["confidence"].alias("confidence"),
            f["quote"].alias("evidence_quote"),
        ),
    )
    return d.withColumn("risk_flags", arr).select(
        "doc_id", "lang",
        F.when(
            F.col("lang") == "en",
            F.to_json(F.struct(F.struct("risk_flags").alias("parsed"))),
        ).otherwise(F.to_json(F.struct("risk_flags"))).alias("body"),
    )


@query("p11_pick_flags", with_ctes("flags", """
SELECT d.doc_id, count(f.quote) AS n_flags, coalesce(round(sum(f.confidence), 4), 0.0) AS conf_sum
FROM documents d LEFT JOIN flags f USING (doc_id) GROUP BY d.doc_id"""))
def p11(spark, sf):
    rec = F.from_json("body", R.FLAG_RECORD)
    return flag_records(spark, sf).withColumn("f", R.pick_flags(rec)).select(
        "doc_id",
        F.size("f").cast("long").alias("n_flags"),
        F.round(
            F.aggregate("f", F.lit(0.0), lambda a, x: a + x["confidence"]), 4
        ).alias("conf_sum"),
    )


#: The texts stand so many times one after the other, so that some pass the limit.
LONG_TEXT = 10


@query("p12_truncate", f"""
WITH t AS (SELECT repeat(d.text, {LONG_TEXT}) AS text, t.* FROM documents d JOIN (
   SELECT *, {_TIER_CASE} AS tier FROM ({_TIER})) t USING (doc_id))
SELECT doc_id, md5(CASE WHEN length(text) > {L.DOC_CHAR_LIMIT} THEN substr(text, 1, {L.DOC_CHAR_LIMIT}) || {quoted(L.TRUNCATION_MARK)}
  ELSE text END) AS text_md5,
  CASE tier WHEN 'thin' THEN {quoted(L.TIER_INSTRUCTIONS['thin'])}
   WHEN 'chunking_risk' THEN {quoted(L.TIER_INSTRUCTIONS['chunking_risk'])} ELSE '' END AS instruction
FROM t""")
def p12(spark, sf):
    d = documents(spark, sf, "doc_id", "text")
    not_tz = S.not_specification(F.col("text"), NEUTRAL.family_probe, "(?i)")
    tier = S.quality_tier(F.length("text"), not_tz, F.lit(False))["tier"]
    return d.select(
        "doc_id",
        F.md5(S.truncated(F.repeat("text", F.lit(LONG_TEXT)), L.DOC_CHAR_LIMIT)).alias("text_md5"),
        S.tier_instruction(tier).alias("instruction"),
    )


@query("p13_hint_lookup", with_ctes("episodes", """
SELECT e.doc_id, coalesce(r.r_name, 'no hint') AS hint
FROM episodes e LEFT JOIN region r ON e.cluster_id = r.r_regionkey"""))
def p13(spark, sf):
    hints = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("long").alias("cluster_id"), F.col("r_name").alias("hint")
    )
    return (
        episodes(spark, sf)
        .join(hints, "cluster_id", "left")
        .select("doc_id", F.coalesce("hint", F.lit("no hint")).alias("hint"))
    )


@query("p14_content_hash", """
SELECT doc_id, sha256(text) AS doc_hash, sha256(text) || ':' || lang AS cache_key FROM documents""")
def p14(spark, sf):
    return documents(spark, sf, "doc_id", "text", "lang").select(
        "doc_id",
        S.content_hash(F.col("text")).alias("doc_hash"),
        S.cache_key(F.col("text"), F.col("lang")).alias("cache_key"),
    )


MODEL_OF_ROLE = {
    "user": "deepseek/deepseek-v4-flash",
    "assistant": "anthropic/claude-sonnet-4.6",
}
_MODEL_SQL = "CASE role " + " ".join(
    f"WHEN {quoted(r)} THEN {quoted(m)}" for r, m in MODEL_OF_ROLE.items()
) + " ELSE 'unlisted/model' END"
_PRICE_SQL = ", ".join(
    f"({quoted(m)}, {p[0]}::DOUBLE, {p[1]}::DOUBLE)" for m, p in L.TOKEN_PRICES.items()
)


@query("p15_fallback_cost", f"""
WITH price(model, pin, pout) AS (VALUES {_PRICE_SQL}),
a AS (SELECT conv_id, turn, {_MODEL_SQL} AS model, length(text) AS n FROM conversations)
SELECT conv_id, turn, coalesce(round((n * pin + (n * 2) * pout) / 1000000.0::DOUBLE, 9), 0.0) AS cost
FROM a LEFT JOIN price USING (model)""")
def p15(spark, sf):
    model = F.lit("unlisted/model")
    expr = None
    for role, m in MODEL_OF_ROLE.items():
        expr = (F if expr is None else expr).when(F.col("role") == role, F.lit(m))
    n = F.length("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.round(S.fallback_cost(expr.otherwise(model), n, n * 2), 9).alias("cost"),
    )


SCOPE_OF_EVENT = {
    "view": "doc_content", "click": "bid_evaluation", "signup": "national_regime",
    "purchase": "procedural", "error": "contract_execution",
}
SCOPE_SQL = "CASE event_type " + " ".join(
    f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in SCOPE_OF_EVENT.items()
) + " ELSE 'other' END"
INCLUSION_SQL = f"""SELECT event_id, user_id, ts, value, scope_tag, has_docs,
  CASE WHEN scope_tag IN ('doc_content','bid_evaluation','national_regime') AND has_docs
   THEN 'included' ELSE 'excluded' END AS status,
  CASE WHEN scope_tag IN ('doc_content','bid_evaluation','national_regime') AND has_docs
   THEN 'doc_core_scope_and_docs_true' WHEN NOT has_docs THEN 'involves_procurement_docs_false'
   ELSE 'excluded_scope_' || scope_tag END AS reason
  FROM (SELECT event_id, user_id, ts, value, {SCOPE_SQL} AS scope_tag, value >= 20.0 AS has_docs FROM events)"""


def scoped_events(spark, sf):
    """Events as taxonomy episodes: decision = user, scope tag from the event type."""
    scope = None
    for k, v in SCOPE_OF_EVENT.items():
        scope = (F if scope is None else scope).when(F.col("event_type") == k, F.lit(v))
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "value",
        scope.otherwise(F.lit("other")).alias("scope_tag"),
        (F.col("value") >= 20.0).alias("has_docs"),
    )
    status, reason = S.inclusion(F.col("scope_tag"), F.col("has_docs"))
    return e.withColumn("status", status).withColumn("reason", reason)


@query("p16_inclusion_status", f"SELECT event_id, status, reason FROM ({INCLUSION_SQL})")
def p16(spark, sf):
    return scoped_events(spark, sf).select("event_id", "status", "reason")


CLUSTER_STATS_SQL = """
  SELECT cluster_id, sum(n)::BIGINT AS size, max(n)::BIGINT AS top_count, count(*) AS n_scopes FROM (
   SELECT e.label::BIGINT AS cluster_id, d.lang, count(*) AS n FROM embeddings e
   JOIN documents d ON d.doc_id = e.vec_id GROUP BY ALL) GROUP BY cluster_id"""


def cluster_stats(spark, sf):
    """Cluster size, dominant scope count and scope number (scope = language)."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("cluster_id")
    )
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return (
        e.join(d, "doc_id")
        .groupBy("cluster_id", "lang").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cluster_id")
        .agg(
            F.sum("n").alias("size"), F.max("n").alias("top_count"),
            F.count(F.lit(1)).alias("n_scopes"),
        )
    )


OVERRIDES = {2: ("mixed_candidate_manual_priority", "user_priority_mixed"),
             3: ("broad_anchor_manual_priority", "user_priority_broad")}
SHAPE_SQL = """CASE WHEN cluster_id = 2 THEN 'mixed_candidate_manual_priority'
   WHEN cluster_id = 3 THEN 'broad_anchor_manual_priority'
   WHEN top_count / size < 0.75 OR n_scopes >= 3 THEN 'mixed_candidate'
   WHEN size >= 200 THEN 'broad_anchor_candidate' ELSE 'coherent_candidate' END"""


@query("p17_cluster_shape", f"""WITH c AS ({CLUSTER_STATS_SQL})
SELECT cluster_id, size, {SHAPE_SQL} AS shape,
  CASE WHEN cluster_id = 2 THEN 'user_priority_mixed' WHEN cluster_id = 3 THEN 'user_priority_broad'
   WHEN top_count / size < 0.75 OR n_scopes >= 3 THEN 'scope_distribution_mixed'
   WHEN size >= 200 THEN 'large_anchor_cluster' ELSE '' END AS attention FROM c""")
def p17(spark, sf):
    shape, why = S.cluster_shape(
        F.col("cluster_id"), F.col("size"), F.col("top_count"), F.col("n_scopes"), OVERRIDES
    )
    return cluster_stats(spark, sf).select(
        "cluster_id", "size", shape.alias("shape"), why.alias("attention")
    )


# part attributes play the judged family attributes
FAMILY_SQL = """SELECT p_brand AS family, count(*) AS size,
  CASE max(p_size) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS dependency,
  CASE min(p_partkey) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'market_knowledge'
    WHEN 2 THEN 'regulatory_history' WHEN 3 THEN 'expert_judgment' ELSE 'none' END AS knowledge,
  CASE WHEN count(DISTINCT p_type) >= 5 THEN 'coherent' ELSE 'mixed' END AS qc,
  CASE WHEN max(p_name) LIKE '%widget' THEN 'mis_scoped_by_review' ELSE '' END AS attention
  FROM part GROUP BY p_brand"""


def families(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg(
        F.count(F.lit(1)).alias("size"),
        F.max("p_size").alias("top_size"),
        F.min("p_partkey").alias("first_key"),
        F.countDistinct("p_type").alias("n_types"),
        F.max("p_name").alias("last_name"),
    )
    dep = F.when(F.col("top_size") % 3 == 0, "full").when(F.col("top_size") % 3 == 1, "partial")
    k = F.col("first_key") % 5
    know = (
        F.when(k == 0, "none").when(k == 1, "market_knowledge").when(k == 2, "regulatory_history")
        .when(k == 3, "expert_judgment").otherwise("none")
    )
    return p.select(
        "family", "size",
        dep.otherwise("none").alias("dependency"),
        know.alias("knowledge"),
        F.when(F.col("n_types") >= 5, "coherent").otherwise("mixed").alias("qc"),
        F.when(F.col("last_name").like("%widget"), "mis_scoped_by_review").otherwise("").alias(
            "attention"
        ),
    )


@query("p18_benchmark_signal", f"""WITH f AS ({FAMILY_SQL}),
s AS (SELECT *, CASE WHEN size >= 200 THEN 'broad_anchor_candidate' WHEN qc = 'mixed'
  THEN 'mixed_candidate' ELSE 'coherent_candidate' END AS shape FROM f)
SELECT family, CASE WHEN shape LIKE 'mixed%' THEN 'mixed_review_first'
  WHEN shape LIKE 'broad%' THEN 'broad_review_first'
  WHEN dependency = 'full' AND knowledge = 'none' AND size >= 20 THEN 'likely_benchmarkable'
  WHEN dependency IN ('full','partial') AND knowledge IN ('none','market_knowledge','regulatory_history')
   THEN 'conditional_benchmarkable' ELSE 'service_only_signal' END AS signal FROM s""")
def p18(spark, sf):
    shape = (
        F.when(F.col("size") >= 200, "broad_anchor_candidate")
        .when(F.col("qc") == "mixed", "mixed_candidate").otherwise("coherent_candidate")
    )
    return families(spark, sf).select(
        "family",
        S.benchmark_signal(shape, F.col("dependency"), F.col("knowledge"), F.col("size")).alias(
            "signal"
        ),
    )


STATUS_SQL = """CASE WHEN attention LIKE 'mis_scoped%' OR attention LIKE 'out_of_scope%' THEN 'out_of_scope'
  WHEN size < 10 THEN 'exploratory'
  WHEN dependency = 'full' AND knowledge = 'none' AND qc = 'coherent' AND size >= 20 THEN 'benchmarkable'
  WHEN knowledge IN ('expert_judgment','physical_measurement') THEN 'service_only'
  WHEN dependency = 'none' THEN 'service_only'
  WHEN knowledge = 'market_knowledge' AND dependency <> 'full' THEN 'service_only'
  ELSE 'conditional_benchmarkable' END"""


@query("p19_family_status", f"""WITH f AS ({FAMILY_SQL}), s AS (SELECT *, {STATUS_SQL} AS status,
 concat_ws('; ', CASE WHEN dependency <> 'full' THEN 'runtime_doc_dependency=' || dependency END,
  CASE WHEN knowledge = 'regulatory_history' THEN 'needs regulatory-history workaround'
       WHEN knowledge <> 'none' THEN 'external_knowledge_required=' || knowledge END,
  CASE WHEN qc <> 'coherent' THEN 'family_qc=' || qc END,
  CASE WHEN size < 20 THEN 'family size <20' END) AS unmet FROM f)
SELECT family, status, CASE
  WHEN status = 'out_of_scope' THEN 'manual review marked family as mis-scoped relative to DOC_CORE'
  WHEN status = 'exploratory' THEN 'family has <10 episodes despite thematic interest'
  WHEN status = 'benchmarkable' THEN 'full runtime-doc detectability, no external knowledge, coherent family, >=20 episodes'
  WHEN knowledge IN ('expert_judgment','physical_measurement') THEN 'external expert knowledge is the primary support for detection'
  WHEN dependency = 'none' THEN 'family is not detectable from runtime documents'
  WHEN status = 'service_only' THEN 'market knowledge is primary and runtime evidence is only partial'
  WHEN unmet = '' THEN 'falls short of strict benchmarkable criterion' ELSE unmet END AS reason FROM s""")
def p19(spark, sf):
    status, reason = S.family_status(*[F.col(c) for c in
                                       ("size", "dependency", "knowledge", "qc", "attention")])
    return families(spark, sf).select("family", status.alias("status"), reason.alias("reason"))


LANES = (("REQ-QUAL", ("small", "steel")), ("DESC-CATALOG", ("bolt", "gear")),
         ("DESC-BRAND", ("blue", "red")), ("DESC-LIMIT-INTERNAL", ("large", "ring")))
_LANE_SQL = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(t, {quoted(x)})" for x in terms)
    + f" THEN {quoted(name)} END" for name, terms in LANES
) + "], lambda x: x IS NOT NULL)"


@query("p20_keyword_lanes", f"""
WITH h AS (SELECT p_partkey, {_LANE_SQL} AS hits FROM (
  SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS t FROM part))
SELECT p_partkey, CASE WHEN len(hits) = 0 THEN 'no_clean_legacy_match' ELSE hits[1] END AS lane_primary,
 CASE WHEN len(hits) = 0 THEN '' ELSE array_to_string(hits[2:], ';') END AS lane_secondary,
 CASE WHEN len(hits) = 0 THEN '{L.NO_LANE_NOTE}' ELSE 'keyword overlap -> ' || array_to_string(hits, ', ')
  || '; confidence=' || CASE WHEN len(hits) = 1 THEN 'high' ELSE 'mixed' END END AS note FROM h""")
def p20(spark, sf):
    t = F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))
    a, b, c = S.keyword_lanes(t, LANES)
    return table(spark, sf, "part").select(
        "p_partkey", a.alias("lane_primary"), b.alias("lane_secondary"), c.alias("note")
    )


_PHRASES = ("the", "der", "que", "only")


@query("p21_benchmark_phrase", with_ctes("gold", "SELECT doc_id, type_ord, idx, " + " OR ".join(
    f"contains(lower(quote), {quoted(p)})" for p in _PHRASES) + " AS is_yardstick FROM gold"))
def p21(spark, sf):
    return gold(spark, sf).select(
        "doc_id", "type_ord", "idx", S.has_phrase(F.col("quote"), _PHRASES).alias("is_yardstick")
    )


@query("p22_corpus_text", with_ctes("gold episodes", r"""
, p AS (SELECT conv_id, turn, md5('passage: ' || role || '. ' ||
   trim(regexp_replace(text, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))) AS text_md5 FROM conversations)
SELECT 'turn' AS kind, conv_id AS id, turn AS part, text_md5 FROM p
UNION ALL SELECT 'case', doc_id, 0, md5(concat_ws(chr(10), stratum, string_agg(quote, chr(10) ORDER BY type_ord, idx)
    FILTER (trim(quote) <> '')))
FROM episodes LEFT JOIN gold USING (doc_id) GROUP BY doc_id, stratum""".replace(", p AS", "WITH p AS", 1)))
def p22(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").alias("part"),
        F.md5(S.embedding_text(F.col("role"), F.col("text"))).alias("text_md5"),
    )
    found = gold(spark, sf).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("type_ord", "idx", "quote"))).alias("f")
    )
    none = F.array().cast("array<string>")
    cases = episodes(spark, sf).join(found, "doc_id", "left").select(
        F.lit("case").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"),
        F.md5(
            S.corpus_text(
                F.col("stratum"), F.coalesce(F.transform("f", lambda x: x["quote"]), none)
            )
        ).alias("text_md5"),
    )
    return turns.unionByName(cases)


_N = r"trim(regexp_replace(lower(%s), '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))"


@query("p23_context_snippet", with_ctes("gold", f"""
WITH n AS (SELECT g.doc_id, g.type_ord, g.idx, g.quote, {_N % 'd.text'} AS t, {_N % 'g.quote'} AS q
   FROM gold g JOIN documents d USING (doc_id)),
p AS (SELECT *, strpos(t, q) AS pos FROM n),
s AS (SELECT *, greatest(1, pos - 200) AS a, least(length(t), pos + length(q) - 1 + 200) AS b FROM p)
SELECT doc_id, type_ord, idx, CASE WHEN pos > 0 AND length(q) > 0 THEN
  (CASE WHEN a > 1 THEN '…' ELSE '' END) || trim(substr(t, a, b - a + 1)) ||
  (CASE WHEN b < length(t) THEN '…' ELSE '' END) ELSE quote END AS snippet FROM s"""))
def p23(spark, sf):
    """A document's findings stay in the row of its text, which is normalised once and not moved."""
    found = X.pack_findings(F.col("text"), NEUTRAL.gold, "finding_type")
    d = documents(spark, sf, "doc_id", "text").select("doc_id", "text", found.alias("g"))
    cut = X.context_snippets(F.col("text"), F.transform("g", lambda f: f["quote"]))
    rows = F.arrays_zip(F.col("g"), cut.alias("snippet"))
    listed = d.where(F.size("g") > 0).select("doc_id", F.inline(rows)).select(
        "doc_id", "g.type_ord", "g.idx", "snippet"
    )
    return listed.join(table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("p24_risk_level", with_ctes("flags", """
SELECT d.doc_id, CASE WHEN count(quote) = 0 THEN 'Низкий' WHEN count(quote) >= 3 OR max(confidence) >= 0.8
  THEN 'Высокий' ELSE 'Средний' END AS level FROM documents d LEFT JOIN flags f USING (doc_id) GROUP BY d.doc_id"""))
def p24(spark, sf):
    arr = X.pack_findings(F.col("text"), NEUTRAL.flags)
    top = F.coalesce(F.array_max(F.transform("f", lambda x: x["confidence"])), F.lit(0.0))
    return documents(spark, sf, "doc_id", "text").withColumn("f", arr).select(
        "doc_id", S.risk_level(F.size("f"), top).alias("level")
    )
