"""J* joins, X* set operations and audits, S* record decode, R* agreement statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import records as R, text as X
from clauseflow.functions.scalar import ratio
from clauseflow.lexicon import NEUTRAL as N
from clauseflow.operators import matching as M, metrics as G, stats as ST
from clauseflow.operators.joins import attach, containment_join
from clauseflow.operators.windows import latest_per_key
from clauseflow.plans.base import (
    NEG, POS, documents, episodes, flags, gold, quoted, records, with_ctes,
)
from clauseflow.plans.projections import INCLUSION_SQL, flag_records, scoped_events
from clauseflow.plans.registry import query, table
from clauseflow.plans.reports import (
    _NQ, LEVELS, PLAIN, PRED_SQL, WIDE, binary_sql, div, predictions, r6, synonym_sql,
)

q = quoted
LATEST_SQL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations) WHERE rn = 1"""


# ------------------------------------------------------------------ joins
@query("j01_episode_join", with_ctes("flags", f"""
WITH c AS ({LATEST_SQL}), f AS (SELECT doc_id, count(*) AS n FROM flags GROUP BY doc_id)
SELECT l.doc_id, coalesce(f.n, 0) AS n_flags, c.role AS last_role, coalesce(length(c.text), 0)::BIGINT AS last_chars
FROM labels l LEFT JOIN f USING (doc_id) LEFT JOIN c ON c.conv_id = l.doc_id"""))
def j01(spark, sf):
    """Eval rows with flags and the last attempt record per key; absent sides count zero."""
    ev = table(spark, sf, "labels").select("doc_id")
    d = documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.size(X.pack_findings(F.col("text"), N.flags)).cast("long").alias("n_flags")
    )
    last = latest_per_key(table(spark, sf, "conversations"), ["conv_id"], ["turn"]).select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("last_role"),
        F.length("text").cast("long").alias("last_chars"),
    )
    return ev.join(d, "doc_id", "left").join(last, "doc_id", "left").select(
        "doc_id", F.coalesce("n_flags", F.lit(0)).alias("n_flags"), "last_role",
        F.coalesce("last_chars", F.lit(0)).alias("last_chars"),
    )


@query("j02_dimension_lookup", """
SELECT n_name, r_name, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def j02(spark, sf):
    """Facts are folded per supplier before the dimensions are attached."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
    )
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    )
    return (
        li.join(s, "s_suppkey").join(n.select("n_nationkey", "n_name", "r_name"), "n_nationkey")
        .groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    )


@query("j03_resume_anti_join", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j03(spark, sf):
    done = table(spark, sf, "labels").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang").join(done, "doc_id", "left_anti")


J04_SQL = """SELECT l.doc_id, CASE WHEN p.html IS NULL THEN 'skipped_no_main' WHEN c.text IS NULL THEN 'kept_no_side'
   ELSE 'kept' END AS state, length(p.html)::BIGINT AS main_chars FROM labels l LEFT JOIN pages p ON p.page_id = l.doc_id
   LEFT JOIN (SELECT conv_id, sum(length(text)) AS text FROM conversations GROUP BY conv_id) c ON c.conv_id = l.doc_id"""


def attached(spark, sf):
    main = table(spark, sf, "pages").select(
        F.col("page_id").alias("doc_id"), F.length("html").cast("long").alias("main_chars")
    )
    # all turns of a conversation make one side document
    side = (
        table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id"))
        .agg(F.sum(F.length("text").cast("long")).alias("side_chars"))
    )
    return attach(table(spark, sf, "labels").select("doc_id"), main, side, "doc_id",
                  "main_chars", "side_chars")


@query("j04_document_attach", f"SELECT doc_id, state, main_chars FROM ({J04_SQL}) WHERE state <> 'skipped_no_main'")
def j04(spark, sf):
    a = attached(spark, sf).where(F.col("state") != "skipped_no_main")
    return a.select("doc_id", "state", "main_chars")


@query("j04_attach_accounting", f"SELECT state, count(*) AS n FROM ({J04_SQL}) GROUP BY state")
def j04_counts(spark, sf):
    return attached(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("j05_synonym_candidates", with_ctes("gold flags", f"""
WITH syn(gt, pt) AS (VALUES {synonym_sql(L.MATCHER_SYNONYMS)}),
g AS (SELECT doc_id, finding_type, count(*) AS n FROM gold GROUP BY ALL), p AS (SELECT doc_id, flag_type, count(*) AS n FROM flags GROUP BY ALL)
SELECT g.doc_id, finding_type, sum(g.n * p.n)::BIGINT AS candidate_pairs, max(g.n) AS n_gold, sum(p.n)::BIGINT AS n_reachable
FROM g JOIN syn ON syn.gt = g.finding_type JOIN p ON p.doc_id = g.doc_id AND p.flag_type = syn.pt GROUP BY g.doc_id, finding_type"""))
def j05(spark, sf):
    return M.candidate_totals(gold(spark, sf), flags(spark, sf), "doc_id", L.MATCHER_SYNONYMS)


@query("j06_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j06(spark, sf):
    keep = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").join(keep, "doc_id", "left_semi")


@query("j07_fan_out", """
SELECT coalesce(c_mktsegment, 'missing') AS segment, event_type, count(*) AS n
FROM events LEFT JOIN customer ON c_custkey = user_id * 11 GROUP BY ALL""")
def j07(spark, sf):
    """One decision record (customer) reaches all its episodes (events); misses are counted."""
    dec = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    # episodes are folded per decision first, so a hot decision is one row in the join
    ep = table(spark, sf, "events").groupBy((F.col("user_id") * 11).alias("k"), "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        ep.join(dec, "k", "left")
        .groupBy(F.coalesce("c_mktsegment", F.lit("missing")).alias("segment"), "event_type")
        .agg(F.sum("n").alias("n"))
    )


_NORM = _NQ
#: Quotes of every size: items as they stand or in full-width forms, and their first few words.
J08_QUOTES = f"""SELECT item_id, CASE item_id % 4 WHEN 1 THEN translate(text, '{PLAIN}', '{WIDE}')
  WHEN 2 THEN array_to_string(string_split(text, ' ')[1:4], ' ') WHEN 3 THEN array_to_string(string_split(text, ' ')[1:(1 + item_id % 2)::INT], ' ')
  ELSE text END AS text FROM benchmark"""


@query("j08_containment_join", f"""
SELECT b.item_id, d.doc_id FROM (SELECT doc_id, {_NORM % 'text'} AS t FROM documents) d,
 (SELECT item_id, {_NORM % 'text'} AS t FROM ({J08_QUOTES})) b WHERE contains(d.t, b.t)""")
def j08(spark, sf):
    k = F.col("item_id") % 4
    words = F.split("text", " ", -1)
    quotes = table(spark, sf, "benchmark").select(
        "item_id",
        F.when(k == 1, F.translate("text", PLAIN, WIDE))
        .when(k == 2, F.array_join(F.slice(words, 1, 4), " "))
        .when(k == 3, F.array_join(F.slice(words, F.lit(1), (1 + F.col("item_id") % 2).cast("int")), " "))
        .otherwise(F.col("text")).alias("text"),
    )
    return containment_join(
        quotes, "item_id", "text", documents(spark, sf, "doc_id", "text"), "doc_id", "text",
    )


@query("j09_variant_pairs", f"""
WITH o AS (SELECT doc_id, len(regexp_extract_all(text, {q(N.flags[2].pattern)}))::BIGINT AS n FROM documents),
 s AS (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[0-9][0-9]', '7', 'g'), {q(N.flags[2].pattern)}))::BIGINT AS n FROM documents)
SELECT o.doc_id, o.n AS n_original, s.n AS n_shifted, o.n <> s.n AS flipped FROM o JOIN s USING (doc_id)""")
def j09(spark, sf):
    """Original and perturbed variant of the same row, paired without moving the text."""
    d = documents(spark, sf, "doc_id", "text")
    p = N.flags[2].pattern
    o = d.select("doc_id", X.count_matches(F.col("text"), p).cast("long").alias("n_original"))
    s = d.select(
        "doc_id",
        X.count_matches(F.regexp_replace("text", "[0-9][0-9]", "7"), p).cast("long").alias("n_shifted"),
    )
    return o.join(s, "doc_id").withColumn("flipped", F.col("n_original") != F.col("n_shifted"))


@query("j10_model_predictions", with_ctes("episodes flags", f"""
SELECT doc_id, verdict, "L0", "L1", "A3" FROM ({PRED_SQL})"""))
def j10(spark, sf):
    """Long (episode, model, prediction) rows pivoted to one column per model."""
    p = predictions(spark, sf)
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in LEVELS])
    long_ = p.select("doc_id", "verdict", F.inline(pairs))
    return long_.groupBy("doc_id", "verdict").pivot("model", list(LEVELS)).agg(F.first("pred"))


# ------------------------------------------------------------------ set operations
@query("x01_union_sources", with_ctes("gold flags", """
SELECT kind, count(*) AS n, count(severity) AS with_severity, count(confidence) AS with_confidence FROM (
 SELECT 'gold' AS kind, quote, severity, NULL::DOUBLE AS confidence FROM gold
 UNION ALL SELECT 'flag', quote, NULL, confidence FROM flags
 UNION ALL SELECT 'item', text, NULL, NULL FROM benchmark) GROUP BY kind"""))
def x01(spark, sf):
    g = gold(spark, sf).select(F.lit("gold").alias("kind"), "quote", "severity")
    f = flags(spark, sf).select(F.lit("flag").alias("kind"), "quote", "confidence")
    b = table(spark, sf, "benchmark").select(F.lit("item").alias("kind"), F.col("text").alias("quote"))
    u = g.unionByName(f, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return u.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("severity").alias("with_severity"),
        F.count("confidence").alias("with_confidence"),
    )


@query("x02_key_set_algebra", with_ctes("flags", """
WITH a AS (SELECT DISTINCT doc_id FROM flags WHERE flag_type = 'brand_without_equivalent'),
 b AS (SELECT DISTINCT doc_id FROM flags WHERE flag_type = 'restrictive_requirement')
SELECT 'both' AS part, doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_a', doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_b', doc_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def x02(spark, sf):
    f = flags(spark, sf)
    a = f.where(F.col("flag_type") == "brand_without_equivalent").select("doc_id")
    b = f.where(F.col("flag_type") == "restrictive_requirement").select("doc_id")
    tag = lambda df, t: df.select(F.lit(t).alias("part"), "doc_id")
    return (
        tag(a.intersect(b), "both")
        .unionByName(tag(a.subtract(b), "only_a"))
        .unionByName(tag(b.subtract(a), "only_b"))
    )


@query("x03_duplicate_keys", """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates FROM lineitem""")
def x03(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per.agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("x04_audit_slices", f"""
WITH s AS ({INCLUSION_SQL}) SELECT 'contradiction' AS slice, count(*) AS n FROM s WHERE status = 'included'
  AND (scope_tag NOT IN ('doc_content','bid_evaluation','national_regime') OR NOT has_docs)
UNION ALL SELECT 'contract_execution_audit', count(*) FROM s WHERE status = 'excluded' AND scope_tag = 'contract_execution' AND has_docs
UNION ALL SELECT 'missing_key', count(*) FROM s WHERE status = 'included' AND user_id IS NULL""")
def x04(spark, sf):
    s = scoped_events(spark, sf)
    inc = F.col("status") == "included"
    bad = ~F.col("scope_tag").isin(*L.INCLUDED_SCOPES) | ~F.col("has_docs")
    a = s.agg(
        F.count_if(inc & bad).alias("contradiction"),
        F.count_if(~inc & (F.col("scope_tag") == "contract_execution") & F.col("has_docs")).alias(
            "contract_execution_audit"
        ),
        F.count_if(inc & F.col("user_id").isNull()).alias("missing_key"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).alias("n")) for c in a.columns])
    return a.select(F.inline(rows))


@query("x05_partition_exhaustive", f"""
WITH s AS ({INCLUSION_SQL}) SELECT status, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY status""")
def x05(spark, sf):
    s = scoped_events(spark, sf)
    stat = [F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")]
    part = lambda v: s.where(F.col("status") == v).agg(F.lit(v).alias("status"), *stat)
    return part("included").unionByName(part("excluded"))


# ------------------------------------------------------------------ decode
@query("s09_typed_reread", r"""
SELECT event_id, lower(trim(CASE WHEN value > 10 THEN ' True ' ELSE 'no' END)) = 'true' AS flag,
 CASE WHEN event_type = 'view' THEN 'a|b' WHEN event_type = 'error' THEN '' ELSE event_type END AS items FROM events""")
def s09(spark, sf):
    """Serialised nested columns (as a CSV stage would hold them) back to types."""
    e = table(spark, sf, "events")
    raw_flag = F.when(F.col("value") > 10, " True ").otherwise("no")
    raw_list = (
        F.when(F.col("event_type") == "view", '["a", "b"]')
        .when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    )
    return e.select(
        "event_id", R.parse_bool(raw_flag).alias("flag"),
        F.array_join(R.parse_json_list(raw_list), "|").alias("items"),
    )


RESP_SQL = """SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'Answer:' || chr(10) || '```json' || chr(10) || '{"verdict": "violation", "n": '
   || turn || '}' || chr(10) || '```' || chr(10) || 'done' WHEN 'assistant' THEN 'see {"verdict": "compliant", "n": ' || turn || '} end' ELSE text END AS resp FROM conversations"""


def responses(spark, sf):
    """Free-text responses holding fenced JSON, bare JSON or no JSON."""
    num = F.col("turn").cast("string")
    resp = (
        F.when(F.col("role") == "user", F.concat(
            F.lit('Answer:\n```json\n{"verdict": "violation", "n": '), num, F.lit("}\n```\ndone")))
        .when(F.col("role") == "assistant", F.concat(
            F.lit('see {"verdict": "compliant", "n": '), num, F.lit("} end")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "conversations").withColumn("resp", resp)


@query("s10_json_recovery", rf"""
WITH r AS ({RESP_SQL}), c AS (SELECT conv_id, turn, CASE
  WHEN regexp_matches(resp, '```(?:json)?\s*(\{{[\s\S]*?\}}|\[[\s\S]*?\])\s*```') THEN regexp_extract(resp, '```(?:json)?\s*(\{{[\s\S]*?\}}|\[[\s\S]*?\])\s*```', 1)
  WHEN regexp_matches(resp, '\{{[\s\S]*\}}|\[[\s\S]*\]') THEN regexp_extract(resp, '(\{{[\s\S]*\}}|\[[\s\S]*\])', 1) ELSE trim(resp, ' ' || chr(9) || chr(10) || chr(13)) END AS cand FROM r)
SELECT conv_id, turn, CASE WHEN json_valid(cand) THEN 'ok' ELSE 'parse_failed' END AS status,
 CASE WHEN json_valid(cand) THEN json_extract_string(cand, '$.verdict') END AS verdict FROM c""")
def s10(spark, sf):
    c = responses(spark, sf).withColumn("cand", R.json_candidate(F.col("resp")))
    status = R.parse_status(F.col("cand"))
    return c.select(
        "conv_id", "turn", status.alias("status"),
        F.when(status == "ok", F.get_json_object("cand", "$.verdict")).alias("verdict"),
    )


@query("s11_verdict_record", f"""
WITH r AS (SELECT doc_id, quality, toxic, n_chars, text FROM labels JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 'violation' ELSE 'not_established' END AS verdict,
 CASE WHEN toxic = 1 THEN 0.0::DOUBLE ELSE least(greatest(round(n_chars / 1000.0::DOUBLE, 3), 0.0), 1.0) END AS confidence,
 md5(CASE WHEN length(text) > 300 THEN substr(text, 1, 299) || '…' ELSE text END) AS quote_md5,
 md5(CASE WHEN length(text) > 600 THEN substr(text, 1, 599) || '…' ELSE text END) AS reasoning_md5 FROM r""")
def s11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    j = table(spark, sf, "labels").join(d, "doc_id")
    body = F.to_json(F.struct(
        F.when(F.col("quality") == 0, " Violation ").when(F.col("toxic") == 1, "no_violation")
        .otherwise("not established").alias("verdict"),
        F.when(F.col("toxic") == 1, "unknown").otherwise(
            F.round(F.col("n_chars") / 1000.0, 3).cast("string")).alias("confidence"),
        F.col("text").alias("evidence_quote"), F.col("text").alias("reasoning"),
    ))
    j = j.select("doc_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("resp"))
    return R.with_verdict_record(j, "resp").select(
        "doc_id", "verdict", "confidence",
        F.md5("evidence_quote").alias("quote_md5"), F.md5("reasoning").alias("reasoning_md5"),
    )


@query("s12_normalize_findings", with_ctes("gold", f"""
WITH f AS (SELECT doc_id, type_ord, idx, CASE WHEN finding_type = 'other' THEN 'weird' ELSE ' ' || finding_type END AS ft, quote,
  CASE WHEN severity = 'established' THEN ' Established ' ELSE 'none' END AS sev FROM gold)
SELECT doc_id, count(*) AS n, count(*) FILTER (ft = 'weird') AS n_other,
 md5(string_agg(substr(quote, 1, 1500), '|' ORDER BY type_ord, idx)) AS quotes_md5,
 CASE WHEN bool_or(lower(trim(sev)) = 'established') THEN '{POS}' ELSE '{NEG}' END AS overall_verdict FROM f GROUP BY doc_id"""))
def s12(spark, sf):
    """Raw findings as an extraction step returns them, coerced to the schema in the row."""
    d = documents(spark, sf, "doc_id", "text").withColumn(
        "g", X.pack_findings(F.col("text"), N.gold, "finding_type")
    ).where(F.size("g") > 0)
    sev = table(spark, sf, "labels").select(
        "doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), " Established ")
        .otherwise("none").alias("sev"),
    )
    raw = F.transform("g", lambda f: F.struct(
        F.when(f["finding_type"] == "other", F.lit("weird"))
        .otherwise(F.concat(F.lit(" "), f["finding_type"])).alias("finding_type"),
        F.lit("").alias("description"), f["quote"].alias("evidence_quote"),
        F.lit('["33", " "]').alias("cited_articles"), F.col("sev").alias("severity"),
    ))
    j = d.select("doc_id", "g").join(sev, "doc_id")
    rec = j.withColumn("p", F.struct(
        raw.alias("findings"), F.lit("").alias("overall_verdict"), F.lit("x").alias("key_reasoning")
    ))
    out = R.normalize_decision(F.col("p"))
    rec = rec.withColumn("n_", out["findings"]).withColumn("v", out["overall_verdict"])
    return rec.select(
        "doc_id", F.size("n_").cast("long").alias("n"),
        F.size(F.filter("n_", lambda f: f["finding_type"] == "other")).cast("long").alias("n_other"),
        F.md5(F.array_join(F.transform("n_", lambda f: f["evidence_quote"]), "|")).alias("quotes_md5"),
        F.col("v").alias("overall_verdict"),
    )


@query("s13_fact_record", """
SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'contract' ELSE 'tz' END AS doc_type, CASE WHEN l.quality IS NULL THEN 0 ELSE 1 END AS n_brands,
 coalesce(l.toxic = 1, true) AS has_acceptance, CASE WHEN l.quality IS NULL THEN 'not stated' WHEN l.quality = 1 THEN 'true' ELSE 'false' END AS has_penalty
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def s13(spark, sf):
    """Typed facts from partial JSON: extra keys dropped, defaults filled, three states kept."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    known = F.col("quality").isNotNull()
    body = F.to_json(F.struct(
        F.when(F.col("lang") == "en", "contract").alias("doc_type"),
        F.when(known, F.array(F.struct(F.lit("X1").alias("name")))).alias("brands"),
        F.struct(F.when(known, F.col("toxic") == 1).alias("has_acceptance_criteria")).alias("completeness"),
        F.struct(F.when(known, F.col("quality") == 1).alias("has_penalty_clause")).alias("contract_specific"),
        F.lit("dropped").alias("surprise"),
    ))
    f = j.withColumn("f", R.facts_with_defaults(body))
    return f.select(
        "doc_id", "f.doc_type", F.size("f.brands").alias("n_brands"),
        F.col("f.completeness.has_acceptance_criteria").alias("has_acceptance"),
        F.coalesce(F.col("f.contract_specific.has_penalty_clause").cast("string"), F.lit("not stated"))
        .alias("has_penalty"),
    )


# ------------------------------------------------------------------ statistics
BOOT_SUMS = ("matched_specific", "n_gold_specific", "n_pred_specific", "tp", "fp", "fn", "tn")
_S = {k: f"sum({k})" for k in BOOT_SUMS}
_p, _r = div("m", "p"), div("m", "g")
BOOT_METRICS_SQL = {
    "precision": _p, "recall": _r, "f1": div(f"2 * {_p} * {_r}", f"{_p} + {_r}"),
    **{k: v for k, v in binary_sql().items() if k in ("accuracy", "kappa")},
}
_SUM_COLS = "sum(m) AS m, sum(g) AS g, sum(p) AS p, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn"


_WEIGHTED = ", ".join(f"sum({c} * w) AS {c}" for c in ("m", "g", "p", "tp", "fp", "fn", "tn"))
_CUTS = ST.poisson_cuts()
_POISSON_SQL = "CASE " + " ".join(f"WHEN u < {c!r}::DOUBLE THEN {k}" for k, c in enumerate(_CUTS)) + f" ELSE {len(_CUTS)} END"


@query("r01_cluster_bootstrap", with_ctes("records", f"""
WITH pg AS (SELECT notice_id, sum(CASE WHEN verdict = '{POS}' THEN matched_specific ELSE 0 END)::DOUBLE AS m,
   sum(CASE WHEN verdict = '{POS}' THEN n_gold_specific ELSE 0 END)::DOUBLE AS g,
   sum(CASE WHEN verdict = '{POS}' THEN n_pred_specific ELSE 0 END)::DOUBLE AS p,
   count(*) FILTER (verdict = '{POS}' AND pred_strict = '{POS}')::DOUBLE AS tp, count(*) FILTER (verdict = '{NEG}' AND pred_strict = '{POS}')::DOUBLE AS fp,
   count(*) FILTER (verdict = '{POS}' AND pred_strict = '{NEG}')::DOUBLE AS fn, count(*) FILTER (verdict = '{NEG}' AND pred_strict = '{NEG}')::DOUBLE AS tn
  FROM records GROUP BY notice_id),
dr AS (SELECT r.range AS round, pg.*, ('0x' || substr(md5(r.range || ':' || notice_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM pg, range(0, {L.BOOTSTRAP_ROUNDS}) r),
w AS (SELECT *, {_POISSON_SQL} AS w FROM dr),
bt AS (SELECT round, {_WEIGHTED} FROM w GROUP BY round), pt AS (SELECT {_SUM_COLS} FROM pg)
""" + " UNION ALL ".join(
    f"SELECT '{k}' AS metric, (SELECT {r6(e)} FROM pt) AS point, {r6(f'quantile_cont({e}, 0.025)')} AS lo, {r6(f'quantile_cont({e}, 0.975)')} AS hi FROM bt"
    for k, e in BOOT_METRICS_SQL.items())))
def r01(spark, sf):
    rec = records(spark, sf)
    pos, hit = F.col("verdict") == POS, F.col("pred_strict") == POS
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = rec.select(
        "notice_id",
        *[F.when(pos, F.col(c)).otherwise(0).alias(a) for c, a in (
            ("matched_specific", "m"), ("n_gold_specific", "g"), ("n_pred_specific", "p"))],
        one(pos & hit).alias("tp"), one(~pos & hit).alias("fp"),
        one(pos & ~hit).alias("fn"), one(~pos & ~hit).alias("tn"),
    )
    c = {x: F.col(x) for x in ("m", "g", "p", "tp", "fp", "fn", "tn")}
    metrics = G.prf(c["m"], c["g"], c["p"])
    b = G.binary_scores(c["tp"], c["fp"], c["fn"], c["tn"])
    metrics |= {"accuracy": b["accuracy"], "kappa": b["kappa"]}
    return ST.cluster_bootstrap(rows, "notice_id", list(c), metrics, L.BOOTSTRAP_ROUNDS)


PAIRS = [("L0", "L1"), ("L0", "A3"), ("L1", "A3")]


@query("r02_mcnemar", with_ctes("episodes flags", f"WITH p AS ({PRED_SQL}), d AS (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER ("{a}" = verdict AND "{b}" <> verdict) AS only_a,
     count(*) FILTER ("{a}" <> verdict AND "{b}" = verdict) AS only_b FROM p""" for a, b in PAIRS)
    + ") SELECT *, " + r6(div("greatest(abs(only_a - only_b) - 1, 0) * greatest(abs(only_a - only_b) - 1, 0)", "only_a + only_b"))
    + " AS statistic FROM d"))
def r02(spark, sf):
    t = ST.mcnemar(predictions(spark, sf), "verdict", PAIRS)
    return t.select("model_a", "model_b", "only_a", "only_b", F.round("statistic", 6).alias("statistic"))


@query("r02_mcnemar_p_values")
def r02_p(spark, sf):
    t = ST.mcnemar(predictions(spark, sf), "verdict", PAIRS)
    return t.select("model_a", "model_b", F.round("p_value", 9).alias("p_value"))


@query("r03_fleiss_kappa", with_ctes("episodes flags", f"""
WITH p AS ({PRED_SQL}), k AS (SELECT ("L0" = '{POS}')::INT + ("L1" = '{POS}')::INT + ("A3" = '{POS}')::INT AS k FROM p),
a AS (SELECT count(*) AS items, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6.0::DOUBLE) AS o, sum(k) / (count(*) * 3.0::DOUBLE) AS s FROM k)
SELECT items, {r6('o')} AS observed, {r6('s * s + (1 - s) * (1 - s)')} AS expected,
 {r6(div('o - (s * s + (1 - s) * (1 - s))', '1 - (s * s + (1 - s) * (1 - s))'))} AS kappa FROM a"""))
def r03(spark, sf):
    k = ST.fleiss_kappa(predictions(spark, sf), list(LEVELS), POS)
    return k.select("items", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("r04_adjusted_rand", f"""
WITH x AS (SELECT e.label AS a, d.lang AS b FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
c AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sab, (SELECT sum(n) FROM c) AS t,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb)
SELECT {r6('(sab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2))')} AS ari FROM s""")
def r04(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("a"))
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("b"))
    return ST.adjusted_rand(e.join(d, "doc_id"), "a", "b").select(F.round("ari", 6).alias("ari"))


@query("r05_set_agreement", with_ctes("episodes flags", f"""
WITH p AS ({PRED_SQL}) SELECT count(*) FILTER ("L0" = '{POS}' AND "L1" = '{POS}') AS both,
 count(*) FILTER ("L0" = '{POS}' AND "L1" <> '{POS}') AS only_a, count(*) FILTER ("L0" <> '{POS}' AND "L1" = '{POS}') AS only_b FROM p"""))
def r05(spark, sf):
    p = predictions(spark, sf)
    return ST.set_agreement(p, F.col("L0") == POS, F.col("L1") == POS)
