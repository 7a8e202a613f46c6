"""W*: windows, sorts, top-k and samples; Z04/Z05 batch twins of the stream operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clauseflow import lexicon as L
from clauseflow.functions.text import collapse_spaces
from clauseflow.operators import windows as WI
from clauseflow.plans.base import documents, episodes, flags, gold, quoted, with_ctes
from clauseflow.plans.projections import INCLUSION_SQL, scoped_events
from clauseflow.plans.registry import query, table
from clauseflow.plans.reports import SIM_SQL, UNMATCHED_SQL, centroid_similarity, unmatched
from clauseflow.streaming.windows import sliding_rate, usage_windows

q = quoted


@query("w01_latest_record", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
 FROM conversations) WHERE rn = 1""")
def w01(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return WI.latest_per_key(c, ["conv_id"], ["turn"])


@query("w02_dedupe_findings", with_ctes("flags", r"""
WITH k AS (SELECT *, flag_type || '|' || lower(substr(trim(regexp_replace(quote, '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g')), 1, 60)) AS key FROM flags)
SELECT doc_id, flag_type, idx, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key
  ORDER BY confidence DESC, type_ord * 100000 + idx) AS rn FROM k) WHERE rn = 1"""))
def w02(spark, sf):
    key = F.concat("flag_type", F.lit("|"), F.lower(F.substring(collapse_spaces(F.col("quote")), 1, 60)))
    f = flags(spark, sf).select(
        "doc_id", key.alias("key"), "flag_type", "idx", "confidence",
        (F.col("type_ord") * 100000 + F.col("idx")).alias("ord"),
    )
    d = WI.dedupe_strongest(f, ["doc_id", "key"], "confidence", "ord")
    return d.select("doc_id", "flag_type", "idx", "confidence")


@query("w03_unmatched_gold", with_ctes("type_counts gold", f"SELECT doc_id, finding_type, idx, quote FROM ({UNMATCHED_SQL})"))
def w03(spark, sf):
    return unmatched(spark, sf).select("doc_id", "finding_type", "idx", "quote")


@query("w04_unique_representatives", with_ctes("flags", """
WITH b AS (SELECT flag_type, doc_id, max(confidence) AS confidence FROM flags GROUP BY ALL)
SELECT flag_type, doc_id, confidence, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY flag_type ORDER BY confidence DESC, doc_id) AS rn FROM b) WHERE rn <= 5"""))
def w04(spark, sf):
    """Distinct keys first (partial aggregation), then the top rows of each group."""
    best = flags(spark, sf).groupBy("flag_type", "doc_id").agg(F.max("confidence").alias("confidence"))
    return WI.top_per_group(best, ["flag_type"], [F.desc("confidence"), F.asc("doc_id")], 5)


SYS_SQL = """row_number() OVER ({part} ORDER BY {order}) - 1 AS row_idx, count(*) OVER ({part}) AS n_rows"""


def picked_sql(n: int) -> str:
    """Membership test of the systematic sample in SQL."""
    picks = f"list_transform(range(0, {n}), lambda i: least(n_rows - 1, round_even(i * n_rows / {n}.0::DOUBLE, 0)::BIGINT))"
    return f"(n_rows <= {n} OR list_contains({picks}, row_idx))"


@query("w05_systematic_sample", f"""
SELECT doc_id, row_idx, n_rows FROM (SELECT doc_id, {SYS_SQL.format(part='', order='n_chars DESC, doc_id')} FROM documents) WHERE {picked_sql(25)}""")
def w05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    bucket = WI.even_buckets(d, "n_chars", "doc_id", descending=True)
    idx = WI.ordered_index(d, [F.desc("n_chars"), F.asc("doc_id")], bucket)
    return WI.systematic_sample(idx, 25).select("doc_id", "row_idx", "n_rows")


@query("w06_stratified_sample", with_ctes("flags", """
WITH d AS (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM flags) AS has, md5(doc_id::VARCHAR) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, has ORDER BY h) AS rn FROM d),
f AS (SELECT *, (has AND rn <= 8) OR (NOT has AND rn <= 2) AS first_pick FROM r WHERE rn <= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY first_pick DESC, h) AS pick FROM f)
SELECT lang, doc_id, has FROM o WHERE pick <= 10"""))
def w06(spark, sf):
    """Per stratum 8 with and 2 without findings, topped up to 10 in hash order."""
    from clauseflow.functions import text as X
    from clauseflow.lexicon import NEUTRAL as N

    has = None
    for p in N.flags:
        c = F.col("text").rlike(p.pattern)
        has = c if has is None else has | c
    d = documents(spark, sf, "doc_id", "text", "lang").select(
        "doc_id", "lang", has.alias("has"), WI.hash_order("doc_id").alias("h")
    )
    # at most ten candidates per (stratum, has) survive, so the second window is tiny
    r = WI.top_per_group(d, ["lang", "has"], [F.asc("h")], 10)
    first = (F.col("has") & (F.col("rn") <= 8)) | (~F.col("has") & (F.col("rn") <= 2))
    o = WI.top_per_group(r.withColumn("first_pick", first), ["lang"],
                         [F.desc("first_pick"), F.asc("h")], 10, "pick")
    return o.select("lang", "doc_id", "has")


@query("w07_class_sample", """
SELECT doc_id, quality, rn::INTEGER AS rn FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR)) AS rn FROM labels) WHERE rn <= 25""")
def w07(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return WI.top_per_group(lab, ["quality"], [WI.hash_order("doc_id")], 25)


@query("w08_centroid_members", f"""
WITH {SIM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, vec_id) AS near,
  row_number() OVER (PARTITION BY cluster_id ORDER BY sim, vec_id) AS far FROM sim)
SELECT cluster_id, vec_id, sim, 'representative' AS kind, near::INTEGER AS rn FROM r WHERE near <= 5
UNION ALL SELECT cluster_id, vec_id, sim, 'borderline', far::INTEGER FROM r WHERE far <= 3""")
def w08(spark, sf):
    s = centroid_similarity(spark, sf)
    near = WI.top_per_group(s, ["cluster_id"], [F.desc("sim"), F.asc("vec_id")], 5)
    far = WI.top_per_group(s, ["cluster_id"], [F.asc("sim"), F.asc("vec_id")], 3)
    cols = ["cluster_id", "vec_id", "sim", "kind", "rn"]
    return near.withColumn("kind", F.lit("representative")).select(*cols).unionByName(
        far.withColumn("kind", F.lit("borderline")).select(*cols)
    )


@query("w09_multi_key_sort", """
SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.quality DESC NULLS LAST, d.n_chars, d.doc_id""")
def w09(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.orderBy(
        F.desc_nulls_last("quality"), F.asc("n_chars"), F.asc("doc_id")
    ).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "n_chars")


@query("w10_element_position", with_ctes("gold", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY type_ord, idx)::INTEGER AS episode_idx, finding_type, quote FROM gold"""))
def w10(spark, sf):
    """1-based positions from the array order; no window is needed."""
    from clauseflow.functions import text as X
    from clauseflow.lexicon import NEUTRAL as N

    d = documents(spark, sf, "doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"
    )
    e = d.select("doc_id", F.posexplode(X.pack_findings(F.col("text"), N.gold, "finding_type")).alias("i", "f"))
    return e.select("doc_id", (F.col("i") + 1).alias("episode_idx"), "f.finding_type", "f.quote")


@query("w11_first_examples", f"""
WITH s AS ({INCLUSION_SQL}), f AS (SELECT event_id, scope_tag, row_number() OVER (PARTITION BY scope_tag ORDER BY event_id) AS rn FROM s),
p AS (SELECT event_id, scope_tag, rn <= 1 AS first_of_tag FROM f WHERE rn <= 5)
SELECT event_id, scope_tag, first_of_tag FROM p ORDER BY first_of_tag DESC, event_id LIMIT 5""")
def w11(spark, sf):
    """First example per tag, filled to five in record order."""
    s = scoped_events(spark, sf).select("event_id", "scope_tag")
    f = WI.top_per_group(s, ["scope_tag"], [F.asc("event_id")], 5)
    f = f.withColumn("first_of_tag", F.col("rn") <= 1)
    return f.orderBy(F.desc("first_of_tag"), F.asc("event_id")).limit(5).select(
        "event_id", "scope_tag", "first_of_tag"
    )


POOLS = (("doc_content", 8), ("bid_evaluation", 6), ("procedural", 6))


@query("w12_boundary_pool", f"""
WITH s AS (SELECT event_id, scope_tag, value FROM ({INCLUSION_SQL}) WHERE has_docs AND scope_tag IN ('doc_content','bid_evaluation','procedural')),
i AS (SELECT *, {SYS_SQL.format(part='PARTITION BY scope_tag', order='value DESC, event_id')} FROM s),
p AS (SELECT *, CASE scope_tag WHEN 'doc_content' THEN {picked_sql(8)} ELSE {picked_sql(6)} END AS picked FROM i),
t AS (SELECT *, row_number() OVER (ORDER BY picked DESC, CASE scope_tag WHEN 'doc_content' THEN 1 WHEN 'bid_evaluation' THEN 2 ELSE 3 END, row_idx) AS o FROM p)
SELECT event_id, scope_tag, row_idx, picked FROM t WHERE picked OR o <= 20""")
def w12(spark, sf):
    """Balanced systematic picks of three pools, topped up to 20 in pool order."""
    names = [n for n, _ in POOLS]
    s = scoped_events(spark, sf).where(F.col("has_docs") & F.col("scope_tag").isin(*names)).select(
        "event_id", "scope_tag", "value"
    )
    bucket = WI.even_buckets(s, "value", "event_id", descending=True)
    idx = WI.ordered_index(s, [F.desc("value"), F.asc("event_id")], bucket, ["scope_tag"])
    picks = None
    for name, n in POOLS:
        part = WI.systematic_sample(idx.where(F.col("scope_tag") == name), n)
        picks = part if picks is None else picks.unionByName(part)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("scope_tag"))
    # the top-up can only come from the first rows of each pool
    fill = idx.where(F.col("row_idx") < 20)
    marked = picks.withColumn("picked", F.lit(True)).unionByName(
        fill.join(picks.select("event_id"), "event_id", "left_anti").withColumn("picked", F.lit(False))
    )
    best = marked.orderBy(F.desc("picked"), rank, "row_idx").limit(20)
    return best.select("event_id", "scope_tag", "row_idx", "picked")


@query("w13_review_sample", """
WITH c AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS rn FROM c WHERE n >= 4 OR roles >= 3)
SELECT 'random' AS kind, conv_id FROM (SELECT conv_id FROM c ORDER BY md5(conv_id::VARCHAR) LIMIT 20)
UNION ALL SELECT 'edge', conv_id FROM e WHERE rn <= 10""")
def w13(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles")
    )
    rand = c.orderBy(WI.hash_order("conv_id")).limit(20)
    edge = c.where((F.col("n") >= 4) | (F.col("roles") >= 3)).orderBy("conv_id").limit(10)
    return rand.select(F.lit("random").alias("kind"), "conv_id").unionByName(
        edge.select(F.lit("edge").alias("kind"), "conv_id")
    )


@query("w14_history", """
SELECT event_id, epoch_us(ts)::BIGINT AS ts_us, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def w14(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    top = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return top.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type")


# ------------------------------------------------------------------ batch twins of streams
@query("z04_usage_windows", """
SELECT epoch_us(date_trunc('hour', ts))::BIGINT // 1000000 AS window_start, event_type, count(*) AS n,
 sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL""")
def z04(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = usage_windows(e)
    return w.select(
        F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "cents"
    )


@query("z05_trailing_rate", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
  RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n_trailing FROM events""")
def z05(spark, sf):
    from clauseflow.operators.windows import trailing_count

    e = table(spark, sf, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    return trailing_count(e, "user_id", "us", "event_id", 3_600_000_000).select(
        "event_id", "user_id", "n_trailing"
    )


@query("z05_sliding_windows", """
WITH w AS (SELECT user_id, (epoch_us(ts)::BIGINT // 600000000 - g.range) * 600 AS start FROM events, range(0, 6) g)
SELECT user_id, start AS window_start, count(*) AS n, count(*) > 3 AS over_limit FROM w GROUP BY user_id, start""")
def z05_sliding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = sliding_rate(e, "1 hour", "10 minutes", 3)
    return w.select("user_id", F.unix_seconds("window.start").alias("window_start"), "n", "over_limit")
