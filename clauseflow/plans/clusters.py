"""V*: retrieval, embeddings, clustering; G20-G22, G28 taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from clauseflow.functions import scalar as S
from clauseflow.operators import clustering as C, metrics as G, retrieval as RT, vectors as VE
from clauseflow.operators.taxonomy import top_values
from clauseflow.operators.windows import top_per_group
from clauseflow.plans.base import documents, episodes, quoted, with_ctes
from clauseflow.plans.projections import (
    CLUSTER_STATS_SQL, FAMILY_SQL, INCLUSION_SQL, LANES, OVERRIDES, SHAPE_SQL, STATUS_SQL, _LANE_SQL,
    cluster_stats, families, scoped_events,
)
from clauseflow.plans.registry import query, table
from clauseflow.plans.reports import SIM_SQL, centroid_similarity, r6
from clauseflow.session import cut_lineage

q = quoted

GRAMS_SQL = r"""(SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM {frm}) WHERE len(t) > 0)"""


@query("v01_tfidf_top_k", f"""
WITH dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM {GRAMS_SQL.format(key='doc_id', frm='documents')} GROUP BY ALL),
qt AS MATERIALIZED (SELECT item_id, term, count(*) AS tf FROM {GRAMS_SQL.format(key='item_id', frm='benchmark')} GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), v AS MATERIALIZED (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (
   SELECT term, count(*)::DOUBLE AS df FROM dt GROUP BY term), n WHERE df >= 2 AND df <= 0.95 * n),
dw AS (SELECT doc_id, term, tf * idf AS w FROM dt JOIN v USING (term)), qw AS (SELECT item_id, term, tf * idf AS w FROM qt JOIN v USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM dw GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY item_id),
s AS (SELECT item_id, doc_id, round(sum(dw.w * qw.w) / (any_value(dn.l) * any_value(qn.l)), 6) AS score
  FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def v01(spark, sf):
    # copies of a text tie on the score and rank by id
    return RT.tfidf_top_k(
        documents(spark, sf, "doc_id", "text"), "doc_id",
        table(spark, sf, "benchmark"), "item_id", "text", 5,
    ).select("item_id", "doc_id", "score", "rank")


MEAN_SQL = """
  x AS (SELECT label::BIGINT AS label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL),
  u AS (SELECT label, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-12) AS m FROM c)"""


def centroids(spark, sf):
    """Unit mean vector of each cluster label."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "embedding")
    return VE.group_mean(e, "label", "embedding", "_m").select("label", VE.unit(F.col("_m")).alias("vector"))


DENSE_SQL = f"""WITH {MEAN_SQL}, q AS (SELECT label, list(m ORDER BY i) AS v FROM u GROUP BY label),
 s AS (SELECT q.label AS query_id, e.vec_id AS item_id, round(greatest(0.0, list_dot_product(q.v, e.embedding::DOUBLE[])), 6) AS score FROM q, embeddings e),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""


@query("v02_dense_top_k", f"{DENSE_SQL} SELECT query_id, item_id, round(score, 3) AS similarity, rank::INTEGER AS rank FROM h WHERE rank <= 15")
def v02(spark, sf):
    e = table(spark, sf, "embeddings")
    hits = RT.dense_top_k(e, "vec_id", "embedding", centroids(spark, sf), "label", "vector", 15)
    return hits.select("query_id", "item_id", F.round("score", 3).alias("similarity"), "rank")


@query("v03_distinct_cases", f"""{DENSE_SQL}, d AS (SELECT query_id, source, item_id, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) AS r
  FROM h JOIN documents ON doc_id = item_id WHERE rank <= 15)
SELECT query_id, source, item_id, round(score, 3) AS similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM d WHERE r = 1) WHERE rank <= 5""")
def v03(spark, sf):
    """Fetch three times k, keep the best hit per source, cut to k."""
    e = table(spark, sf, "embeddings")
    hits = RT.dense_top_k(e, "vec_id", "embedding", centroids(spark, sf), "label", "vector", 15)
    src = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source")
    out = RT.distinct_cases(hits.drop("rank").join(src, "item_id"), "source", 5)
    return out.select("query_id", "source", "item_id", F.round("score", 3).alias("similarity"), "rank")


@query("v04_group_embeddings", f"WITH {MEAN_SQL} SELECT label, i::INTEGER AS pos, round(m, 6) AS value, round(sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS norm FROM u")
def v04(spark, sf):
    c = centroids(spark, sf).withColumn("norm", F.round(VE.norm(F.col("vector")), 6))
    return c.select("label", "norm", F.posexplode("vector").alias("p", "x")).select(
        "label", (F.col("p") + 1).alias("pos"), F.round("x", 6).alias("value"), "norm"
    )


@query("v05_reduce_dimensions")
def v05(spark, sf):
    r = C.reduce_dims(table(spark, sf, "embeddings"), "vec_id", "embedding", 10)
    return r.select("vec_id", F.posexplode("components").alias("component", "value"))


@query("v05_plane")
def v05_plane(spark, sf):
    """The same reduction cut to two components, as a point in the plane."""
    r = C.reduce_dims(table(spark, sf, "embeddings"), "vec_id", "embedding", 2)
    return r.select("vec_id", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"))


EPS = 1.0


def density_sql(key: str, vectors: str, eps: float) -> str:
    """Clusters by comparing all pairs of the rows (id, v) of ``vectors``."""
    return f"""
WITH RECURSIVE e AS MATERIALIZED ({vectors}),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE 2 - 2 * list_dot_product(a.v, b.v) <= {eps * eps!r} + 1e-9),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
ce AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core x ON near.a = x.id SEMI JOIN core y ON near.b = y.id),
reach(id, r) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.id),
lab AS (SELECT id, min(r) AS c FROM reach GROUP BY id), big AS (SELECT c FROM lab GROUP BY c HAVING count(*) >= 5)
SELECT e.id AS {key}, CASE WHEN big.c IS NOT NULL THEN lab.c ELSE -1 END AS cluster_id FROM e LEFT JOIN lab USING (id) LEFT JOIN big USING (c)"""


@query("v06_density_clusters", density_sql("vec_id", "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings", EPS))
def v06(spark, sf):
    return C.density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding", 64, EPS)


#: Characters whose shares are the profile of a text.
PROFILE = "abcdefghijklmnopqrstuvwxyzäöüßéèêçáíóúñ0123456789 .,;:!?-'()@/_"
PROFILE_EPS = 0.03
_COUNTED = ", ".join(f"length(t) - length(replace(t, {quoted(c)}, ''))" for c in PROFILE)
PROFILE_VECTOR_SQL = f"""SELECT doc_id AS id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v FROM (
  SELECT doc_id, list_transform([{_COUNTED}], lambda x: x::DOUBLE) AS c FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE list_sum(c) > 0"""


@query("v06_profile_clusters", density_sql("doc_id", PROFILE_VECTOR_SQL, PROFILE_EPS))
def v06_profiles(spark, sf):
    """Texts by the shares of their characters: languages and near copies are dense, the rest is noise."""
    docs = documents(spark, sf, "doc_id", "text")
    c = docs.select("doc_id", VE.char_counts(F.lower("text"), PROFILE).alias("c"))
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    unit = c.select("doc_id", "c", size.alias("size")).where("size > 0").select(
        "doc_id", F.transform("c", lambda x: x / F.col("size")).alias("v")
    )
    return C.density_clusters(cut_lineage(unit), "doc_id", "v", len(PROFILE), PROFILE_EPS)


MEMBER_SQL = """SELECT e.label::BIGINT AS cluster_id, d.doc_id, d.source, d.lang, e.vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id"""


def members(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("cluster_id")
    )
    return table(spark, sf, "documents").select("doc_id", "source", "lang").join(e, "doc_id")


def _top_sql(col: str) -> str:
    return f"""(SELECT cluster_id, string_agg(v || '=' || n, ';' ORDER BY rn) AS top FROM (
      SELECT cluster_id, {col} AS v, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {col}) AS rn
      FROM m GROUP BY cluster_id, {col}) WHERE rn <= 3 GROUP BY cluster_id)"""


PROFILE_SQL = f"""m AS ({MEMBER_SQL}), pr AS (SELECT s.*, a.top AS top_sources, b.top AS top_langs FROM
  (SELECT cluster_id, count(*) AS size, count(DISTINCT source) AS n_sources FROM m GROUP BY cluster_id) s
  JOIN {_top_sql('source')} a USING (cluster_id) JOIN {_top_sql('lang')} b USING (cluster_id))"""


def profiles(spark, sf):
    m = members(spark, sf)
    base = m.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct("source").alias("n_sources")
    )
    return base.join(top_values(m, ["cluster_id"], "source", 3, "top_sources"), "cluster_id").join(
        top_values(m, ["cluster_id"], "lang", 3, "top_langs"), "cluster_id"
    )


@query("v07_cluster_profile", f"WITH {PROFILE_SQL} SELECT * FROM pr")
def v07(spark, sf):
    return profiles(spark, sf)


# three clustering configurations: coarse joins labels pairwise, fine splits them by language
CONFIG_SQL = """SELECT 'default' AS config, doc_id, cluster_id, (CASE WHEN doc_id % 10 = 0 THEN -1 ELSE cluster_id END)::BIGINT AS label FROM m
  UNION ALL SELECT 'coarse', doc_id, cluster_id, (CASE WHEN doc_id % 50 = 0 THEN -1 ELSE cluster_id // 2 END)::BIGINT FROM m
  UNION ALL SELECT 'fine', doc_id, cluster_id, (CASE WHEN doc_id % 3 = 0 THEN -1 ELSE cluster_id * 10 + length(source) END)::BIGINT FROM m"""


def configs(spark, sf):
    m = members(spark, sf)
    c, d = F.col("cluster_id"), F.col("doc_id")
    noise = F.lit(-1).cast("long")
    rows = F.array(
        F.struct(F.lit("default").alias("config"), F.when(d % 10 == 0, noise).otherwise(c).alias("label")),
        F.struct(F.lit("coarse").alias("config"), F.when(d % 50 == 0, noise).otherwise(F.floor(c / 2)).alias("label")),
        F.struct(F.lit("fine").alias("config"), F.when(d % 3 == 0, noise).otherwise(c * 10 + F.length("source")).alias("label")),
    )
    return m.select("doc_id", "source", F.inline(rows))


CONFIG_METRICS_SQL = f"""m AS ({MEMBER_SQL}), a AS ({CONFIG_SQL}), s AS (SELECT config, label, count(*) AS n FROM a GROUP BY ALL),
 cm AS (SELECT config, count(*) FILTER (label <> -1) AS n_clusters, coalesce(sum(n) FILTER (label = -1), 0)::BIGINT AS noise_count,
  round(coalesce(sum(n) FILTER (label = -1), 0) / sum(n)::DOUBLE, 4) AS noise_share, max(n) FILTER (label <> -1) AS largest,
  round(max(n) FILTER (label <> -1) / sum(n)::DOUBLE, 4) AS largest_share, median(n) FILTER (label <> -1)::DOUBLE AS median_size FROM s GROUP BY config)"""


def config_metrics(spark, sf):
    s = configs(spark, sf).groupBy("config", "label").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("label") != -1
    noise = F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0))
    big = F.max(F.when(real, F.col("n")))
    return s.groupBy("config").agg(
        F.count_if(real).alias("n_clusters"), noise.alias("noise_count"),
        F.round(noise / F.sum("n"), 4).alias("noise_share"), big.alias("largest"),
        F.round(big / F.sum("n"), 4).alias("largest_share"),
        F.median(F.when(real, F.col("n"))).alias("median_size"),
    )


@query("v08_config_metrics", f"WITH {CONFIG_METRICS_SQL} SELECT * FROM cm")
def v08(spark, sf):
    return config_metrics(spark, sf)


@query("v09_config_choice", f"""WITH {CONFIG_METRICS_SQL}, z AS (SELECT *, noise_share <= 0.30 AS ok, (SELECT n_clusters FROM cm WHERE config = 'default') AS dn FROM cm)
SELECT config AS recommended, noise_share FROM z WHERE ok OR NOT (SELECT bool_or(ok) FROM z)
ORDER BY noise_share + 0.5 * largest_share, abs(n_clusters - dn), config <> 'default' LIMIT 1""")
def v09(spark, sf):
    """Eligible configurations (noise at most 30 %) or, failing that, all; best score first."""
    w = Window.partitionBy(F.lit(0))  # one row per configuration
    z = config_metrics(spark, sf).withColumn("ok", F.col("noise_share") <= 0.30)
    z = z.withColumn("any_ok", F.bool_or("ok").over(w)).withColumn(
        "dn", F.max(F.when(F.col("config") == "default", F.col("n_clusters"))).over(w)
    )
    best = z.where(F.col("ok") | ~F.col("any_ok")).orderBy(
        F.col("noise_share") + 0.5 * F.col("largest_share"), F.abs(F.col("n_clusters") - F.col("dn")),
        F.col("config") != "default",
    ).limit(1)
    return best.select(F.col("config").alias("recommended"), "noise_share")


@query("v10_decision_coherence", f"""WITH m AS ({MEMBER_SQL}), c AS (SELECT source, count(*) AS n, count(DISTINCT CASE WHEN doc_id % 10 > 0 THEN cluster_id END) AS k FROM m GROUP BY source HAVING count(*) >= 2)
SELECT count(*) AS decisions, median(k)::DOUBLE AS median_clusters, quantile_disc(k, 0.9) AS p90_clusters, max(k) AS max_clusters FROM c""")
def v10(spark, sf):
    a = configs(spark, sf).where(F.col("config") == "default")
    c = a.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("k"),
    ).where(F.col("n") >= 2)
    # k is at most the number of clusters, so the quantiles run on few distinct values
    return c.agg(
        F.count(F.lit(1)).alias("decisions"), F.median("k").alias("median_clusters"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY k)").cast("long").alias("p90_clusters"),
        F.max("k").alias("max_clusters"),
    )


LISTS_SQL = f"""WITH c AS ({CLUSTER_STATS_SQL}), f AS (SELECT *, round(top_count / size::DOUBLE, 4) AS share FROM c)
SELECT * FROM (SELECT 'clean' AS list, cluster_id, size, share FROM f WHERE share >= 0.55 AND n_scopes <= 4 AND size BETWEEN 20 AND 160 ORDER BY size DESC, cluster_id LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'dirty', cluster_id, size, share FROM f WHERE share < 0.75 OR n_scopes >= 3 ORDER BY share, size DESC, cluster_id LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'broad', cluster_id, size, share FROM f WHERE size >= 50 ORDER BY size DESC, cluster_id LIMIT 3)"""


@query("v11_candidate_lists", LISTS_SQL)
def v11(spark, sf):
    f = cluster_stats(spark, sf).withColumn("share", F.round(F.col("top_count") / F.col("size"), 4))

    def pick(name, cond, order, k):
        return f.where(cond).orderBy(*order).limit(k).select(
            F.lit(name).alias("list"), "cluster_id", "size", "share"
        )

    share, size, cid = F.col("share"), F.desc("size"), F.asc("cluster_id")
    clean = (share >= 0.55) & (F.col("n_scopes") <= 4) & F.col("size").between(20, 160)
    return (
        pick("clean", clean, [size, cid], 3)
        .unionByName(pick("dirty", (share < 0.75) | (F.col("n_scopes") >= 3), [F.asc("share"), size, cid], 2))
        .unionByName(pick("broad", F.col("size") >= 50, [size, cid], 3))
    )


@query("v12_cluster_payload", f"""WITH {SIM_SQL}, {PROFILE_SQL}, st AS ({CLUSTER_STATS_SQL}),
t AS (SELECT cluster_id, vec_id, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, vec_id) AS rn FROM sim)
SELECT pr.cluster_id, pr.size, n_sources, top_sources, top_langs, (SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY rn) FROM t WHERE rn <= 10 AND t.cluster_id = pr.cluster_id) AS top_members,
 (SELECT {SHAPE_SQL} FROM st WHERE st.cluster_id = pr.cluster_id) AS shape FROM pr""")
def v12(spark, sf):
    top = top_per_group(centroid_similarity(spark, sf), ["cluster_id"], [F.desc("sim"), F.asc("vec_id")], 10)
    top = top.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "vec_id"))).alias("a")  # ten rows per cluster
    ).select("cluster_id", F.array_join(F.transform("a", lambda x: x["vec_id"].cast("string")), ",").alias("top_members"))
    shape, _ = S.cluster_shape(F.col("cluster_id"), F.col("size"), F.col("top_count"), F.col("n_scopes"), OVERRIDES)
    shapes = cluster_stats(spark, sf).select("cluster_id", shape.alias("shape"))
    return profiles(spark, sf).join(top, "cluster_id").join(shapes, "cluster_id")


# ------------------------------------------------------------------ taxonomy tables
@query("g20_scope_inclusion", f"""
SELECT scope_tag, count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'excluded') AS excluded, count(*) AS total
FROM ({INCLUSION_SQL}) GROUP BY scope_tag""")
def g20(spark, sf):
    p = scoped_events(spark, sf).groupBy("scope_tag").pivot("status", ["included", "excluded"]).count().fillna(0)
    return p.withColumn("total", F.col("included") + F.col("excluded"))


@query("g21_assessed_share", """
SELECT p_type AS hypothesis, count(*) AS n_rows, count(*) FILTER (p_size > 10) AS assessed, round(1 - count(*) FILTER (p_size <= 10) / count(*)::DOUBLE, 4) AS assessed_share
FROM part GROUP BY p_type""")
def g21(spark, sf):
    skip = F.col("p_size") <= 10
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("hypothesis")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~skip).alias("assessed"),
        F.round(1 - F.count_if(skip) / F.count(F.lit(1)), 4).alias("assessed_share"),
    )


@query("g22_family_table", f"""
WITH f AS ({FAMILY_SQL}), s AS (SELECT family, size, {STATUS_SQL} AS status FROM f),
m AS (SELECT DISTINCT p_brand AS family, l_orderkey AS notice FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT family, count(*) AS n_notices, count(o_orderkey) FILTER (o_orderstatus = 'F') AS covered FROM m LEFT JOIN orders ON o_orderkey = notice GROUP BY family),
r AS (SELECT p_brand AS family, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
SELECT family, size, status, n_notices, covered || '/' || n_notices AS coverage, (SELECT string_agg(p_partkey::VARCHAR, ',' ORDER BY rn) FROM r WHERE r.family = s.family AND rn <= 3) AS representatives
FROM s JOIN n USING (family)""")
def g22(spark, sf):
    status, _ = S.family_status(*[F.col(c) for c in ("size", "dependency", "knowledge", "qc", "attention")])
    s = families(spark, sf).select("family", "size", status.alias("status"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("family"), "p_retailprice")
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("notice"))
    m = li.join(p.select("p_partkey", "family"), "p_partkey").select("family", "notice").distinct()
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("notice"), (F.col("o_orderstatus") == "F").alias("has_doc")
    )
    n = m.join(o, "notice", "left").groupBy("family").agg(
        F.count(F.lit(1)).alias("n_notices"), F.count_if(F.coalesce("has_doc", F.lit(False))).alias("covered")
    )
    top = top_per_group(p, ["family"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)
    rep = top.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rn", "p_partkey"))).alias("a"))
    rep = rep.select("family", F.array_join(F.transform("a", lambda x: x["p_partkey"].cast("string")), ",").alias("representatives"))
    return s.join(n, "family").join(rep, "family").select(
        "family", "size", "status", "n_notices",
        F.concat_ws("/", F.col("covered").cast("string"), F.col("n_notices").cast("string")).alias("coverage"),
        "representatives",
    )


@query("g22_status_totals", f"""WITH f AS ({FAMILY_SQL}), s AS (SELECT size, {STATUS_SQL} AS status FROM f)
SELECT status, count(*) AS n_families, sum(size)::BIGINT AS n_episodes FROM s GROUP BY status""")
def g22_totals(spark, sf):
    status, _ = S.family_status(*[F.col(c) for c in ("size", "dependency", "knowledge", "qc", "attention")])
    return families(spark, sf).groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n_families"), F.sum("size").alias("n_episodes")
    )


@query("g28_corpus_landscape", with_ctes("episodes", """
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS notices, count(*) AS episodes,
 count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS named_clusters, count(*) FILTER (cluster_id <> -1) AS named_episodes,
 count(*) FILTER (cluster_id = -1) AS noise FROM episodes"""))
def g28(spark, sf):
    d = table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("notices")
    )
    named = F.col("cluster_id") != -1
    e = episodes(spark, sf).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_distinct(F.when(named, F.col("cluster_id"))).alias("named_clusters"),
        F.count_if(named).alias("named_episodes"), F.count_if(~named).alias("noise"),
    )
    return d.crossJoin(e)  # two single-row tables
