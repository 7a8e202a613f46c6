"""S01-S08 file sources and sinks, Z* streams, fed with files written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow.functions import records as R, text as X
from clauseflow.lexicon import NEUTRAL as N
from clauseflow.plans.base import documents, flags, quoted, with_ctes
from clauseflow.plans.extraction import T07_SQL
from clauseflow.plans.projections import FAMILY_SQL, families
from clauseflow.plans.registry import query, table
from clauseflow.session import cut_lineage, scratch_path, spread
from clauseflow.sources import readers as RD, writers as WR
from clauseflow.streaming import documents as ST
from clauseflow.streaming.windows import sliding_rate, usage_windows

q = quoted
DOC_LINE = "doc_id long, lang string, n_chars long"


def _line_file(spark, sf) -> str:
    """JSON lines in which German rows are cut short and Spanish rows are blank."""
    path = scratch_path(spark, "lines")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    body = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    line = F.when(F.col("lang") == "de", F.substring(body, 1, 12)).when(F.col("lang") == "es", " ").otherwise(body)
    d.select(line.alias("value")).write.text(path)
    return path


@query("s01_jsonl_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE lang NOT IN ('de', 'es')")
def s01(spark, sf):
    good = RD.read_jsonl(spark, _line_file(spark, sf), DOC_LINE)
    absent = RD.read_jsonl(spark, scratch_path(spark, "absent"), DOC_LINE)
    return good.unionByName(absent).where(F.col("doc_id").isNotNull())


@query("s01_jsonl_damage", """
SELECT CASE lang WHEN 'de' THEN 'malformed' WHEN 'es' THEN 'blank' ELSE 'kept' END AS state, count(*) AS n FROM documents GROUP BY 1""")
def s01_damage(spark, sf):
    return RD.jsonl_damage(spark, _line_file(spark, sf), DOC_LINE)


def _decision_files(spark, sf) -> str:
    """One JSON file per page, in three key layouts."""
    path = scratch_path(spark, "decisions")
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    pid, kind = F.col("page_id").cast("string"), F.col("page_id") % 3
    a = F.to_json(F.struct(pid.alias("decision_id"), F.col("html").alias("full_text"), F.col("url").alias("purchase_id")))
    b = F.to_json(F.struct(pid.alias("fas_case_id"), F.col("html").alias("decision_text"), F.lit("").alias("notice_id")))
    c = F.to_json(F.struct(pid.alias("decision_id"), F.lit("").alias("full_text"), F.col("html").alias("decision_text"), F.col("url").alias("notice_id")))
    body = F.when(kind == 0, a).when(kind == 1, b).otherwise(c)
    # one file per page, all in one folder: a folder each would be made and listed one by one
    WR.write_files(spread(p.select(body.alias("value")), "value"), path)
    return path


TRIM = "trim(%s, ' ' || chr(9) || chr(10) || chr(13))"


@query("s02_decision_scan", f"""
WITH t AS (SELECT page_id::VARCHAR AS decision_id, {TRIM % "html"} AS t FROM pages)
SELECT decision_id, CASE WHEN length(t) >= 100 THEN md5(t) ELSE 'none' END AS text_md5 FROM t""")
def s02(spark, sf):
    d = RD.read_decisions(spark, _decision_files(spark, sf))
    return d.select(
        F.coalesce("decision_id", "fas_case_id").alias("decision_id"),
        F.coalesce(F.md5("text"), F.lit("none")).alias("text_md5"),
    )


MANIFEST_SQL = f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'decision_id|full_text|purchase_id' WHEN 1 THEN 'fas_case_id|decision_text|notice_id'
   ELSE 'decision_id|full_text|notice_id' END AS schema_family, CASE page_id % 3 WHEN 0 THEN length({TRIM % 'html'}) WHEN 1 THEN length({TRIM % 'html'}) ELSE 0 END AS n,
   CASE WHEN page_id % 3 = 1 THEN '' ELSE url END AS notice FROM pages"""


@query("s03_decision_manifest", f"""
SELECT page_id::VARCHAR AS canonical_decision_id, notice AS canonical_notice_id, n::INTEGER AS text_length, n > 0 AS has_text, n > 0 AND n < 500 AS is_too_short, schema_family FROM ({MANIFEST_SQL})""")
def s03(spark, sf):
    return RD.decision_manifest(spark, _decision_files(spark, sf)).drop("path")


@query("s03_manifest_summary", f"""
SELECT schema_family, count(*) AS n, count(*) FILTER (n > 0) AS with_text, count(*) FILTER (n > 0 AND n < 500) AS too_short,
  count(*) FILTER (n = 0) AS empty, count(*) FILTER (notice = '') AS without_notice FROM ({MANIFEST_SQL}) GROUP BY schema_family""")
def s03_summary(spark, sf):
    return RD.manifest_summary(RD.decision_manifest(spark, _decision_files(spark, sf)))


@query("s04_specification_folders", "SELECT page_id::VARCHAR AS notice_id, md5(html) AS text_md5 FROM pages")
def s04(spark, sf):
    path = scratch_path(spark, "specs")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("notice"), F.col("html").alias("value"))
    WR.write_files(spread(p, "notice"), path, "notice")
    r = RD.read_specifications(spark, path, r"notice=([^/]+)/")
    return r.select("notice_id", F.md5(F.regexp_replace("text", "\n\\z", "")).alias("text_md5"))


@query("s05_csv_ids", "SELECT lpad(o_orderkey::VARCHAR, 19, '0') AS notice_id, o_orderstatus AS status FROM orders")
def s05(spark, sf):
    path = scratch_path(spark, "orders-csv")
    o = table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 19, "0").alias("notice_id"), F.col("o_orderstatus").alias("status")
    )
    o.write.option("header", True).csv(path)
    return RD.read_csv(spark, path, "notice_id string, status string")


@query("s06_dimension_load", f"""
SELECT f.family, f.size::VARCHAR AS size, f.dependency, coalesce(r.r_name, 'no hint') AS hint FROM ({FAMILY_SQL}) f LEFT JOIN region r ON r.r_regionkey::VARCHAR = f.family[-1:]""")
def s06(spark, sf):
    """Family CSV (all text) joined with the hints object through the family's last digit."""
    base = scratch_path(spark, "dims")
    families(spark, sf).select("family", "size", "dependency").write.option("header", True).csv(base + "/families")
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name")
    # the hints object holds one entry per region, a fixed five
    r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "r_name")))).alias("value")).write.text(base + "/hints")
    fam = RD.read_csv(spark, base + "/families", "family string, size string, dependency string")
    hints = RD.read_hints(spark, base + "/hints")
    j = fam.withColumn("key", F.substring("family", -1, 1)).join(hints, "key", "left")
    return j.select("family", "size", "dependency", F.coalesce("hint", F.lit("no hint")).alias("hint"))


@query("s07_nested_csv_sink", with_ctes("flags", """
SELECT d.doc_id, d.lang, count(quote) AS n, md5(coalesce(string_agg(quote, '|' ORDER BY type_ord, idx), '')) AS quotes_md5
FROM documents d LEFT JOIN flags USING (doc_id) GROUP BY d.doc_id, d.lang"""))
def s07(spark, sf):
    path = scratch_path(spark, "nested-csv")
    quotes = F.transform(X.pack_findings(F.col("text"), N.flags), lambda f: f["quote"])
    WR.write_nested_csv(documents(spark, sf, "doc_id", "lang", "text").withColumn("quotes", quotes), path, ["doc_id", "lang", "quotes"])
    back = RD.read_csv(spark, path, "doc_id long, lang string, quotes string")
    lst = R.parse_json_list(F.col("quotes"))
    return back.select("doc_id", "lang", F.size(lst).cast("long").alias("n"),
                       F.md5(F.array_join(lst, "|")).alias("quotes_md5"))


@query("s08_append_sink", """
SELECT conv_id, turn, role, length(text)::BIGINT AS chars FROM conversations UNION ALL
SELECT conv_id, turn, role, length(text)::BIGINT FROM conversations WHERE role = 'user'""")
def s08(spark, sf):
    path = scratch_path(spark, "log")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    WR.append_jsonl(c, path)
    WR.append_jsonl(c.where(F.col("role") == "user"), path)
    return RD.read_jsonl(spark, path, "conv_id long, turn long, role string, chars long")


# ------------------------------------------------------------------ streams
def _arrivals(spark, df, parts: int, name: str, per_batch: int = 1):
    """Files written from a table, then read back as a stream of arrivals.

    A small table is written as ``parts`` files; a larger one in as many as it has splits, and
    more files arrive together, so that no task's share grows with the table.
    """
    path = scratch_path(spark, name)
    files = max(parts, df.rdd.getNumPartitions())
    df.repartition(files).write.parquet(path)
    return ST.arrivals(spark, path, df.schema, per_batch * -(-files // parts))


@query("z01_incremental_check", T07_SQL)
def z01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out, cp = scratch_path(spark, "checked"), scratch_path(spark, "checked-cp")
    stream = _arrivals(spark, d, 3, "arriving")
    work = lambda s: s.select("doc_id", *X.lexicon_counts(F.col("text"), N))
    ST.drain(ST.check_incrementally(stream, work, out, cp))
    ST.drain(ST.check_incrementally(stream, work, out, cp))  # a restart adds nothing
    r = spark.read.parquet(out)
    for c in ("equivalent_count", "units_count", "standard_count", "restrictive_count"):
        r = r.withColumn(c, F.col(c).cast("long"))
    return r


@query("z02_duplicate_suppression", "SELECT DISTINCT sha256(text) AS doc_hash, lang AS doc_type FROM documents")
def z02(spark, sf):
    d = table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("doc_hash"), F.col("lang").alias("doc_type")
    )
    out, cp = scratch_path(spark, "unique"), scratch_path(spark, "unique-cp")
    s = ST.suppress_duplicates(_arrivals(spark, d, 3, "hashes"), ["doc_hash", "doc_type"])
    ST.drain(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
             .trigger(availableNow=True).start())
    return spark.read.parquet(out).select("doc_hash", "doc_type")


@query("z03_latest_upsert", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def z03(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    tbl, cp = scratch_path(spark, "latest"), scratch_path(spark, "latest-cp")
    key, order = ["user_id"], ["ts", "event_id"]
    ST.drain(ST.upsert_latest(_arrivals(spark, e, 3, "results"), key, order, tbl, cp))
    ST.compact_latest(spark, tbl, key, order)
    return ST.read_latest(spark, tbl, key, order).select("user_id", "event_id", "event_type")


@query("z04_usage_stream", """
WITH w AS (SELECT epoch_us(date_trunc('hour', ts))::BIGINT // 1000000 AS window_start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL)
SELECT * FROM w WHERE (window_start + 3600) * 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 2 * 3600000000""")
def z04_stream(spark, sf):
    """Closed hourly windows of the replayed log (watermark two hours behind)."""
    e = table(spark, sf, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    path, out, cp = (scratch_path(spark, n) for n in ("log-in", "log-out", "log-cp"))
    e.write.parquet(path)
    w = usage_windows(ST.arrivals(spark, path, e.schema).withWatermark("ts", "2 hours"))
    ST.drain(w.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp)
             .outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(out).select(
        F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "cents"
    )


_VERDICT_BUCKET = "('0x' || md5(doc_id::VARCHAR)[1])::BIGINT % 8"


@query("z06_running_gate", f"""
WITH c AS (SELECT {_VERDICT_BUCKET} AS batch, count(*) AS n, count(*) FILTER (regexp_matches(text, {quoted(N.flags[5].pattern)})) AS p FROM documents GROUP BY 1),
s AS (SELECT batch, (sum(n) OVER (ORDER BY batch))::BIGINT AS n_seen, (sum(p) OVER (ORDER BY batch))::BIGINT AS n_positive FROM c),
g AS (SELECT *, n_seen >= 30 AND (n_positive = 0 OR n_positive = n_seen) AS stop FROM s)
SELECT batch, n_seen, n_positive, stop FROM g WHERE batch <= coalesce((SELECT min(batch) FROM g WHERE stop), 8)""")
def z06(spark, sf):
    """Gate log of a stream of verdicts: stops once 30 outputs are all of one class."""
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 8
    d = cut_lineage(
        documents(spark, sf, "doc_id", "text").select(
            "doc_id", draw.alias("bucket"),
            F.when(F.col("text").rlike(N.flags[5].pattern), "violation").otherwise("not_established").alias("verdict"),
        )
    )
    path = scratch_path(spark, "verdicts")
    for b in range(8):  # files arrive one after the other
        d.where(F.col("bucket") == b).drop("bucket").coalesce(1).write.mode("append").parquet(path)
    stream = ST.arrivals(spark, path, d.drop("bucket").schema, 1)
    log = ST.gated(stream, "verdict", "violation", scratch_path(spark, "gate-cp"))
    return spark.createDataFrame(log, "batch long, n_seen long, n_positive long, stop boolean")
