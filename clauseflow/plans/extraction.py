"""T*: text extraction and text rules over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import positional as Q, text as X
from clauseflow.lexicon import NEUTRAL as N
from clauseflow.plans.base import documents, gold, quoted, with_ctes
from clauseflow.plans.registry import query, table
from clauseflow.session import spread

q = quoted
_STOP = ", ".join(q(s) for s in N.stop_tokens)
MODEL_FILTER = (
    f"length(c) >= 3 AND upper(c) NOT IN ({_STOP}) "
    r"AND length(regexp_replace(c, '[^\p{L}]', '', 'g')) >= 2 "
    r"AND NOT regexp_matches(c, '^(?:I{1,3}|IV|V|VI{0,3}|IX|X)(?:$|[^\p{L}\p{N}_])')"
)
# offsets in SQL: text pieces between matches, accumulated
MODEL_POS_SQL = f"""
  SELECT doc_id, text, trim(m) AS c, (sum(length(p) + length(coalesce(full_m, '')))
       OVER (PARTITION BY doc_id ORDER BY i) - length(full_m) + length(full_m) - length(m))::BIGINT AS pos
  FROM (SELECT doc_id, text, unnest(regexp_split_to_array(text, {q(N.model_code)})) AS p,
     unnest(regexp_extract_all(text, {q(N.model_code)}, 0)) AS full_m,
     unnest(regexp_extract_all(text, {q(N.model_code)}, 1)) AS m,
     generate_subscripts(regexp_split_to_array(text, {q(N.model_code)}), 1) AS i FROM documents)
  WHERE m IS NOT NULL"""
GUARD = (
    f"regexp_matches(substr(text, greatest(0, pos - 200)::BIGINT + 1,"
    f" (pos + 200 - greatest(0, pos - 200))::BIGINT), {q(N.equivalent)})"
)
AROUND = (
    "trim(translate(substr(text, greatest(0, pos - 30)::BIGINT + 1,"
    " (pos + 70 - greatest(0, pos - 30))::BIGINT), chr(10), ' '))"
)


def brand_rows(spark, sf, sources=None, keep_text=False):
    """Brand mentions per document."""
    d = documents(spark, sf, "doc_id", "text").where(Q.brand_candidate(F.col("text"), N))
    d = d.withColumn("b", Q.brands(F.col("text"), N, sources))
    cols = ["doc_id"] + (["text"] if keep_text else [])
    return d.select(*cols, F.explode("b").alias("b")).select(*cols, "b.*")


def _pieces(p: str, cond: str, frm: str = "documents", key: str = "doc_id", col: str = "text") -> str:
    """Spans of a pattern in SQL by accumulating the pieces between matches."""
    return f"""SELECT {key}, {col}, m, e - length(m) AS s, e FROM (
     SELECT {key}, {col}, m, (sum(length(p) + length(coalesce(m, ''))) OVER (PARTITION BY {key} ORDER BY i))::BIGINT AS e
     FROM (SELECT {key}, {col}, unnest(regexp_split_to_array({col}, {q(p)})) AS p,
        unnest(regexp_extract_all({col}, {q(p)}, 0)) AS m,
        generate_subscripts(regexp_split_to_array({col}, {q(p)}), 1) AS i FROM {frm})) WHERE m IS NOT NULL AND {cond}"""


# documents hold no quoted names, so the SQL follows the model-code path of the operator
@query("t01_marker_brands", f"""
WITH m AS ({_pieces(N.brand_marker, 'true')}), t AS (SELECT doc_id, text, e, substr(text, e + 1, 80) AS tail FROM m),
x AS (SELECT doc_id, text, e, trim(regexp_extract(tail, {q(N.model_code)}, 1)) AS c,
   regexp_extract(tail, {q(N.model_code)}, 1) AS raw, regexp_extract(tail, {q(N.model_code)}, 0) AS full_m,
   regexp_split_to_array(tail, {q(N.model_code)})[1] AS head FROM t WHERE regexp_matches(tail, {q(N.model_code)})),
y AS (SELECT doc_id, text, c, (e + length(head) + length(full_m) - length(raw))::BIGINT AS pos FROM x WHERE {MODEL_FILTER})
SELECT DISTINCT doc_id, c AS brand, pos, {GUARD} AS guarded FROM y""")
def t01(spark, sf):
    return brand_rows(spark, sf, ("marker",)).select(
        "doc_id", "brand", F.col("pos").cast("long").alias("pos"), "guarded"
    )


_QNAME = "trim(regexp_extract(m, " + q(N.quoted_name) + ", 1))"


@query("t02_quoted_brands", f"""
WITH s AS ({_pieces(N.quoted_name, 'true', 'pages', 'page_id', 'html')}),
n AS (SELECT page_id, html AS text, {_QNAME} AS brand, s AS pos, str_split(regexp_replace({_QNAME}, ' +', ' ', 'g'), ' ') AS w FROM s)
SELECT page_id, brand, pos::BIGINT AS pos, {GUARD} AS guarded FROM n
WHERE length(brand) >= 3 AND upper(brand) NOT IN ({_STOP})
  AND lower(trim(brand, '.,;:()[]«»"')) NOT IN ({", ".join(q(r) for r in N.role_words)})
  AND NOT ({" OR ".join(f"contains(lower(brand), {q(o)})" for o in N.org_fragments)})
  AND ((len(w) = 1 AND regexp_full_match(brand, '[A-Z][A-Za-z0-9-]{{2,}}'))
    OR (len(w) IN (2, 3) AND regexp_full_match(w[1], '[A-Z][A-Za-z0-9-]+') AND regexp_full_match(w[2], '[A-Z0-9][A-Za-z0-9-]*')))""")
def t02(spark, sf):
    p = spread(table(spark, sf, "pages").select("page_id", "html"))
    p = p.where(F.col("html").rlike(N.quoted_name))
    p = p.withColumn("b", Q.brands(F.col("html"), N, ("quoted",)))
    return p.select("page_id", F.explode("b").alias("b")).select(
        "page_id", "b.brand", F.col("b.pos").cast("long").alias("pos"), "b.guarded"
    )


_EDGES = ".,;:()[]«»\""
_QUOTED_OK = f"""length(c) >= 3 AND upper(c) NOT IN ({_STOP})
  AND lower(trim(c, '{_EDGES}')) NOT IN ({", ".join(q(r) for r in N.role_words)})
  AND NOT ({" OR ".join(f"contains(lower(c), {q(o)})" for o in N.org_fragments)})"""
_NAME = "trim(regexp_extract(m, " + q(N.quoted_name) + ", 1))"
# every mention (doc_id, text, c, pos) of the four kinds of evidence; equal mentions count once
BRAND_SQL = f"""
  WITH bm AS ({_pieces(N.brand_marker, 'true')}),
  bt AS (SELECT doc_id, text, e, substr(text, e + 1, 80) AS tail FROM bm),
  bn AS (SELECT *, trim(regexp_extract(tail, {q(N.quoted_name)}, 1)) AS c,
    length(regexp_split_to_array(tail, {q(N.quoted_name)})[1]) AS ahead FROM bt),
  named AS (SELECT doc_id, text, c, (e + ahead)::BIGINT AS pos, e FROM bn WHERE {_QUOTED_OK}),
  coded AS (SELECT doc_id, text, trim(regexp_extract(tail, {q(N.model_code)}, 1)) AS c,
    (e + length(regexp_split_to_array(tail, {q(N.model_code)})[1]) + length(regexp_extract(tail, {q(N.model_code)}, 0))
      - length(regexp_extract(tail, {q(N.model_code)}, 1)))::BIGINT AS pos
    FROM bt WHERE regexp_matches(tail, {q(N.model_code)}) AND (doc_id, e) NOT IN (SELECT doc_id, e FROM named)),
  quoted AS (SELECT doc_id, text, {_NAME} AS c, s::BIGINT AS pos FROM ({_pieces(N.quoted_name, 'true')})),
  signed AS (SELECT doc_id, text, s,
    trim(regexp_extract(substr(text, greatest(0, s - 40) + 1, s - greatest(0, s - 40)), '([^\\s]+)\\s*$', 1), '{_EDGES}') AS c
    FROM ({_pieces(N.sigil, 'true')}))
  SELECT doc_id, text, c, pos FROM named
  UNION SELECT doc_id, text, c, pos FROM coded WHERE {MODEL_FILTER}
  UNION SELECT doc_id, text, c, pos FROM quoted WHERE {_QUOTED_OK} AND
    (regexp_full_match(c, '[A-Z][A-Za-z0-9-]{{2,}}') OR regexp_full_match(c, '[A-Z][A-Za-z0-9-]+ +[A-Z0-9][A-Za-z0-9-]*(?: +[^ ]+)?'))
  UNION SELECT doc_id, text, c, pos FROM ({MODEL_POS_SQL}) WHERE {MODEL_FILTER}
  UNION SELECT doc_id, text, c, (s - length(c))::BIGINT AS pos FROM signed WHERE length(c) >= 2 AND upper(c) NOT IN ({_STOP})"""


@query("t03_model_codes", f"""
SELECT doc_id, c AS code FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, {q(N.model_code)}, 1))) AS c
  FROM documents) WHERE {MODEL_FILTER}""")
def t03(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.explode(X.model_codes(F.col("text"), N)).alias("code")
    )


_SIGIL = r"([^ \n\t\r™®$]{2,40})[ ]?(?:" + N.sigil + ")"


@query("t04_sigil_brands", f"""
SELECT doc_id, b AS brand FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, {q(_SIGIL)}, 1)), '.,;:()[]«»"') AS b
  FROM documents) WHERE length(b) >= 2 AND upper(b) NOT IN ({_STOP})""")
def t04(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.explode(X.sigil_brands(F.col("text"), N)).alias("brand")
    )


@query("t05_guard_window", f"""
SELECT doc_id, c AS brand, pos, {GUARD} AS guarded FROM ({MODEL_POS_SQL}) WHERE {MODEL_FILTER}""")
def t05(spark, sf):
    return brand_rows(spark, sf, ("latin_model",)).select(
        "doc_id", "brand", F.col("pos").cast("long").alias("pos"), "guarded"
    )


@query("t06_evidence_quote", f"""
SELECT doc_id, pos, {AROUND} AS evidence FROM ({MODEL_POS_SQL}) WHERE {MODEL_FILTER}""")
def t06(spark, sf):
    return brand_rows(spark, sf, ("latin_model",), keep_text=True).select(
        "doc_id", F.col("pos").cast("long").alias("pos"),
        X.quote_around(F.col("text"), F.col("pos")).alias("evidence"),
    )


def _count(p: str) -> str:
    return f"len(regexp_extract_all(text, {q(p)}))::BIGINT"


T07_SQL = f"""SELECT doc_id, {_count(N.equivalent)} AS equivalent_count, {_count(N.units)} AS units_count,
  regexp_matches(text, {q(N.ranges)}) AS has_ranges, {_count(N.standards)} AS standard_count,
  regexp_matches(text, {q(N.catalogue)}) AS has_catalogue_code, {_count(N.restrictive)} AS restrictive_count
  FROM documents"""


def lexicon_features(spark, sf):
    d = documents(spark, sf, "doc_id", "text").select(
        "doc_id", *X.lexicon_counts(F.col("text"), N)
    )
    for c in ("equivalent_count", "units_count", "standard_count", "restrictive_count"):
        d = d.withColumn(c, F.col(c).cast("long"))
    return d


@query("t07_lexicon_counts", T07_SQL)
def t07(spark, sf):
    return lexicon_features(spark, sf)


@query("t08_regex_record", f"""
WITH f AS ({T07_SQL}), b AS (SELECT doc_id, c, {GUARD} AS guarded, {AROUND} AS evidence
   FROM ({BRAND_SQL}))
SELECT f.doc_id, count(c) AS brand_count, count(c) FILTER (NOT guarded) AS unguarded,
  any_value(equivalent_count) > 0 AS has_equivalent_clause, any_value(standard_count) AS standard_count,
  any_value(has_catalogue_code) AS has_catalogue_code, any_value(restrictive_count) AS restrictive_count,
  md5(coalesce(string_agg(evidence, '|' ORDER BY evidence) FILTER (NOT guarded), '')) AS flag_quotes_md5
FROM f LEFT JOIN b USING (doc_id) GROUP BY f.doc_id""")
def t08(spark, sf):
    d = documents(spark, sf, "doc_id", "text")
    # the row itself carries the text, so flags are built without a join
    d = d.withColumn("b", Q.brands(F.col("text"), N))
    open_ = F.filter("b", lambda b: ~b["guarded"])
    quotes = F.transform(open_, lambda b: X.quote_around(F.col("text"), b["pos"]))
    return d.select(
        "doc_id",
        F.size("b").cast("long").alias("brand_count"),
        F.size(open_).cast("long").alias("unguarded"),
        (X.count_matches(F.col("text"), N.equivalent) > 0).alias("has_equivalent_clause"),
        X.count_matches(F.col("text"), N.standards).cast("long").alias("standard_count"),
        F.col("text").rlike(N.catalogue).alias("has_catalogue_code"),
        X.count_matches(F.col("text"), N.restrictive).cast("long").alias("restrictive_count"),
        F.md5(F.array_join(F.array_sort(quotes), "|")).alias("flag_quotes_md5"),
    )


@query("t09_run_counters", f"""
WITH f AS ({T07_SQL}), b AS (SELECT DISTINCT doc_id FROM ({BRAND_SQL}))
SELECT count(*) AS processed, count(b.doc_id) AS with_brand,
  count(*) FILTER (has_catalogue_code) AS with_catalogue,
  count(*) FILTER (restrictive_count > 0) AS with_restrictive, count(*) FILTER (equivalent_count > 0) AS with_equivalent
FROM f LEFT JOIN b USING (doc_id)""")
def t09(spark, sf):
    d = documents(spark, sf, "doc_id", "text")
    t = F.col("text")
    return d.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.size(Q.brands(t, N)) > 0).alias("with_brand"),
        F.count_if(t.rlike(N.catalogue)).alias("with_catalogue"),
        F.count_if(t.rlike(N.restrictive)).alias("with_restrictive"),
        F.count_if(t.rlike(N.equivalent)).alias("with_equivalent"),
    )


ENTITY_SQL = f"""list_distinct(list_concat(
   list_transform(list_filter(list_transform(regexp_extract_all(%s, {q(N.entity_quoted)}, 1), lambda x: lower(trim(x))),
      lambda x: length(x) BETWEEN 2 AND 60), lambda x: 'q:' || x),
   list_transform(regexp_extract_all(%s, {q(N.entity_standard)}), lambda x: 'gost:' || lower(replace(x, ' ', ''))),
   list_transform(regexp_extract_all(%s, {q(N.entity_catalogue)}), lambda x: 'ktru:' || x),
   list_transform(list_filter(regexp_extract_all(%s, {q(N.entity_latin)}), lambda x: regexp_matches(x, '[0-9]')),
      lambda x: 'lat:' || lower(x))))"""


def entity_sql(col: str) -> str:
    return ENTITY_SQL.replace("%s", col)


@query("t10_entities", f"""
SELECT doc_id, unnest({entity_sql('text')}) AS entity FROM documents""")
def t10(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", F.explode(X.entities(F.col("text"), N)).alias("entity")
    )


R1_SQL = f"""SELECT doc_id FROM ({_pieces(N.rule_quoted, "regexp_matches(substr(m, 2, length(m) - 2), '[A-Za-z0-9]')")}
   UNION ALL {_pieces(N.rule_model, 'true')} UNION ALL {_pieces('[™®©]', 'true')})
  WHERE NOT regexp_matches(substr(text, greatest(0, s - 200) + 1, e + 200 - greatest(0, s - 200)), {q(N.rule_equivalent)})"""


def unguarded_trademark(text):
    """Rule R1: some candidate span has no equivalence phrase within 200 characters."""
    candidate = text.rlike(N.rule_quoted) | text.rlike(N.rule_model) | text.rlike("[™®©]")
    spans = Q.trademark_spans(F.when(candidate, text), N)
    return F.exists(
        spans, lambda s: ~X.window_has(text, s["start"], s["end"], N.rule_equivalent, 200)
    )


@query("t11_unguarded_trademark", f"""
SELECT doc_id, doc_id IN ({R1_SQL}) AS fires FROM documents""")
def t11(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", unguarded_trademark(F.col("text")).alias("fires")
    )


R2_SQL = f"(length(text) < 2000 AND NOT regexp_matches(text, {q(N.spec_marker)}))"


@query("t12_incomplete_short", f"SELECT doc_id, {R2_SQL} AS fires FROM documents")
def t12(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", X.incomplete_short(F.col("text"), N).alias("fires")
    )


_w, _c = N.restrictive_word.replace("(?i)", ""), N.characteristic_word.replace("(?i)", "")
R3_SQL = f"regexp_matches(text, {q(f'(?is){_w}[^~]{{0,80}}(?:{_c})|(?:{_c})[^~]{{0,80}}{_w}')})".replace(
    "[^~]", r"[\s\S]"
)


@query("t13_restrictive_context", f"SELECT doc_id, {R3_SQL} AS fires FROM documents")
def t13(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", X.restrictive_near_characteristic(F.col("text"), N).alias("fires")
    )


@query("t14_rule_union", f"""
SELECT doc_id, array_to_string(r, ',') AS triggered, CASE WHEN len(r) > 0 THEN 'violation' ELSE 'not_established' END AS verdict
FROM (SELECT doc_id, list_filter([CASE WHEN doc_id IN ({R1_SQL}) THEN 'R1_trademark_no_equiv' END,
   CASE WHEN {R2_SQL} THEN 'R2_incomplete_short_tz' END, CASE WHEN {R3_SQL} THEN 'R3_restrictive_keyword' END],
   lambda x: x IS NOT NULL) AS r FROM documents)""")
def t14(spark, sf):
    t = F.col("text")
    rules = F.filter(
        F.array(
            F.when(F.col("r1"), F.lit("R1_trademark_no_equiv")),
            F.when(X.incomplete_short(t, N), F.lit("R2_incomplete_short_tz")),
            F.when(X.restrictive_near_characteristic(t, N), F.lit("R3_restrictive_keyword")),
        ),
        F.isnotnull,
    )
    d = documents(spark, sf, "doc_id", "text").withColumn("r1", unguarded_trademark(t))
    return d.withColumn("r", rules).select(
        "doc_id", F.array_join("r", ",").alias("triggered"),
        F.when(F.size("r") > 0, F.lit("violation")).otherwise(F.lit("not_established")).alias("verdict"),
    )


@query("t15_candidate_prefilter", f"""
WITH b AS (SELECT doc_id, count(DISTINCT c) FILTER (NOT {GUARD}) AS n FROM ({BRAND_SQL}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_unguarded, CASE WHEN coalesce(n, 0) = 0 THEN 'not_established' END AS verdict,
  CASE WHEN coalesce(n, 0) = 0 THEN 0.85::DOUBLE END AS confidence
FROM documents d LEFT JOIN b USING (doc_id)""")
def t15(spark, sf):
    """Documents without an unguarded candidate get the constant result; the rest stay open."""
    d = documents(spark, sf, "doc_id", "text").withColumn("b", Q.brands(F.col("text"), N))
    names = F.array_distinct(
        F.transform(F.filter("b", lambda b: ~b["guarded"]), lambda b: b["brand"])
    )
    d = d.select("doc_id", F.size(names).cast("long").alias("n_unguarded"))
    settled = F.col("n_unguarded") == 0
    return d.select(
        "doc_id", "n_unguarded",
        F.when(settled, F.lit("not_established")).alias("verdict"),
        F.when(settled, F.lit(0.85)).alias("confidence"),
    )


@query("t16_catalogue_codes", f"""
WITH raw AS (SELECT doc_id, 'long' AS kind, unnest(regexp_extract_all(text, {q(N.long_code)}, 1)) AS code,
    generate_subscripts(regexp_extract_all(text, {q(N.long_code)}, 1), 1) AS i FROM documents
  UNION ALL SELECT doc_id, 'short', unnest(regexp_extract_all(text, {q(N.short_code)}, 1)),
    generate_subscripts(regexp_extract_all(text, {q(N.short_code)}, 1), 1) FROM documents),
d AS (SELECT doc_id, kind, code, min(i) AS i FROM raw GROUP BY ALL),
f AS (SELECT * FROM d WHERE kind = 'long' OR NOT EXISTS (
   SELECT 1 FROM d k WHERE k.kind = 'long' AND k.doc_id = d.doc_id AND starts_with(k.code, d.code))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS rn FROM f)
SELECT doc_id, coalesce(string_agg(code, ',' ORDER BY i) FILTER (kind = 'long'), '') AS long_codes,
  coalesce(string_agg(code, ',' ORDER BY i) FILTER (kind = 'short'), '') AS short_codes
FROM r WHERE rn <= 5 GROUP BY doc_id""")
def t16(spark, sf):
    d = X.with_catalogue_codes(documents(spark, sf, "doc_id", "text"), "text", N)
    return d.where((F.size("long_codes") > 0) | (F.size("short_codes") > 0)).select(
        "doc_id",
        F.array_join("long_codes", ",").alias("long_codes"),
        F.array_join("short_codes", ",").alias("short_codes"),
    )


def _masked_sql() -> str:
    """Counts and blanked text, one kind after the other."""
    sql = "SELECT doc_id, text AS t0, text FROM documents"
    for i, p in enumerate(L.MASK_PATTERNS.values()):
        sql = (
            f"SELECT *, len(regexp_extract_all(t{i}, {q('(?i)' + p)})) AS n{i}, "
            f"regexp_replace(t{i}, {q('(?i)' + p)}, '#', 'g') AS t{i + 1} FROM ({sql})"
        )
    return sql


@query("t17_mask_entities", f"""
SELECT doc_id, n0::INTEGER AS ids, n1::INTEGER AS inn, (n2 + n3 + n4)::INTEGER AS dates, n5::INTEGER AS orgs,
  sha256(t6) AS blanked_sha, n0 + n1 + n5 > 0 AS changed FROM ({_masked_sql()})""")
def t17(spark, sf):
    """Counts of the masked entities and what masking leaves; changed where it must change."""
    d = documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        "text",
        Q.mask_entities(F.col("text"), F.col("doc_id")).alias("m"),
        Q.blank_entities(F.col("text")).alias("b"),
    )
    certain = F.col("m.ids") + F.col("m.inn") + F.col("m.orgs") > 0
    return d.select(
        "doc_id", "m.ids", "m.inn", "m.dates", "m.orgs",
        F.sha2("b.text", 256).alias("blanked_sha"),
        (certain & (F.col("m.text") != F.col("text"))).alias("changed"),
    )


@query("t18_highlight_spans")
def t18(spark, sf):
    found = F.transform(
        X.pack_findings(F.col("text"), N.gold),
        lambda f: F.struct(
            f["quote"].alias("quote"), f["flag_type"].alias("flag_type"),
            f["confidence"].alias("confidence"),
        ),
    )
    d = documents(spark, sf, "doc_id", "text").withColumn("f", found).where(F.size("f") > 0)
    return d.select("doc_id", F.explode(Q.highlight("text", "f")).alias("s")).select("doc_id", "s.*")


_NQ = r"trim(regexp_replace(lower(%s), '[\t\n\v\f\r\x{85}\p{Z}]+', ' ', 'g'))"


@query("t19_literal_quote", with_ctes("gold", f"""
SELECT g.doc_id, type_ord, idx, length({_NQ % 'g.quote'}) < 12
   OR contains({_NQ % 'd.text'}, {_NQ % 'g.quote'}) AS literal FROM gold g JOIN documents d USING (doc_id)"""))
def t19(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return gold(spark, sf).join(d, "doc_id").select(
        "doc_id", "type_ord", "idx",
        X.literal_quote_ok(F.col("text"), F.col("quote")).alias("literal"),
    )
