"""The registered queries of the subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clauseflow.llm.bpe import encode_texts
from clauseflow.llm.decontaminate import mark_contamination
from clauseflow.llm.fillmiddle import fill_in_middle, restore
from clauseflow.llm.imatch import compare_with_edits, learn_lexicon
from clauseflow.llm.jaccard import Similarity, link_components
from clauseflow.llm.langid import held_out, identify, learn
from clauseflow.llm.linededup import dedup_lines
from clauseflow.llm.pages import extract
from clauseflow.llm.phrases import collocations
from clauseflow.llm.secrets import scan
from clauseflow.llm.substrings import dedup_substrings
from clauseflow.llm.tokencount import count_tokens
from clauseflow.llm.urlfilter import Rule, judge
from clauseflow.plans.registry import table
from clauseflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the package that holds them is a parameter here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


#: A-Z to a-z and nothing else, as SQL.
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WHITE_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op1_line_dedup", f"""
  WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx
    FROM documents),
  keyed AS (SELECT *, {LOWER_SQL.format(f"trim(line, {WHITE_SQL})")} AS k FROM lines),
  repeated AS (
    SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
    GROUP BY k HAVING count(DISTINCT doc_id) > 1)
  SELECT doc_id, count(*)::BIGINT AS n_lines,
    (count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY idx)
      FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
  FROM keyed LEFT JOIN repeated USING (k) GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", sha(F.col("kept_text")).alias("kept_sha256")
    )


@query("op3_benchmark_decontamination", f"""
  WITH dw AS (
    SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
  iw AS (
    SELECT item_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
  windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS k,
      array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
    FROM iw, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS r(i) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT k FROM windows),
  places AS (
    SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM dw, sizes, unnest(range(1, len(w) - k + 2)) AS r(i) WHERE len(w) >= k),
  found AS (SELECT DISTINCT doc_id, i, p.k, item_id FROM places p JOIN windows USING (win, k)),
  hits AS (
    SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
  items AS (
    SELECT doc_id, count(*)::BIGINT AS n_items,
      sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
    coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, table(spark, sf, "benchmark").select("item_id", "text"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        sha(F.array_join("hit_items", ",")).alias("items_sha256"),
        "contaminated",
    )


@query("op5_bpe_round_trip")
def op5_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = encode_texts(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = scratch_path(spark, "token_counts")
    counted = count_tokens(docs, tokenizer_file("word_bpe_49k.json"), cache)
    return counted.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


@query("op7_substring_dedup", """
  WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
  places AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
    FROM w, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
  again AS (SELECT h FROM places GROUP BY h HAVING count(*) > 1),
  starts AS (SELECT doc_id, i FROM places JOIN again USING (h)),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM starts),
  words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
  kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN kept USING (doc_id)""")
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "doc_id", "n_words", "n_removed", sha(F.col("kept_text")).alias("kept_sha256")
    )


@query("op6_ngram_jaccard_join", f"""
  WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")},
      '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS h
    FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS r(i) WHERE len(w) > 0),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (h)
    JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
  reach AS (
    SELECT doc_id AS a, doc_id AS b FROM w
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
  SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id
  FROM w JOIN reach ON a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
  GROUP BY w.doc_id, n""")
def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    linked = link_components(docs, sim=Similarity(n=4, num=85, den=100))
    return linked.select("doc_id", "n_shingles", "component_id")


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_document_fingerprints")
def op4_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return compare_with_edits(docs, learn_lexicon(docs))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return extract(pages).select(
        "page_id",
        "url",
        F.col("main_text").alias("text"),
        F.char_length("main_text").cast("long").alias("n_chars"),
    )


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scan(docs).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        sha(F.col("base")).alias("base_sha256"),
        "spans",
    )


@query("op13_fill_in_middle", """
  WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''),
        '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
      sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
  drawn AS (
    SELECT *, len(u)::BIGINT AS n,
      ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
      ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
  placed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
        OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
  parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
      array_to_string(u[b + 1:], '') AS s FROM placed)
  SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
  FROM parts""")
def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The stated URL rules of the query.
URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)


def _url_tokens_sql(text: str, mark: str, kind: str) -> str:
    return (
        f"[ '{kind}=' || regexp_replace(x, '[0-9]+', '0', 'g') "
        f"for x in string_split({text}, '{mark}') if x <> '' ]"
    )


@query("op12_url_filters", f"""
  WITH parts AS (
    SELECT page_id,
      {LOWER_SQL.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)[?]?([^#]*)', 1)")} AS host,
      regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)[?]?([^#]*)', 2) AS path,
      regexp_replace(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)[?]?([^#]*)', 3),
        '=[^&]*', '', 'g') AS names FROM pages),
  read AS (
    SELECT page_id, host, path, list_sort(list_distinct(
      {_url_tokens_sql("host", ".", "host")} || {_url_tokens_sql("path", "/", "path")}
      || {_url_tokens_sql("names", "&", "query")})) AS tokens FROM parts),
  given(v, h, p) AS (VALUES {RULES_SQL}),
  fits AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
    FROM read JOIN given ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id),
  labelled AS (SELECT page_id, tokens, verdict FROM read JOIN fits USING (page_id)),
  sizes AS (
    SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE verdict = 'allow')::DOUBLE AS a,
      ceil(0.01::DOUBLE * count(*)::DOUBLE) AS least FROM labelled),
  frequent AS (
    SELECT t FROM (SELECT unnest(tokens) AS t FROM labelled) GROUP BY t
    HAVING count(*) >= (SELECT least FROM sizes)),
  chosen AS (
    SELECT page_id, verdict, list_sort(list(t)) AS items
    FROM (SELECT page_id, verdict, unnest(tokens) AS t FROM labelled) JOIN frequent USING (t)
    GROUP BY page_id, verdict),
  combined AS (
    SELECT verdict, [items[i + 1] for i in range(0, len(items)) if (mask >> i) & 1 = 1] AS ant
    FROM (SELECT verdict, items, unnest(range(1, (1 << len(items))::BIGINT)) AS mask FROM chosen)),
  mined AS (
    SELECT ant, v AS verdict, count(*) FILTER (WHERE verdict = v) AS n,
      (count(*) FILTER (WHERE verdict = v))::DOUBLE / count(*)::DOUBLE AS confidence
    FROM combined, (VALUES ('allow'), ('block')) AS k(v) GROUP BY ant, v
    HAVING count(*) FILTER (WHERE verdict = v) >= (SELECT least FROM sizes) AND n > 0
      AND (count(*) FILTER (WHERE verdict = v))::DOUBLE / count(*)::DOUBLE >= 0.8::DOUBLE),
  fired AS (
    SELECT page_id, verdict AS mined, array_to_string(ant, ' ') AS evidence
    FROM read JOIN mined ON list_has_all(tokens, ant)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY
      confidence DESC, n DESC, len(ant), array_to_string(ant, ' '), verdict) = 1),
  usual AS (SELECT CASE WHEN n - a > a THEN 'block' ELSE 'allow' END AS usual FROM sizes)
  SELECT page_id, host, path, rule, coalesce(verdict, mined, usual) AS verdict,
    CASE WHEN rule IS NOT NULL THEN 'rule' WHEN mined IS NOT NULL THEN 'mined' ELSE 'default' END AS basis,
    CASE WHEN rule IS NULL THEN evidence END AS evidence
  FROM read LEFT JOIN fits USING (page_id) LEFT JOIN fired USING (page_id), usual""")
def op12_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).drop("url")


@query("op11_phrase_collocations", f"""
  WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      {LOWER_SQL.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
  f AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
    FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k), unnest(range(1, len(w) - k + 2)) AS r(i)
    WHERE len(w) >= k GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
  cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r,
      ((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f))::BIGINT AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
  scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
  inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer
    FROM cand, (VALUES (2), (3)) AS sizes(s), unnest(range(1, k - s + 2)) AS r(i)
    WHERE s < k GROUP BY 1, 2),
  ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM scored s LEFT JOIN inside USING (lang, phrase)
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents").select("text", "lang"))
