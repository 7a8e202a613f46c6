"""Russian lexicon, positions, highlighting and masking."""

import re

import pytest
from pyspark.sql import functions as F

from clauseflow.functions import positional as Q, scalar as S, text as X
from clauseflow.lexicon import NEUTRAL, RUSSIAN

TEXT = (
    "Техническое задание\nСистемная плата: ASUS 850M или эквивалент, разъёмы SATA.\n" + "x " * 150
    + "\nПринтер товарный знак «Epson» LX-350, гарантия не менее 36 месяцев, масса 5 кг.\n" + "y " * 150
    + "\nПоставка только новых изделий по ГОСТ 9001-2015, код 26.20.11.110, Galaxy™ и 12 мм."
)


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(TEXT,)], "t string")


def test_brands_with_guard(one):
    got = {(b.brand, b.source, b.guarded) for b in one.select(Q.brands(F.col("t"), RUSSIAN).alias("b")).first().b}
    assert ("Epson", "marker", False) in got
    assert ("ASUS 850M", "latin_model", True) in got
    assert ("Epson", "quoted", False) not in got  # same name and place as the marker mention
    assert ("LX-350", "latin_model", False) in got
    assert ("Galaxy", "sigil", False) in got


def test_stop_words_and_roles_are_rejected(spark):
    t = "«Поставщик» «ООО Ромашка» USB 20 ISO 9001 III-10-75 «Приложение» ГОСТ 12"
    df = spark.createDataFrame([(t,)], "t string")
    names = {b.brand for b in df.select(Q.brands(F.col("t"), RUSSIAN).alias("b")).first().b}
    assert not names & {"Поставщик", "ООО Ромашка", "Приложение", "III-10-75"}


def test_lexicon_counts(one):
    r = one.select(*X.lexicon_counts(F.col("t"), RUSSIAN)).first()
    assert r.equivalent_count == 1 and r.units_count == 2 and r.has_ranges
    assert r.standard_count == 1 and r.has_catalogue_code and r.restrictive_count == 1


def test_restrictive_look_ahead(spark):
    df = spark.createDataFrame([("только для склада",), ("только новый",)], "t string")
    got = [r.restrictive_count for r in df.select(*X.lexicon_counts(F.col("t"), RUSSIAN)).collect()]
    assert got == [0, 1]


def test_family_probe_and_tier(spark):
    df = spark.createDataFrame([("ТЕХНИЧЕСКОЕ  задание " * 100,), ("Договор " * 400,)], "t string")
    ns = S.not_specification(F.col("t"), RUSSIAN.family_probe)
    rows = df.select(ns.alias("n"), S.quality_tier(F.length("t"), ns, F.lit(False)).alias("q")).collect()
    assert [(r.n, r.q.tier, r.q.reason) for r in rows] == [(False, "thin", ""), (True, "drop", "not_tz")]


def test_unguarded_trademark_window(spark):
    near = "Монитор «LG 24» или эквивалент"
    far = "Монитор «LG 24» " + "б" * 300 + " или эквивалент"
    df = spark.createDataFrame([(near,), (far,)], "t string")
    from clauseflow.lexicon import java_ci

    got = df.select(F.exists(
        Q.trademark_spans(F.col("t"), RUSSIAN),
        lambda s: ~X.window_has(F.col("t"), s["start"], s["end"], java_ci(RUSSIAN.rule_equivalent), 200),
    ).alias("x")).collect()
    assert [r.x for r in got] == [False, True]


def test_codes_keep_the_digits_at_their_ends(spark):
    df = spark.createDataFrame([("Anna 900 or Bert 711 or Carl 22",)], "t string")
    assert df.select(X.model_codes(F.col("t"), NEUTRAL).alias("c")).first().c == ["Anna 900", "Bert 711", "Carl 22"]


def test_normalisation(spark):
    df = spark.createDataFrame([("  ＡＢ  Ё\t\n x ",)], "t string")
    assert df.select(X.normalize_text(F.col("t"), compat=True).alias("n")).first().n == "ab ё x"


def spans(spark, text, findings):
    df = spark.createDataFrame([(text, findings)], "t string, f array<struct<quote:string,flag_type:string,confidence:double>>")
    return [(text[s.start:s.end], s.flag_type) for s in df.select(Q.highlight("t", "f").alias("s")).first().s]


def test_highlight(spark):
    text = "Поставка  только\nнового оборудования марки Acme Corp в полном объёме"
    assert spans(spark, text, [("только нового оборудования", "a", 0.5)]) == [("только\nнового оборудования", "a")]
    # shorter prefixes are tried when the whole quote is absent
    got = spans(spark, text, [("нового оборудования марки Acme Corp которого здесь совсем нет", "a", 0.5)])
    assert got == [("нового оборудования марки Acme Corp", "a")]
    # the more confident of two overlapping findings wins, short quotes are skipped
    got = spans(spark, text, [("только нового оборудования", "low", 0.2), ("нового оборудования марки", "high", 0.9), ("Acme", "short", 1.0)])
    assert got == [("нового оборудования марки", "high")]
    assert spans(spark, text, []) == []


def test_masking_is_repeatable_and_shape_preserving(spark):
    t = 'ООО "Ромашка" ИНН 7701234567, извещение 0158100015723000033, дата 05.03.2024, 7.1.24 и 9 мая 2023'
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "k int, t string")
    m = [r.m for r in df.select(Q.mask_entities(F.col("t"), F.col("k")).alias("m")).collect()]
    assert m[0].text == m[1].text != m[2].text
    assert (m[0].ids, m[0].inn, m[0].dates, m[0].orgs) == (1, 1, 3, 1)
    assert "Ромашка" not in m[0].text and "7701234567" not in m[0].text
    assert re.search(r"\d{2}\.\d{2}\.\d{4}", m[0].text) and re.search(r"\b\d{19}\b", m[0].text)


def test_lanes_match_short_terms_as_words(spark):
    df = spark.createDataFrame([("требование сро и лицензия",), ("просрочка",), ("нет ничего",)], "t string")
    rows = df.select(*[c.alias(n) for c, n in zip(S.keyword_lanes(F.col("t")), "abc")]).collect()
    assert [r.a for r in rows] == ["REQ-QUAL", "no_clean_legacy_match", "no_clean_legacy_match"]


def test_snippets_of_one_text_are_cut_in_its_row(spark):
    text, quotes = "A  " + "b " * 300 + "Needle  x" + " c" * 300, ["needle X", "gone", "", "A b"]
    df = spark.createDataFrame([(text, quotes), (None, ["q"])], "t string, q array<string>")
    many, empty = df.select(X.context_snippets(F.col("t"), F.col("q")).alias("s")).collect()
    one = df.where("t is not null").select("t", F.explode("q").alias("q")).select(X.context_snippet(F.col("t"), F.col("q")).alias("s"))
    assert many.s == [r.s for r in one.collect()]
    assert many.s[0].startswith("…b b") and many.s[0].endswith("c c…") and "needle x" in many.s[0]
    assert many.s[1:3] == ["gone", ""] and many.s[3].startswith("a b b") and many.s[3].endswith("…")
    assert empty.s == ["q"]


def test_terms_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    from clauseflow.operators import retrieval as RT

    df = spark.createDataFrame([(i, "one two three " * 20) for i in range(40)], "doc_id int, text string")
    monkeypatch.setattr(RT, "PART_CHARS", 280)
    tf = RT.ngram_counts(df, "doc_id", "text")
    assert tf.rdd.getNumPartitions() == 40
    assert {(r.term, r.tf) for r in tf.where("doc_id = 7").collect()} == {
        ("one", 20), ("two", 20), ("three", 20), ("one two", 20), ("two three", 20), ("three one", 19)}


def _retrieved(texts, asked, k):
    import math
    import re
    from collections import Counter

    def terms(t):
        found = re.findall(r"\w{2,}", (t or "").lower())
        return Counter(found + [f"{a} {b}" for a, b in zip(found, found[1:])])

    tf = {d: terms(t) for d, t in texts}
    df = Counter(x for c in tf.values() for x in c)
    idf = {x: math.log((1 + len(texts)) / (1 + n)) + 1 for x, n in df.items() if 2 <= n <= 0.95 * len(texts)}

    def unit(c):
        w = {x: n * idf[x] for x, n in c.items() if x in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / size for x, v in w.items()}

    docs, out = {d: unit(c) for d, c in tf.items()}, []
    for q, t in asked:
        mine = unit(terms(t))
        scores = [(-round(sum(v * w[x] for x, v in mine.items() if x in w), 6), d) for d, w in docs.items() if w.keys() & mine.keys()]
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_retrieval_equals_brute_force(spark, monkeypatch):
    import random

    from clauseflow.operators import retrieval as RT

    monkeypatch.setattr(RT, "GROUP_CHARS", 40_000, raising=False)
    monkeypatch.setattr(RT, "MET", 3_000, raising=False)
    monkeypatch.setattr(RT, "QUERY_BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ПОЛОСА", "x", "½½", "𝒳𝒴", "a_b", "été", "--", "…"]
    texts = [(i, " ".join(rng.choice(words[: 20 + i * 2]) for _ in range(rng.randrange(0, 500)))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "x y z"), (303, "lonely thing"), (304, texts[7][1]), (305, texts[7][1])]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(30))) for i in range(9)] + [("none", "zz"), ("null", None), ("copy", texts[7][1])]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    q = spark.createDataFrame(asked, "item_id string, text string")
    got = RT.tfidf_top_k(d, "doc_id", q, "item_id", "text", 5).select("item_id", "doc_id", "score", "rank").collect()
    assert sorted(tuple(r) for r in got) == _retrieved(texts, asked, 5)


def test_retrieval_shuffles_texts_and_not_their_terms(spark):
    import random

    from clauseflow.operators import retrieval as RT

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(8000)]
    some = [" ".join(words[int(8000 * rng.random() ** 3)] for _ in range(1500)) for _ in range(50)]
    d = spark.createDataFrame([(i, f"{some[i % 50]} doc{i}") for i in range(200)], "doc_id long, text string")
    q = spark.createDataFrame([("a", some[3][:300])], "item_id string, text string")

    def shuffled():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(c, "-1")  # as for large tables
    try:
        before = shuffled()
        RT.tfidf_top_k(d, "doc_id", q, "item_id", "text", 5).collect()
        # 8.2 bytes a character when terms were rows
        assert shuffled() - before < 4.5 * 4 * sum(map(len, some))
    finally:
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(c)
