"""Token containment, fuzzy types, 1:1 assignment and citation containment."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import text as X
from clauseflow.lexicon import RUSSIAN
from clauseflow.operators import matching as M

BRAND, RESTR, INCOMPLETE, KTRU = (
    "brand_without_equivalent", "restrictive_requirement", "incomplete_description", "ktru_mismatch",
)


@pytest.mark.parametrize("gold,pred,expected", [
    ("Samsung Galaxy S22", "поставить Samsung Galaxy S22 без замены", 1.0),
    ("один два три четыре", "два четыре шесть", 0.5),
    ("альфа бета", "гамма дельта", 0.0),
    ("", "что угодно", 0.0),
    ("SAMSUNG Монитор", "samsung монитор", 1.0),
    ("кот", "котлета", 0.0),
])
def test_token_containment(spark, gold, pred, expected):
    row = spark.createDataFrame([(gold, pred)], "g string, p string").select(
        X.token_containment(F.col("g"), F.col("p")).alias("cr")
    ).first()
    assert row.cr == pytest.approx(expected)


@pytest.mark.parametrize("g,p,expected", [
    (BRAND, BRAND, True), (BRAND, RESTR, True), (RESTR, BRAND, True), (RESTR, INCOMPLETE, True),
    (INCOMPLETE, KTRU, True), (KTRU, INCOMPLETE, True), (INCOMPLETE, BRAND, False),
    ("missing_acceptance_terms", INCOMPLETE, True), (INCOMPLETE, "missing_acceptance_terms", False),
    ("inconsistent_dates", INCOMPLETE, False), ("", BRAND, False), (BRAND, "", False),
])
def test_fuzzy_types_are_directed(spark, g, p, expected):
    row = spark.createDataFrame([(g, p)], "g string, p string").select(
        M.fuzzy_type_match(F.col("g"), F.col("p")).alias("m")
    ).first()
    assert row.m is expected


def run(spark, gold, pred, vectors=None, **kw):
    g = spark.createDataFrame(
        [("e", 1, i, t, q) for i, (t, q) in enumerate(gold)],
        "ep string, type_ord int, idx int, finding_type string, quote string")
    p = spark.createDataFrame(
        [("e", 1, i, t, q) for i, (t, q) in enumerate(pred)],
        "ep string, type_ord int, idx int, flag_type string, quote string")
    v = None
    if vectors:
        v = spark.createDataFrame(list(vectors.items()), "quote string, vector array<double>")
    a = M.assign(M.finding_arrays(g, p, v, "ep", RUSSIAN), **kw)
    return [(r["gold_idx"], r["pred_idx"], r["sem"], r["ent"], r["cr"]) for r in a.first()["pairs"]]


def test_strict_types_do_not_cross(spark):
    assert run(spark, [(BRAND, "а")], [(RESTR, "а")]) == []


def test_fuzzy_types_cross(spark):
    got = run(spark, [(BRAND, "а б")], [(RESTR, "а в")], strategy="fuzzy")
    assert [(g, p, cr) for g, p, _, _, cr in got] == [(1, 1, 0.5)]


def test_gate_removes_weak_pairs(spark):
    gold, pred = [(BRAND, "раз два три четыре")], [(BRAND, "четыре пять")]
    assert run(spark, gold, pred, gate=0.3) == []
    assert len(run(spark, gold, pred)) == 1


def test_missing_quotes_still_match_by_type_and_first_wins(spark):
    got = run(spark, [(BRAND, ""), (BRAND, "")], [(BRAND, ""), (BRAND, ""), (BRAND, "")])
    assert [(g, p) for g, p, *_ in got] == [(1, 1), (2, 2)]


def test_cosine_beats_entities_and_each_flag_is_used_once(spark):
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.8, 0.6]}
    got = run(spark, [(BRAND, "a"), (BRAND, "a")], [(BRAND, "b"), (BRAND, "c")], vec)
    assert [(g, p) for g, p, *_ in got] == [(1, 2), (2, 1)]
    assert got[0][2] == pytest.approx(0.8)


def test_strategy_prefers_last_on_ties(spark):
    got = run(spark, [(BRAND, "x")], [(BRAND, "y"), (BRAND, "z")], by_entities=False, prefer_last=True)
    assert [(g, p) for g, p, *_ in got] == [(1, 2)]


def test_assignment_count_equals_closed_form(spark):
    import random

    rng = random.Random(5)
    types = L.FINDING_TYPES
    g = [(f"e{rng.randrange(6)}", rng.choice(types)) for _ in range(80)]
    p = [(f"e{rng.randrange(6)}", rng.choice(types)) for _ in range(120)]
    gd = spark.createDataFrame([(e, types.index(t), i, t, str(i)) for i, (e, t) in enumerate(g)],
                               "ep string, type_ord int, idx int, finding_type string, quote string")
    pd_ = spark.createDataFrame([(e, types.index(t), i, t, str(i)) for i, (e, t) in enumerate(p)],
                                "ep string, type_ord int, idx int, flag_type string, quote string")
    a = M.assign(M.finding_arrays(gd, pd_, None, "ep", RUSSIAN)).select("ep", F.size("pairs").alias("n"))
    counted = {r.ep: r.matched for r in M.episode_counts(gd, pd_, "ep").collect()}
    for r in a.collect():
        assert r.n == counted[r.ep]
    per_type = M.type_counts(gd, pd_, ["ep"]).groupBy("ep").agg(F.sum("matched").alias("m"))
    assert {r.ep: r.m for r in per_type.collect()} == counted


def brute_contained(quote, doc):
    q, d = " ".join(quote.lower().split()), " ".join(doc.lower().split())
    if not q or not d:
        return False
    if q in d:
        return True
    if len(q) < 30:
        return False
    step = max(len(q) // 2, 200)
    return any(
        difflib.SequenceMatcher(None, q, d[i : i + 2 * len(q)]).ratio() >= 0.7
        for i in range(0, len(d), step)
    )


def test_fuzzy_containment_equals_all_windows(spark):
    import random

    rng = random.Random(3)
    words = ["поставка", "товара", "срок", "приёмка", "монитор", "характеристика", "гост", "акт"]
    rows = []
    for i in range(60):
        doc = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 220)))
        k = rng.randrange(10, 160)
        at = rng.choice([len(doc) - k, rng.randrange(len(doc)), 0])
        quote = list(doc[max(0, at) : max(0, at) + k])
        for j in range(0, len(quote), rng.choice([5, 9, 400])):
            quote[j] = "ю"
        rows.append((i, doc, "".join(quote)))
    df = spark.createDataFrame(rows, "i int, doc string, quote string").withColumn(
        "norm", X.normalize_text(F.col("doc")))
    got = {r.i: r.hit for r in M.contained(df, "norm", "quote", "hit").collect()}
    assert got == {i: brute_contained(q, d) for i, d, q in rows}
    assert len(set(got.values())) == 2


def test_entities(spark):
    t = 'Монитор «Samsung» по ГОСТ 12345-2020, код 26.20.16.110, модель X200'
    row = spark.createDataFrame([(t,)], "t string").select(X.entities(F.col("t"), RUSSIAN).alias("e")).first()
    assert set(row.e) == {"q:samsung", "gost:гост12345-2020", "ktru:26.20.16.110", "lat:x200"}


COMPAT = [
    "plain ascii", "ﬁne ﬂour ½ x² №5", "Ａ Ｂ Ｃ　１２３", "e\u0301tude caf\u0065\u0301 a\u0323\u0307", "\u1100\u1161\u11a8 한글",
    "", " ", "x\u00a0y \u2003z\n\u0301lone", "Å Å ﷺ ㎏", "é" * 50, "ſ K µ", "a\tﬀ\r\nb", "\U0001d400\U0001f600", "日本語 ﾊﾝｶｸ",
]


def test_compat_text_is_nfkc(spark):
    rows = [(i, t) for i, t in enumerate(COMPAT)] + [(99, None), (98, "word " * 50_000 + "ﬁ"), (97, "y" * 300_000 + " ½")]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.compat_text(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in rows}


def test_normalize_each(spark):
    texts = [[], ["Ａ  B", "x\ny", None, " ½ "], ["\u0301", "e", "\u0301"], None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>")
    got = {r.i: r.c for r in df.select("i", X.normalize_each(F.col("t")).alias("c")).collect()}

    def one(t):
        return " ".join(unicodedata.normalize("NFKC", (t or "").replace("\n", " ")).lower().split())

    assert [got[i] for i in range(3)] == [[one(t) for t in ts] for ts in texts[:3]]
    assert got[3] in (None, [])


def test_candidates_cover_all_pairs(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "É"]

    def some(kind, n):
        return [(rng.randrange(4), rng.choice("xy"), " ".join(rng.choices(words, k=rng.randrange(4)))) for _ in range(n)]

    g, p = some("g", 60), some("p", 80)
    gold = spark.createDataFrame(g, "ep int, finding_type string, quote string")
    flags = spark.createDataFrame(p, "ep int, flag_type string, quote string")
    got = {
        (r.ep, r.type, r.quote, r.flag_quote): (r.n_gold, r.n_flag, round(r.cr, 9))
        for r in M.containment_candidates(gold, flags, "ep").collect()
    }
    expect = {}
    for e, t, q in set(g):
        for e2, t2, f in set(p):
            a, b = set(q.lower().split()), set(f.lower().split())
            if e == e2 and t == t2 and a & b:
                expect[e, t, q, f] = (g.count((e, t, q)), p.count((e, t, f)), round(len(a & b) / len(a), 9))
    assert got == expect


def test_cheap_tests_of_patterns_hide_no_match(spark):
    from clauseflow.lexicon import NEUTRAL

    assert sum(bool(p.literal or p.probe) for p in (*NEUTRAL.flags, *NEUTRAL.gold)) == 8
    rng = random.Random(5)
    parts = ["ABC", "AB-", "A1-2", "ÄBCD", "aABCD e", "@", "a@b.de", "1.2", "1.2.3", "10.20.30.4", ".5.", '"', '"ab"', "$$$", "x$$$", " ", "\n", "only", "license"]
    texts = [None, "", *parts, *("".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (*NEUTRAL.flags, *NEUTRAL.gold):
        plain, count = X.all_matches(F.col("t"), p.pattern, 1), F.regexp_count("t", F.lit(p.pattern))
        rows = df.select(X.pattern_matches(F.col("t"), p).alias("a"), plain.alias("b"), X.pattern_count(F.col("t"), p).alias("c"), count.alias("d")).collect()
        assert all((r.a or []) == (r.b or []) and (r.c or 0) == (r.d or 0) for r in rows), p


def test_texts_are_scanned_once_for_both_sides(spark, tmp_path):
    from clauseflow.plans.base import findings_of_both

    spark.createDataFrame([(1, 'ABCD or "x y" and license'), (2, "nothing"), (3, "WXYZ here"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    g, f = findings_of_both(spark, str(tmp_path))
    assert {r.quote for r in g.collect()} == {'ABCD or "x y"', "license"} and {r.doc_id for r in f.collect()} == {1}
    assert "RegExpExtractAll" not in g.join(f, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in g.join(f, "doc_id")._jdf.queryExecution().optimizedPlan().toString()


def test_assignment_of_more_episodes_than_a_slice(spark):
    item = "array<struct<type_ord:int,idx:int,type:string,quote:string,tokens:array<string>,entities:array<string>>>"
    one = lambda i, n: [(1, k, BRAND, f"q{i}", ["q"], []) for k in range(n)]
    rows = [(i, one(i, i % 3), None if i % 5 == 0 else one(i, 2), [(f"q{i}", [1.0])]) for i in range(M.EPISODES * 2 + 3)]
    got = M.assign(spark.createDataFrame(rows, f"k int, gold {item}, pred {item}, vectors {M.VECTORS}").coalesce(1)).collect()
    assert {r.k: len(r.pairs) for r in got} == {i: 0 if i % 5 == 0 else i % 3 for i, *_ in rows}


def test_an_episode_holds_a_vector_once(spark):
    from clauseflow.lexicon import NEUTRAL

    gold = spark.createDataFrame([(1, 1, BRAND, k, " same ") for k in range(5)], "doc_id int, type_ord int, finding_type string, idx int, quote string")
    flags = spark.createDataFrame([(1, 1, BRAND, k, "same" if k else "other") for k in range(9)], "doc_id int, type_ord int, flag_type string, idx int, quote string")
    vectors = spark.createDataFrame([("same", [0.6, 0.8]), ("other", [1.0, 0.0])], "quote string, vector array<double>")
    a = M.finding_arrays(gold, flags, vectors, "doc_id", NEUTRAL)
    row = M.assign(a).first()
    assert sorted(v.quote for v in row.vectors) == ["other", "same"]
    assert [(p.gold_idx, p.pred_idx, round(p.sem, 9)) for p in row.pairs] == [(k, k + 1, 1.0) for k in range(1, 6)]
