"""Compliance rules, dedupe, score, verdict, recommendations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clauseflow import lexicon as L
from clauseflow.functions import records as R, rules as RU
from clauseflow.operators import ml as ML, report as RP

SCHEMA = (
    "doc_type string, brands array<struct<name:string,guarded:boolean,quote:string>>, "
    "phrases array<struct<phrase:string,quote:string>>, missing array<string>, ktru_code string, "
    "has_additional boolean, has_units boolean, has_ranges boolean, has_functional boolean, "
    "has_technical boolean, has_quality boolean, has_acceptance boolean, has_penalty boolean, "
    "has_guarantee boolean, has_acceptance_procedure boolean, has_price boolean, "
    "has_deadline boolean, has_method boolean"
)
CLEAN = dict(
    doc_type="tz", brands=[], phrases=[], missing=[], ktru_code="26.20.11.110", has_additional=False,
    has_units=True, has_ranges=True, has_functional=True, has_technical=True, has_quality=True,
    has_acceptance=True, has_penalty=None, has_guarantee=None, has_acceptance_procedure=None,
    has_price=None, has_deadline=None, has_method=None,
)


def facts(spark, **kw):
    row = {**CLEAN, **kw}
    names = [c.split()[0] for c in SCHEMA.replace("array<struct<", "array<").split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], SCHEMA)


def findings(spark, **kw):
    df = facts(spark, **kw).withColumn("f", RU.evaluate(F.col("doc_type")))
    return df.first()["f"]


def kinds(fs):
    return [(f["flag_type"], f["confidence"]) for f in fs]


def test_clean_document_has_no_findings(spark):
    assert findings(spark) == []


def test_unguarded_brand(spark):
    fs = findings(spark, brands=[("HP", False, "ноутбук HP"), ("LG", True, "LG или эквивалент")])
    assert kinds(fs) == [("brand_without_equivalent", 0.95)]
    assert fs[0]["extra"] == {"brand": "HP"}
    assert "«HP»" in fs[0]["description"]


def test_yardstick_brand_is_skipped(spark):
    assert findings(spark, brands=[("Intel", False, "Процессор НЕ ХУЖЕ Intel Core i5")]) == []


def test_restrictive_phrase_and_guarded_overlap(spark):
    fs = findings(spark, phrases=[("только новый", ""), ("исключительно ASUS", "")],
                  brands=[("Asus", True, "")])
    assert kinds(fs) == [("restrictive_requirement", 0.7)]
    assert fs[0]["quote"] == "только новый"


def test_incomplete_lists_each_gap_once(spark):
    fs = findings(spark, has_functional=False, has_units=False, missing=["вес", "единицы измерения", "вес"])
    assert kinds(fs) == [("incomplete_description", 0.8)]
    assert fs[0]["description"] == "Не указаны: функциональные характеристики, единицы измерения, вес"


@pytest.mark.parametrize("kw,expected", [
    (dict(ktru_code=None), [("ktru_mismatch", 0.5)]),
    (dict(ktru_code=""), [("ktru_mismatch", 0.5)]),
    (dict(has_additional=True), [("ktru_mismatch", 0.65)]),
    (dict(has_acceptance=False), [("missing_acceptance_terms", 0.85)]),
    (dict(has_acceptance=None), []),
])
def test_single_rules(spark, kw, expected):
    assert kinds(findings(spark, **kw)) == expected


@pytest.mark.parametrize("state,expected", [
    (None, []), (True, []),
    (False, [("missing_acceptance_terms", 0.9), ("missing_acceptance_terms", 0.85),
             ("missing_acceptance_terms", 0.8)]),
])
def test_contract_rules_fire_on_stated_false_only(spark, state, expected):
    fs = findings(spark, doc_type="contract", has_penalty=state, has_guarantee=state,
                  has_acceptance_procedure=state)
    assert kinds(fs) == expected


def test_notice_rules_and_order(spark):
    fs = findings(spark, doc_type="notice", has_price=False, has_deadline=False, has_method=False,
                  phrases=[("только", "")])
    assert kinds(fs) == [("incomplete_description", 0.95), ("incomplete_description", 0.9),
                         ("incomplete_description", 0.85), ("restrictive_requirement", 0.7)]


def test_unknown_type_uses_default_rules(spark):
    assert kinds(findings(spark, doc_type="letter", ktru_code=None)) == [("ktru_mismatch", 0.5)]


def rows(spark, items):
    df = facts(spark)
    f = F.array(*[
        RU.finding(t, c, F.lit(q), F.lit(d)) for t, c, q, d in items
    ]) if items else RU.no_findings()
    return df.withColumn("findings", f)


def test_dedupe_keeps_stronger_and_sorts(spark):
    df = rows(spark, [("other", 0.4, "Текст  цитаты", "a"), ("other", 0.9, "текст цитаты", "b"),
                      ("other", 0.9, "ТЕКСТ ЦИТАТЫ", "c"), ("ktru_mismatch", 0.95, "", "нет кода")])
    got = RP.dedupe_array(df, "findings").first()["findings"]
    assert [(f["confidence"], f["description"]) for f in got] == [(0.95, "нет кода"), (0.9, "b")]


def test_features_are_complete(spark):
    r = RP.assemble(rows(spark, [("other", 0.6, "abc", ""), ("other", 0.2, "def", "")]), F.lit(10)).first()
    f = r["features"].asDict()
    assert tuple(f) == L.FEATURE_COLUMNS and len(f) == 17
    assert (f["risk_flag_count"], f["max_confidence"], f["tz_char_count"]) == (2.0, 0.6, 10.0)
    assert f["mean_confidence"] == pytest.approx(0.4)


@pytest.mark.parametrize("n,top,score,verdict", [
    (0, 0.0, 0.1, "low"), (1, 0.5, 0.6, "medium"), (1, 0.9, 0.72, "high"), (4, 0.1, 0.93, "high"),
    (2, 0.1, 0.63, "medium"), (9, 1.0, 0.95, "high"),
])
def test_score_and_verdict(spark, n, top, score, verdict):
    r = spark.createDataFrame([(n, top)], "n int, top double")
    s = RP.fallback_score(F.col("n"), F.col("top"))
    got = r.select(s.alias("s"), RP.risk_verdict(s, F.col("n"), F.col("top")).alias("v")).first()
    assert got.s == pytest.approx(score) and got.v == verdict


def test_recommendations_fill_placeholders(spark):
    df = spark.createDataFrame([
        ("brand_without_equivalent", "d", {"brand": "HP"}), ("brand_without_equivalent", "d", {}),
        ("incomplete_description", "Отсутствует: вес", {}), ("unheard_of", "x", {}),
    ], "flag_type string, description string, extra map<string,string>")
    fixes = [r.fix for r in RP.recommend(df).collect()]
    assert any("«HP»" in f for f in fixes)
    assert any(L.DEFAULT_BRAND in f for f in fixes)
    assert any(f.startswith("Укажите вес ") for f in fixes)
    assert any("44-ФЗ" in f for f in fixes)


def test_fact_defaults_keep_three_states(spark):
    df = spark.createDataFrame([('{"brands":[{"name":"A"}],"junk":1,"contract_specific":{"has_penalty_clause":false}}',)], "j string")
    f = df.select(R.facts_with_defaults(F.col("j")).alias("f")).first()["f"]
    assert f["doc_type"] == "tz" and f["brands"][0]["has_equivalent_clause"] is False
    assert f["completeness"]["has_warranty_terms"] is True
    assert f["contract_specific"]["has_penalty_clause"] is False
    assert f["contract_specific"]["payment_terms_defined"] is None
    assert f["measurements"]["units_found"] == []


@pytest.mark.parametrize("text,verdict,conf", [
    ('```json\n{"verdict": "violation", "confidence": 3}\n```', "violation", 1.0),
    ('x {"verdict": "compliant", "confidence": "0.4"} y', "not_established", 0.4),
    ('{"verdict": "not_established", "confidence": "bad"}', "not_established", 0.0),
    ("no json here", "not_established", 0.0),
])
def test_verdict_record(spark, text, verdict, conf):
    rec = R.verdict_record(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(
        rec["verdict"].alias("v"), rec["confidence"].alias("c")).first()
    assert (r.v, r.c) == (verdict, conf)


def test_stored_risk_model(spark, tmp_path):
    from clauseflow.operators import report as RP

    path = str(tmp_path / "models")
    assert RP.load_model(spark, path) is None
    a = RP.RiskModel("a", ("risk_flag_count", "unknown"), (2.0, 9.0), -1.0)
    RP.save_model(spark, a, path)
    b = RP.RiskModel("b", ("max_confidence",), (1.0,), 0.5)
    RP.save_model(spark, b, path)
    assert RP.load_model(spark, path) == b
    assert RP.load_model(spark, path, "a") == a
    assert RP.load_model(spark, path, "c") is None
    broken = RP.RiskModel("z", ("x", "y"), (1.0,), 0.0)
    RP.save_model(spark, broken, path)
    assert RP.load_model(spark, path) is None and RP.load_model(spark, path, "b") == b
    row = spark.createDataFrame([(3.0,), (None,)], "risk_flag_count double").select(
        a.score_of({"risk_flag_count": F.col("risk_flag_count")}).alias("p")
    ).collect()
    assert [round(r.p, 9) for r in row] == [round(1 / (1 + math.exp(-5)), 9), round(1 / (1 + math.exp(1)), 9)]


def test_linear_scorer_equals_the_pipeline(spark):
    import random

    from clauseflow import lexicon as L
    from clauseflow.operators import ml as ML

    rng = random.Random(2)
    rows = [(i, rng.randrange(2), *[0.0 if c == "has_units" else rng.random() * 5 for c in L.FEATURE_COLUMNS]) for i in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "y", *L.FEATURE_COLUMNS])
    model = ML.train_scorer(df)
    plain = ML.linear_scorer(model, "1")
    both = ML.score(model, df).withColumn("own", plain.score(F.struct(*L.FEATURE_COLUMNS))).collect()
    assert max(abs(r.score - r.own) for r in both) < 1e-9
    folds = ML.stratified_folds(df, "doc_id", "y").join(df.select("doc_id", "y"), "doc_id").collect()
    for y in (0, 1):
        sizes = [sum(r.fold == f and r.y == y for r in folds) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_logistic_regressions_together_are_spark_s_one_by_one(spark):
    rng = random.Random(5)
    feats = list(L.FEATURE_COLUMNS)
    rows = []
    for i in range(600):
        x = [rng.gauss(0, 1 + j) for j in range(len(feats))]
        x[3], x[4] = 2.0, float(rng.random() < 0.02)  # one value; a rare one
        rows.append((i, f"g{i % 40}", int(x[0] - 0.4 * x[1] + rng.gauss(0, 1) > 0.5), *x))
    df = spark.createDataFrame(rows, ["doc_id", "g", "y", *feats])
    grid = [{"C": c, "elasticNetParam": e, "maxIter": 500} for c in (0.05, 5.0) for e in (1.0, 0.0)]
    held = ML.held_out_grid(df, "doc_id", "g", "lr", grid, folds=3)
    got = {(r.point, r.doc_id): r for r in held.collect()}
    assert len(got) == held.count() == 600 * len(grid)
    folds = df.join(ML.group_folds(df, "g", "y", 3), "g").cache()
    train = folds.where("fold != 1")
    for at, p in enumerate(grid):
        model = ML.estimator("lr", "y", tol=1e-10, **ML.fit_params("lr", p, train.count())).fit(train)
        for r in ML.score(model, folds.where("fold = 1")).collect():
            assert got[at, r.doc_id].score == pytest.approx(r.score, abs=1e-4)
            assert got[at, r.doc_id].prediction == int(got[at, r.doc_id].score > 0.5)
            assert (got[at, r.doc_id].fold, got[at, r.doc_id].y) == (1, r.y)


def test_nested_search_of_logistic_regressions_in_few_jobs(spark):
    rng = random.Random(6)
    feats = list(L.FEATURE_COLUMNS)
    rows = []
    for i in range(400):
        x = [rng.gauss(0, 1) for _ in feats]
        rows.append((i, f"g{i % 30}", int(x[0] + rng.gauss(0, 0.5) > 0), *x))
    df = spark.createDataFrame(rows, ["doc_id", "g", "y", *feats])
    grid = [{"regParam": r, "elasticNetParam": 1.0, "maxIter": 500} for r in (0.9, 0.01)]
    spark.sparkContext.setJobGroup("nested", "nested")
    out = ML.nested_search(df, "g", "lr", grid, outer=3, inner=2).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("nested"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 250
    assert sorted(r.doc_id for r in out) == list(range(400))
    assert {r.chosen for r in out} == {1}
    assert sum(r.prediction == r.y for r in out) > 330


def test_staged_verdict_record_decodes_once(spark):
    texts = ['```json\n{"verdict": "violation", "confidence": 3, "evidence_quote": "a"}\n```', "none", None, "", "[1]", '{"a": 1} x ```[2]```', "```\n{broken}\n```"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = R.with_verdict_record(df, "t")
    plain = df.select("i", *[c.alias(n) for n, c in R.verdict_record(F.col("t")).items()])
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_scorer_report_in_few_jobs_is_that_of_spark_s_fits(spark):
    rng = random.Random(8)
    feats = list(L.FEATURE_COLUMNS)
    rows = []
    for i in range(300):
        x = [rng.gauss(0, 1 + j) for j in range(len(feats))]
        rows.append((i, int(x[0] - 0.4 * x[1] + rng.gauss(0, 1) > 0.9), *x))
    df = spark.createDataFrame(rows, ["doc_id", "y", *feats]).cache()
    spark.sparkContext.setJobGroup("scorer", "scorer")
    got = ML.scorer_report(df, "doc_id", "y", 3).first()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scorer"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60
    folds = df.join(ML.stratified_folds(df, "doc_id", "y", 3), "doc_id").cache()
    held = []
    for f in range(3):
        model = ML.train_scorer(folds.where(f"fold != {f}").drop("fold"))
        held.append(ML.held_out_metrics(ML.score(model, folds.where(f"fold = {f}")), "y", "prediction", "score").first())
    whole = ML.rank_auc(ML.score(ML.train_scorer(df), df), "y", "score").first()["auc"]
    assert got.cv_accuracy_mean == pytest.approx(sum(r.accuracy for r in held) / 3, abs=1e-9)
    assert got.cv_roc_auc_mean == pytest.approx(sum(r.auc for r in held) / 3, abs=1e-3)
    assert got.in_sample_roc_auc == pytest.approx(whole, abs=1e-3)
    assert (got.n_train, got.pos_rate) == (300, pytest.approx(sum(r[1] for r in rows) / 300))
