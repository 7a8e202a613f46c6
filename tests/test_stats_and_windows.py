"""Statistics, ordered indexes, samples, top-k and clustering against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseflow.operators import clustering as C, joins as J, metrics as G, ml as ML, retrieval as RT, stats as ST, vectors as VE, windows as WI


def test_kappa_is_one_for_identical_raters(spark):
    df = spark.createDataFrame([("p", "p", "p"), ("n", "n", "n"), ("p", "p", "p")], "a string, b string, c string")
    assert ST.fleiss_kappa(df, ["a", "b", "c"], "p").first().kappa == pytest.approx(1.0)


def test_rand_index_ignores_label_names(spark):
    rows = [(i % 3, "xyz"[i % 3], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    assert ST.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1.0)
    assert abs(ST.adjusted_rand(df, "a", "c").first().ari) < 0.1


def test_mcnemar_p_value(spark):
    rows = [("g", "g", "x")] * 30 + [("g", "x", "g")] * 10 + [("g", "g", "g")] * 50
    r = ST.mcnemar(spark.createDataFrame(rows, "gold string, a string, b string"), "gold", [("a", "b")]).first()
    assert (r.only_a, r.only_b) == (30, 10)
    assert r.statistic == pytest.approx(19 * 19 / 40)
    assert r.p_value == pytest.approx(math.erfc(math.sqrt(19 * 19 / 80)), rel=1e-9)


def test_bootstrap_bounds_enclose_point(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 40}", int(rng.random() < 0.6), 1) for i in range(800)]
    df = spark.createDataFrame(rows, "grp string, hit int, n int")
    r = ST.cluster_bootstrap(df, "grp", ["hit", "n"], {"acc": F.col("hit") / F.col("n")}, rounds=300).first()
    assert r.lo <= r.point <= r.hi and 0.01 < r.hi - r.lo < 0.2


def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0)], "m int, g int, p int")
    r = df.select(*[c.alias(n) for n, c in G.prf(F.col("m"), F.col("g"), F.col("p")).items()]).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_positional_statistics(spark):
    rng = random.Random(2)
    vals = [round(rng.random(), 2) for _ in range(137)]
    df = spark.createDataFrame([("a", v) for v in vals], "k string, v double")
    r = G.positional(df, ["k"], "v", {"p10": G.floor_rank(1, 10), "p75": G.floor_rank(3, 4), "p95": G.ceil_rank(0.95)}).first()
    s = sorted(vals)
    assert (r.n, r.p10, r.p75, r.p95) == (137, s[13], s[137 * 3 // 4], s[math.ceil(137 * 0.95) - 1])


@pytest.mark.parametrize("n", [7, 25, 500])
def test_systematic_sample_matches_definition(spark, n):
    rng = random.Random(n)
    # one value holds a third of the rows
    rows = [(i, 7 if i % 3 == 0 else rng.randrange(40)) for i in range(213)]
    df = spark.createDataFrame(rows, "id int, v int")
    bucket = WI.even_buckets(df, "v", "id", descending=True, parts=16)
    idx = WI.ordered_index(df, [F.desc("v"), F.asc("id")], bucket)
    got = {r.id for r in WI.systematic_sample(idx, n).collect()}
    ordered = [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.id for r in idx.orderBy("row_idx").collect()] == ordered
    want = ordered if len(ordered) <= n else [
        ordered[k] for k in {min(len(ordered) - 1, int(round(i * (len(ordered) / float(n))))) for i in range(n)}]
    assert got == set(want)


def test_trailing_count_is_inclusive(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), rng.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, u int, t long")
    got = {r.id: r.n_trailing for r in WI.trailing_count(df, "u", "t", "id", 60).collect()}
    assert got == {i: sum(1 for _, v, s in rows if v == u and t - 60 <= s <= t) for i, u, t in rows}


def test_latest_and_dedupe(spark):
    df = spark.createDataFrame([("k", 1, "a", 0.5), ("k", 3, "b", 0.9), ("k", 2, "c", 0.9)], "k string, o int, v string, s double")
    assert WI.latest_per_key(df, ["k"], ["o"]).first().v == "b"
    assert WI.dedupe_strongest(df, ["k"], "s", "o").first().v == "c"


def test_containment_join_equals_nested_loop(spark):
    rng = random.Random(9)
    w = ["ab", "cd", "ef", "gh", "ij", "kl", "mn"]
    docs = [(i, " ".join(rng.choice(w) for _ in range(60))) for i in range(40)]
    quotes = []
    for j in range(60):
        t = docs[rng.randrange(40)][1]
        a = rng.randrange(0, 120)
        quotes.append((j, t[a : a + rng.choice([3, 9, 12, 20, 45])]))
    d = spark.createDataFrame(docs, "doc int, t string")
    qd = spark.createDataFrame(quotes, "q int, t string")
    got = {(r.q, r.doc) for r in J.containment_join(qd, "q", "t", d, "doc", "t").collect()}
    want = {(j, i) for j, q in quotes for i, t in docs if q.strip() and q.strip() in t}
    assert got == want


def test_containment_join_reads_the_documents_once(spark):
    """Quotes of all kinds, words cut at both ends and marks; each text is made ready once."""
    rng = random.Random(12)
    w = ["a", "ab", "abc", "cdé", "naïve_1", "xxxxxxxxxxy", "z9", "日本語の"]
    docs = [(i, "".join(rng.choice(w) + rng.choice([" ", ", ", "-", ". (", " ", " "]) for _ in range(30))) for i in range(30)]
    docs += [(98, ""), (99, None)]
    quotes = [(-1, "?!"), (-2, "- "), (-3, "("), (-4, None), (-5, "y")]
    for j in range(150):
        t = docs[rng.randrange(30)][1]
        a = rng.randrange(0, len(t))
        quotes.append((j, t[a : a + rng.choice([1, 2, 4, 7, 12, 20, 45, 70])]))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(t):
        seen.add(1)
        return t

    d = spark.createDataFrame(docs, "doc int, t string").select("doc", read.asNondeterministic()("t").alias("t"))
    qd = spark.createDataFrame(quotes, "q int, t string")
    got = sorted((r.q, r.doc) for r in J.containment_join(qd, "q", "t", d, "doc", "t").collect())
    assert seen.value == len(docs)
    want = sorted(
        (j, i) for j, q in quotes for i, t in docs if q and t and q.strip() and " ".join(q.split()) in " ".join(t.split())
    )
    assert got == want and len(got) > 150


def unit(v):
    return (v / np.linalg.norm(v)).tolist()


def test_dense_top_k_blocks_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    items = [(i, unit(rng.standard_normal(8))) for i in range(80)]
    queries = [(i, unit(rng.standard_normal(8))) for i in range(9)]
    i_df = spark.createDataFrame(items, "id long, v array<double>")
    q_df = spark.createDataFrame(queries, "id long, v array<double>")
    brute = {q: sorted(((-round(max(0.0, float(np.dot(a, b))), 6), i) for i, b in items))[:4] for q, a in queries}
    for block in (4096, 4):
        monkeypatch.setattr(RT, "QUERY_BLOCK", block)
        rows = RT.dense_top_k(i_df, "id", "v", q_df, "id", "v", 4).collect()
        for q in brute:
            mine = sorted((-r.score, r.item_id) for r in rows if r.query_id == q)
            assert [i for _, i in mine] == [i for _, i in brute[q]]


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((4, 6)) * 3
    pts = [c + rng.standard_normal(6) * 0.25 for c in centers for _ in range(30)]
    pts += [rng.standard_normal(6) * 4 for _ in range(25)] + [pts[0]] * 6
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, v array<double>")
    eps, k = 0.7, 5
    a = np.array(pts)
    near = ((a[:, None] - a[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= k
    comp = {}
    for s in range(len(pts)):
        if core[s] and s not in comp:
            stack, comp[s] = [s], s
            while stack:
                x = stack.pop()
                for y in np.nonzero(near[x] & core)[0]:
                    if int(y) not in comp:
                        comp[int(y)] = s
                        stack.append(int(y))
    sizes = {c: list(comp.values()).count(c) for c in set(comp.values())}
    want = {i: comp[i] if i in comp and sizes[comp[i]] >= 5 else -1 for i in range(len(pts))}
    for block in (2000, 7):
        monkeypatch.setattr(C, "BLOCK", block)
        got = {r.id: r.cluster_id for r in C.density_clusters(df, "id", "v", 6, eps, k, 5).collect()}
        groups = lambda m: {frozenset(i for i in m if m[i] == c) for c in set(m.values())}
        assert {i for i in got if got[i] == -1} == {i for i in want if want[i] == -1}
        assert groups(got) == groups(want)


def test_components_of_a_chain(spark):
    n = 200
    nodes = spark.range(n)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 120], "a long, b long")
    got = {r.id: r.component for r in C.connected_components(nodes, edges).collect()}
    assert set(got.values()) == {0, 121}


def test_group_mean_and_pca(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((40, 5))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(m)], "id long, k int, v array<double>")
    got = {r.k: r.mean for r in VE.group_mean(df, "k", "v").collect()}
    assert np.allclose(got[0], m[::2].mean(0))
    p = C.reduce_dims(df, "id", "v", 2).collect()
    assert len(p) == 40 and all(len(r.components) == 2 for r in p)


def test_folds_keep_groups_whole_and_auc(spark):
    rng = random.Random(8)
    rows = [(i, f"g{i % 13}", int(rng.random() < 0.4), round(rng.random(), 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, grp string, y int, s double")
    folds = {r.grp: r.fold for r in ML.group_folds(df, "grp", "y", 5).collect()}
    assert len(folds) == 13 and set(folds.values()) == set(range(5))
    pos = [s for *_, y, s in rows if y]
    neg = [s for *_, y, s in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert ML.rank_auc(df, "y", "s").first().auc == pytest.approx(want)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_bounded_top_k_equals_full_scores(spark, k):
    rng = random.Random(k)
    weights = {(t, d): rng.random() ** 3 for d in range(120) for t in rng.sample(range(40), rng.randrange(1, 9))}
    asked = {(q, t): rng.random() for q in range(12) for t in rng.sample(range(44), rng.randrange(1, 12))}
    posts = spark.createDataFrame([(f"t{t}", d, w) for (t, d), w in weights.items()], "term string, doc long, w double")
    terms = spark.createDataFrame([(q, f"t{t}", w) for (q, t), w in asked.items()], "q long, term string, w double")
    got = sorted((r.q, r["rank"], r.doc, r.score) for r in RT.bounded_top_k(posts, terms, "q", "doc", k).collect())
    want = []
    for q in range(12):
        sums = {}
        for (q2, t), w in asked.items():
            for d in range(120):
                if q2 == q and (t, d) in weights:
                    sums[d] = sums.get(d, 0.0) + w * weights[t, d]
        best = sorted((-round(s, 6), d) for d, s in sums.items())[:k]
        want += [(q, r, d, -s) for r, (s, d) in enumerate(best, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)


def test_few_blocks_meet_however_many_cells(spark, monkeypatch):
    """A point is sent once a near block; every near pair is found once, in whichever tiles it lies."""
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.standard_normal((300, 5)), 0.02 * rng.standard_normal((300, 5)) + 1.5, np.full((1, 5), 30.0)])
    rows = [(i, p.tolist(), 1 + i % 3) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, v array<double>, weight long")
    monkeypatch.setattr(C, "BLOCK", 100)
    monkeypatch.setattr(C, "TILE", 16)
    eps = 0.4
    points = C._blocked(df, 5, eps, len(rows))
    blocks = points.select("block").distinct().count()
    sent = C._block_pairs(points, eps)
    assert blocks <= 8 and sent.count() < len(rows) * (blocks + 1)
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= eps * eps + 1e-9
    got = sent.groupBy("l", "r").applyInArrow(C._near_weights(eps), "id long, n long").groupBy("id").sum("n").collect()
    assert {r[0]: r[1] for r in got} == dict(enumerate((near @ np.array([w for *_, w in rows])).tolist()))
    edges = sent.groupBy("l", "r").applyInArrow(C._joined(eps), "a long, b long")
    comp = {r.id: r.component for r in C.connected_components(points.select("id"), edges).collect()}
    want, todo = {}, []
    for s in range(len(rows)):
        if s not in want:
            want[s], todo = s, [s]
            while todo:
                for y in np.flatnonzero(near[todo.pop()]).tolist():
                    if y not in want:
                        want[y] = s
                        todo.append(y)
    assert comp == want


def test_few_true_places():
    rng = np.random.default_rng(2)
    for shape in ((3, 5), (7, 64), (1, 8), (4, 0)):
        for share in (0.0, 0.1, 1.0):
            mask = rng.random(shape) < share
            assert C._true_places(mask).tolist() == np.flatnonzero(mask).tolist()


def test_character_counts_in_one_pass(spark):
    texts = ["", "aab ä𝒳", None, "É É,, 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", VE.char_counts(F.col("t"), "aä ,1").alias("c"))
    assert df.where("t is null or size(c) > 0").collect() == [
        (t, None if t is None else [float(t.count(c)) for c in "aä ,1"]) for t in texts]
    plan = df.where("size(c) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("count(") == 1
