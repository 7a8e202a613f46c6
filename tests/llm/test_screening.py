"""Decontamination, secrets, fingerprints, language ID, pages and the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauseflow.llm import imatch, langid, secrets
from clauseflow.llm.decontaminate import SuffixAutomaton, mark_contamination, remove_spans
from clauseflow.llm.jaccard import Similarity
from clauseflow.llm.pages import blocks, extract, importance, host_of

from test_dedup import brute_components

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(rows, items, window=13):
    wins = []
    for k, t in items:
        w = words(t)
        size = min(window, len(w))
        if w:
            wins += [(k, tuple(w[i : i + size])) for i in range(len(w) - size + 1)]
    for i, t in rows:
        w = words(t)
        hit, found = [False] * len(w), set()
        for k, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit[p : p + len(win)] = [True] * len(win)
                    if k is not None:
                        found.add(str(k))
        n = sum(hit)
        yield i, len(w), n, tuple(sorted(found)), n > 0 and 20 * n >= len(w)


def items_of(rows):
    long = dict(rows)[31].split(" ")
    return [
        (1, " ".join(long[3:40])), (2, " ".join(long[10:25]).upper()), (3, "Two words"), (4, None), (5, "..."),
        (6, " ".join(long[3:40])), (7, " ".join(dict(rows)[45].split()[2:9])), (None, "spam spam"), (11, "nowhere at all " * 6),
    ]


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_contamination(spark, docs, rows, none, most):
    items = items_of(rows)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = mark_contamination(docs, table, most=most)
    found = Counter(
        (r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items), r.contaminated) for r in got.collect()
    )
    assert found == Counter(brute_contamination(rows, items))
    assert len({k[4] for k in found}) == 2
    assert mark_contamination(none, table).count() == 0
    assert mark_contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_spans_are_cut_out(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "Before — ONE two, " + item[8:] + ". After " + "other " * 400
    marked = mark_contamination(
        spark.createDataFrame([(1, text)], "doc_id long, text string"),
        spark.createDataFrame([(1, item)], "item_id long, text string"),
    )
    row = remove_spans(marked).first()
    assert not row.contaminated and row.n_hit == 14
    assert row.clean_text == "Before — . After " + "other " * 400


def test_automaton_matches_every_window():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(25)]
    window = 4
    a = SuffixAutomaton(items, window)
    text = rng.integers(0, 3, 300).tolist()
    got = {(i - size + 1, size, n) for i, size, ns in a.stream(text, window) for n in ns}
    want = set()
    for n, item in enumerate(items):
        size = min(window, len(item))
        for k in range(len(item) - size + 1):
            for p in range(len(text) - size + 1):
                if text[p : p + size] == item[k : k + size]:
                    want.add((p, size, n))
    assert got == want


ASSIGN = re.compile(
    r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A
)


def test_secrets(spark, none):
    rng = np.random.default_rng(3)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    base64 = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 64)) for _ in range(60)]
    ordinary = ["internationalizationprocess", "the/usual/path/to/some/file/in/a/tree", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1a1", "20240101202401012024010120240101"]
    texts = [
        None, "", "secret: token: abcdefghij", "PassWord = 'hunter2hunter2' and api_key=short", "\U0001f600é AKIA" + "Z9" * 8 + "a",
        "AKIAABC AKIA" + "Q" * 11, "x" + hexes[0][:32] + "g" + "0" * 31, "token:=x", "TOKEN=abcdefgh\nsecret = \"a.b-c_d/e+f=\"",
        *[f"see {h} here" for h in hexes], *[f"key {b}" for b in base64], *[f"so {o} it is" for o in ordinary * 3],
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hex long")
    rows = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert len(rows) == len(texts)
    kinds = secrets.KINDS
    right = wrong = 0
    for i, t in enumerate(texts):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert rows[i].base == ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)), t
        assert set(filter(None, rows[i].base.split(","))) <= set(rows[i].spans.split(","))
        cut = [t[r.start : r.end] for r in rows[i].random]
        if 9 <= i < 129:
            right += bool(cut)
        elif i >= 129:
            wrong += bool(cut)
    assert right >= 110 and wrong == 0
    assert secrets.scan(none).count() == 0


def test_fingerprints(spark, docs, rows, none):
    lexicon = imatch.learn_lexicon(docs)
    got = imatch.compare_with_edits(docs, lexicon).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in imatch.fingerprints(docs, lexicon).collect():
        assert prints.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert {r.doc_id: r.fingerprint for r in got}[10] == prints[dict(rows)[10]]
    assert imatch.compare_with_edits(none, lexicon).count() == 0
    one = spark.createDataFrame([(1, "just one text here")], "doc_id long, text string")
    assert imatch.compare_with_edits(one, imatch.learn_lexicon(one)).first().near_next == 1.0


def test_lexicon_leaves_out_terms_of_one_document(spark):
    """Terms of one document stay out however many terms there are."""
    rows = []
    for k in range(60):
        shared = " ".join(f"both{k}x{i}" for i in range(30))
        rows += [(2 * k, shared), (2 * k + 1, shared + " " + " ".join(f"own{k}x{i}" for i in range(4000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = imatch.learn_lexicon(docs)
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(docs, lexicon).collect()}
    for k in range(60):
        assert prints[2 * k] == prints[2 * k + 1]
    assert len(set(prints.values())) == 60


def test_fingerprints_see_all_terms_of_long_texts(spark):
    """Long texts that differ in one term of the lexicon are told apart."""
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words)] + [" ".join(words[:k] + words[k + 1 :]) for k in range(0, 5000, 500)]
    rows = [(i, texts[i % len(texts)]) for i in range(2 * len(texts))] + [(100 + i, f"o{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = imatch.compare_with_edits(docs, imatch.learn_lexicon(docs)).where("doc_id < 22").collect()
    assert len({r.fingerprint for r in got}) == len(texts)
    assert all(0.5 < r.near_next < 1 for r in got if r.doc_id < 21)
    assert all(0 < r.near_edited < 1 for r in got if 0 < r.doc_id < 21)


def test_language(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    got = langid.identify(docs, model).where(langid.held_out(F.col("doc_id")))
    share = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.max(F.col("rejected").cast("int"))).first()
    assert share[0] >= 0.98 and share[1] == 0
    odd = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, "12 34 || --", 5), (4, "русский текст без обучения", 5), (5, "the and of it is that with", 5), (6, "a", 5)],
        "doc_id long, text string, score long",
    )
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    for i in (1, 2, 3):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[4].rejected and rows[4].lang_pred in model.languages
    assert (rows[5].lang_pred, rows[5].rejected) == ("en", False)
    assert rows[6].lang_pred in model.languages and 0 <= rows[6].score <= 1
    empty = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none.withColumn("lang", F.lit("en")), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=x>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<div class=box>Latest   offers</div><div class="body"><h1>{t}</h1><p>First &amp; <b>bold {t}<br>line<p>Second&nbsp;one
<ul><li>item {t}</ul><div class="comments"><p>nice post</p></div></div><form>q</form><footer>&copy; x</footer>"""


def test_pages(spark):
    rows = [(i, f"http://u@h.example:80/{i}", PAGE.format(t=f"t{i}"), 1) for i in range(12)]
    rows += [(20, None, None, 1), (21, "nonsense", "", 1), (22, "http://one.example/", "<article><p>only</article><div>side", 1)]
    rows += [(23, "HTTP://H.example/x", "<div class=box>Latest offers</div><p>cut <b", 1), (24, "http://h.example", "a < b", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long")
    got = {r.page_id: r.main_text for r in extract(df).collect()}
    for i in range(12):
        assert got[i] == f"t{i}\nFirst & bold t{i} line\nSecond one\nitem t{i}"
    assert got[20] == got[21] == ""
    assert got[22] == "only\nside" and got[23] == "cut" and got[24] == "a < b"
    tree = importance(df.select(host_of(F.col("url")).alias("host"), "html")).where("host = 'h.example'")
    assert tree.agg(F.min("importance"), F.max("importance")).first()[1] > 0.8
    assert extract(df.limit(0)).count() == 0


def test_pages_repeated_branch_inside_article(spark):
    page = (
        "<article><h1>{t}</h1><div><p>Story {t}</p></div><section><p>Get our letter</p></section>"
        "<div class=voices><p>Readers say</p></div></article><div class=menu>m</div>"
    )
    rows = [(i, "http://a.example/", page.format(t=f"t{i}")) for i in range(8)]
    # copies keep their article, a page of another host keeps all of it
    rows += [(20 + i, "http://b.example/", page.format(t="same")) for i in range(4)]
    rows += [(30, "http://c.example/", page.format(t="only"))]
    got = {r.page_id: r.main_text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"t{i}\nStory t{i}"
    assert {got[20 + i] for i in range(4)} == {"same\nStory same\nGet our letter\nReaders say"}
    assert got[30] == "only\nStory only\nGet our letter\nReaders say"


def test_blocks_of_broken_markup():
    text = [t for _, _, t in blocks("<p>a<p>b<div>c<!-- x --d</p><script>1<2</div><p>e")]
    assert text == ["a", "b", "c"] or text[:3] == ["a", "b", "c"]


def test_pipeline(spark, rows, tmp_path):
    for sub in ("sf",):
        base = f"{tmp_path}/{sub}"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = docs.where("n_chars > 1500").orderBy("doc_id").first().text.replace("\n", " ")
    extra = spark.createDataFrame(
        [(900_000, None, "en", "s", None), (900_001, "||| 12 --", "en", "s", 9)]
        + [(900_002 + i, f"{near} x{i}", "en", "s", 9) for i in range(4)],
        docs.schema,
    )
    docs.unionByName(extra).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{base}/benchmark.parquet")
    current = spark.read.parquet(f"{base}/documents.parquet")
    counts = [current.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, base)
        if name != "bpe_tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{base}/{name}")
        current = spark.read.parquet(f"{base}/{name}")
        counts.append(current.count())
    assert counts[1] == counts[0] - 2 and counts[2] == counts[1]
    lines = spark.read.parquet(f"{base}/line_dedup").collect()
    assert all(r.n_chars == len(r.text) for r in lines)
    groups = brute_components([(r.doc_id, r.text) for r in lines], Similarity(5, 80, 100))
    assert counts[3] == len({c for _, _, c in groups}) and counts[5] == counts[4]
    left = spark.read.parquet(f"{base}/decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/near_duplicates").collect()]
    clean = {i for i, *_, bad in brute_contamination(before, items) if not bad}
    assert {r.doc_id for r in left.collect()} == clean
    assert current.where("not round_trip").count() == 0
    empty = f"{base}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{base}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ('<body class="single no-sidebar"><article><h1>Title</h1><p>Text', "Title\nText"),
        ('<div class="page with-nav"><main><p>Story', "Story"),
        ('<article class="post comment-status-open"><p>Story', "Story"),
        ('<main id="search"><p>Story', "Story"),
        ('<body id="menu"><div class="sidebar"><p>x</p></div><p>Story', "Story"),
        ('<div class="site-footer">f</div><div class="comment-list">c</div><p class="no-ads">Story', "Story"),
        (
            '<article><p>a<div class="comments"><article class="comment"><p>c</article></div></article>'
            "<aside><article><p>teaser</article></aside>",
            "a",
        ),
    ],
)
def test_names_of_the_article_and_above_say_nothing(html, text):
    from clauseflow.llm.pages import THRESHOLD, main_text

    assert main_text(html, {}, THRESHOLD) == text
