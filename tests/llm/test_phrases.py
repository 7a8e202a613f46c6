"""Phrase mining against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from clauseflow.llm import phrases
from clauseflow.llm.phrases import Mining, Slice, _counted, collocations, frequent_phrases, phrase_keys

SCHEMA = "text string, lang string, f long, words long, phrase string, `a.b` long"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute_counts(rows, how):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, how.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i : i + k])] += 1
    return {x: c for x, c in f.items() if c >= how.least}, {x: c for x, c in n.items() if c}


def brute(rows, how, top):
    f, n = brute_counts(rows, how)
    out, longest = [], Counter()
    for (lang, phrase), c in f.items():
        w = phrase.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = lang, " ".join(w[i : i + k])
                longest[part] = max(longest[part], c)
    for (lang, phrase), a in f.items():
        w = phrase.split(" ")
        if len(w) < 2 or ((lang, phrase) in longest and 100 * longest[lang, phrase] >= 80 * a):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, phrase.encode(), left, right))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return ranked


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    common = [f"w{i}" for i in range(30)] + ["É", "中文", "a-b", "\x00", "x y", "'tis"]
    fixed = ["New York City hall", "de la mer", "one two three four five", "w1 w2 w1 w2 w1"]
    out = [(None, None), ("", "en"), (" \t ", None), ("...,;", "en"), ("word", ""), ("word word word", "")]
    for i in range(160):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(fixed) if rng.random() < 0.1 else rng.choice(common))
            words.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ? "]))
        out.append(("".join(words), rng.choice(["en", "fr", "de la", None])))
    out += out[20:60] * 2
    out.append((" ".join(rng.choice(common) for _ in range(300_000)), "long"))  # 1 MB
    out.append(("x" * (1 << 21) + " w1 w2 w3", "fr"))
    return out


@pytest.mark.parametrize("share", [0.3, 0.0])
def test_against_counting(spark, rows, share, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 1 << 10)
    how = Mining(least=5, share=share)
    docs = spark.createDataFrame([(t, x, 1, 2, "p", 3) for t, x in rows], SCHEMA).repartition(4)
    counts, totals = brute_counts(rows, how)
    got = frequent_phrases(docs, how=how).collect()
    assert {(r.lang, r.phrase): r.f for r in got if r.words} == counts
    assert len(got) == len(counts) + len(totals)
    assert {r.lang: r.f for r in got if not r.words} == totals
    found = [tuple(r) for r in collocations(docs, how=how, top=40).orderBy("lang", "rank").collect()]
    assert found == brute(rows, how, 40)
    assert {r[0] for r in found} >= {"en", "fr", "und", "de la", "long"}


def test_a_full_filter_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(phrases, "BITS_EACH", 1)
    how = Mining(least=4, share=0.5)
    docs = spark.createDataFrame([(t, x, 1, 2, "p", 3) for t, x in rows], SCHEMA)
    got = {(r.lang, r.phrase): r.f for r in frequent_phrases(docs, how=how).collect() if r.words}
    assert got == brute_counts(rows, how)[0]


class Holding:
    """A filter of these phrases."""

    def __init__(self, *listed):
        self.keys = phrase_keys(pa.array(["en"] * len(listed)), pa.array(listed))

    def hits(self, keys):
        return np.isin(keys, self.keys)


def test_a_phrase_let_in_by_mistake_hides_no_longer_one():
    s = Slice([b"a a a a b. a a c d"], "en")
    passes = [Holding("a a", "c"), Holding("a"), Holding("a a a", "d")]  # a a comes before its word
    found = [x for i in range(3) for t, n in _counted(s, 4, passes[: i + 1]) for x in zip(t.to_pylist(), n.tolist())]
    assert len(found) == len(dict(found))
    assert dict(found) == {
        b"a": 6, b"b": 1, b"c": 1, b"d": 1, b"a a": 4, b"a c": 1, b"a a a": 2, b"a a a a": 1, b"c d": 1,
    }


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([("a b", "en", 1, 2, "p", 3)], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    text = "a b. " * 40 + "a c. " * 10
    docs = spark.createDataFrame([(text, "en", 1, 2, "p", 3)], SCHEMA)
    (row,) = collocations(docs).collect()
    assert tuple(row) == ("en", 1, "a b", 40, 50, 40, 100, 2_000_000 * 40 // 90)
    big = spark.range(1).selectExpr(
        "cast(cast(9000000000000000000 as decimal(20,0)) * 2000000 div (cast(9100000000000000000 as decimal(20,0)) "
        "+ cast(9000000000000000000 as decimal(20,0))) as long) AS s"
    )
    assert big.first().s == 2_000_000 * 9 * 10**18 // (181 * 10**17)


def test_further_passes_make_texts_of_fresh_phrases_only(monkeypatch):
    texts = ["A b, c  d\te.", "", "f", "...", "É b\x00 中文! a b c", "a b c d e f g"]
    s = Slice([t.encode() for t in texts], "en")
    pieces = [re.findall("[^ \t]+", p) for t in texts for p in re.split("[.,;:!?\n-\r]", low(t))]
    words = [w for p in pieces for w in p]
    assert [s.words[i].as_py().decode() for i in s.ids.tolist()] == words
    together = [i + 1 < len(p) for p in pieces for i in range(len(p))]
    assert s.together.tolist() == together[:-1]
    at = np.flatnonzero(s.together)
    pairs = [b" ".join(x.encode() for x in words[i : i + 2]) for i in at.tolist()]
    assert s.texts(at, 2).to_pylist() == pairs
    assert (s.keys(at, 2) == phrase_keys(pa.array(["en"] * len(at)), pa.array(pairs))).all()

    class Holds:
        def __init__(self, keys):
            self.keys = keys

        def hits(self, keys):
            return np.isin(keys, self.keys)

    known = s.keys(np.arange(len(s.ids)), 1)
    made = []
    plain = Slice.texts
    monkeypatch.setattr(Slice, "texts", lambda self, at, k: made.append(len(at)) or plain(self, at, k))
    new = s.keys(at[:1], 2)  # "a b": only the phrases it is a part of are fresh
    found = [x for t, _ in _counted(s, 4, [Holds(known), Holds(new)]) for x in t.to_pylist()]
    assert found == [] and made == []
    both = np.concatenate((new, s.keys(at[-6:], 2)))
    found = [x for t, _ in _counted(s, 4, [Holds(known), Holds(both)]) for x in t.to_pylist()]
    assert set(found) == {b"a b c", b"b c d", b"c d e", b"d e f", b"e f g"} and sum(made) == len(found)
