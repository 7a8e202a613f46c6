"""URL filters against enumeration of all token combinations."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations

import pytest

from clauseflow.llm.urlfilter import Mining, Rule, judge

RULES = [
    Rule("allow", "org"), Rule("block", "ex.org", "/es/"), Rule("block", "ex.org", "/en/1"), Rule("block", "com", "/de/"),
]


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def parts(url):
    found = re.search(r"://([^/?#]*)([^?#]*)\??([^#]*)", url or "")
    return (low(found[1]), found[2], found[3]) if found else ("", "", "")


def tokens(url):
    host, path, query = parts(url)
    out = ["host=" + x for x in host.split(".") if x] + ["path=" + x for x in path.split("/") if x]
    out += ["query=" + x for x in re.sub("=[^&]*", "", query).split("&") if x]
    return {re.sub("[0-9]+", "0", t) for t in out}


def stated(url):
    host, path, _ = parts(url)
    fits = [
        (len(r.host + r.path), r.host + r.path, r.verdict)
        for r in RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits)[1:] if fits else None


def brute(urls, how):
    labelled = [(tokens(u), stated(u)[1]) for u in urls if stated(u)]
    total, allowed = len(labelled), sum(v == "allow" for _, v in labelled)
    told = {}
    for t in {t for ts, _ in labelled for t in ts}:
        has = [v for ts, v in labelled if t in ts]
        if len(has) >= math.ceil(how.support * total):
            told[t] = abs(has.count("allow") / len(has) - allowed / total)
    counts = {}
    for ts, v in labelled:
        items = sorted((t for t in ts if t in told), key=lambda t: (-told[t], t))[: how.items]
        for k in range(1, len(items) + 1):
            for c in combinations(sorted(items), k):
                counts.setdefault(c, []).append(v)
    mined = []
    for c, vs in counts.items():
        for v in ("allow", "block"):
            n = vs.count(v)
            if n and n >= math.ceil(how.support * total) and n / len(vs) >= how.confidence:
                mined.append((-n / len(vs), -n, len(c), " ".join(c), v, set(c)))
    usual = "block" if 2 * allowed < total else "allow"
    out = []
    for u in urls:
        rule, fired = stated(u), [m for m in mined if m[5] <= tokens(u)]
        host, path, _ = parts(u)
        if rule:
            out.append((host, path, rule[0], rule[1], "rule", None))
        elif fired:
            best = min(fired, key=lambda m: m[:5])
            out.append((host, path, None, best[4], "mined", best[3]))
        else:
            out.append((host, path, None, usual, "default", None))
    return out


def urls(n, seed):
    rng = random.Random(seed)
    out = [None, "", "no scheme", "http://", "ftp://ORG", "://com/de/", "http://ex.org/en/1", "http://Ex.ORG/es/",
           "http://notex.org/es/", "http://a.ex.org/es/x", "http://org?x/y", "http://com#/de/", "http://com/de/?a=1&a=2&&b",
           "x://a.com/fr/\n/de?q#f", "http://é.com/É/7", "http://" + "a." * 3000 + "net/" + "p/" * 3000]
    for _ in range(n):
        host = rng.choice(["", "www.", "m."]) + rng.choice(["ex", "pills", "news"]) + rng.choice([".org", ".com", ".net"])
        lang = rng.choice(["de", "en", "es", "fr"])
        tail = rng.choice(["", "/", ".html", "?page=2&ref=x", "?utm=1", "#top"])
        out.append(f"http://{host}/{lang}/{rng.randrange(2000)}{tail}")
    return out


@pytest.mark.parametrize("how", [Mining(), Mining(0.05, 0.6, 4)])
def test_against_all_combinations(spark, how):
    given = urls(400, 1)
    given += given[:30]  # repeated rows
    schema = "page_id long, url string, tokens long, stated string, `in.dex` long, verdict string"
    pages = spark.createDataFrame([(i, u, 1, "s", 2, "old") for i, u in enumerate(given)], schema)
    got = judge(pages.repartition(3), RULES, how=how).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.basis, r.evidence) for r in got}
    expect = brute(given, how)
    assert len(got) == len(given)
    assert [found[i] for i in range(len(given))] == expect
    assert {e[4] for e in expect} == {"rule", "mined", "default"}
    assert all(r.tokens == 1 and r.stated == "s" and r["in.dex"] == 2 for r in got)


def test_nothing_to_learn_from(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in judge(pages, RULES).collect()] == ["allow", "allow"]
    assert [r.rule for r in judge(pages, []).collect()] == [None, None]
    assert judge(pages.limit(0), RULES).count() == 0
    only = spark.createDataFrame([(1, "http://ex.com/de/"), (2, "http://a.net/")], "page_id long, url string")
    assert {r.verdict for r in judge(only, RULES).collect()} == {"block"}


def test_tokens_beyond_the_most_telling_combine(spark):
    """Six tokens stand in all URLs of two groups; the pair that decides tells little by its parts."""
    many = "&".join(f"t{c}=1" for c in "abcdef")
    given = []
    for i in range(60):
        pair = ("", "p", "q", "p&q")[i % 4]
        lang = "com/de" if pair in ("p", "q") else "org/de"
        given.append(f"http://{lang}/x?{many}&{pair}")
    given += [f"http://org/en/{i}?z" for i in range(20)]
    given += [f"http://net/x?{many}&p", f"http://net/x?{many}&p&q", f"http://net/r/x?{many}&q", "http://net/?p", "http://net/?q&p"]
    how = Mining(0.05, 0.9)
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.basis, r.evidence) for r in judge(pages, RULES, how=how).collect()}
    assert [found[i] for i in range(len(given))] == brute(given, Mining(0.05, 0.9, 99))
    capped = {r.page_id: (r.verdict, r.evidence) for r in judge(pages, RULES, how=Mining(0.05, 0.9, 8)).collect()}
    assert any(capped[i] != (found[i][3], found[i][5]) for i in found)
