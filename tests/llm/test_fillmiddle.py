"""Fill-in-middle transformation against a per-text regular expression."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from clauseflow.llm import fillmiddle
from clauseflow.llm.fillmiddle import Plan, Summaries, chunk_ends, fill_in_middle, restore, units_of
from pyspark.sql import functions as F, types as T

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def brute(key, text, plan):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in plan.marks) or h[2] % 100 >= plan.rate:
        return len(units), "plain", None, None, text
    p_, s_, m_ = plan.marks
    if h[3] % 100 < plan.spm_rate:
        return len(units), "spm", len(p), len(m), s_ + s + p_ + p + m_ + m
    return len(units), "psm", len(p), len(m), p_ + p + s_ + s + m_ + m


def table(spark, rows):
    schema = "doc_id long, text string, n long, form string, output string, cut long, `a.b` long, row long"
    return spark.createDataFrame([(i, t, 1, "x", "y", 2, 3, 4) for i, t in rows], schema)


@pytest.mark.parametrize("plan", [Plan(), Plan(7, 100, 30), Plan(1, 100, 100, "[pre]", "{suf}", "|mid!")])
def test_against_units(spark, rows, plan):
    rng = random.Random(3)
    more = [
        (100, "x <M> y"), (101, " \t\n"), (102, "a" * 9000), (103, " " * 9000), (104, "\x00 <P >"),
        (105, "ends in space \n"), (106, "<S"), (107, "S>< P> M"), (108, "  lead"), (109, "\x1c\x85 x\x0b"),
        (110, "".join(rng.choice("ab é中\n \U0001f600") for _ in range(1 << 21))), (None, "no id at all"),
    ]
    every = [*rows, *more, *rows[:20]]
    got = fill_in_middle(table(spark, every), plan=plan)
    back = got.withColumn("back", restore(F.col("output"), F.col("form"), plan)).collect()
    found = Counter(
        (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in back
    )
    expect = Counter((i, *brute(i, t, plan), t or "") for i, t in every)
    assert found == expect
    assert {r["a.b"] for r in back} == {3} and {r["cut"] for r in back} == {2}
    if plan.rate == 100:
        assert {r.form for r in back} == ({"plain", "psm", "spm"} if plan.spm_rate < 100 else {"plain", "spm"})


def test_empty_table(spark):
    assert fill_in_middle(table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t中", max_size=400), max_size=5), st.integers(1, 4), st.integers(1, 40))
def test_every_cut(texts, bits, most):
    kept = fillmiddle.CUT_BITS, fillmiddle.LEAST, fillmiddle.MOST
    fillmiddle.CUT_BITS, fillmiddle.LEAST, fillmiddle.MOST = bits, 2, most
    try:
        found = units_of([t.encode() for t in texts], Summaries(limit=300))
    finally:
        fillmiddle.CUT_BITS, fillmiddle.LEAST, fillmiddle.MOST = kept
    for text, u in zip(texts, found):
        units = UNIT.findall(text)
        if u is None:
            assert not text
            continue
        assert u.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert u.cut(k) == (len(head.encode()), len(head))


def test_shared_text_is_summarised_once():
    rng = random.Random(5)
    shared = " ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))
    memo = Summaries()
    units_of([(f"head {i} " + shared).encode() for i in range(5)], memo)
    chunks = len(chunk_ends(np.frombuffer(shared.encode(), np.uint8)))
    assert chunks > 100 and memo.computed < chunks + 20


def test_marks_that_could_be_mistaken():
    with pytest.raises(ValueError):
        Plan(prefix="<<P", suffix="<S>", middle="<M>")
