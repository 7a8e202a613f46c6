"""Line dedup, n-gram Jaccard join and substring dedup against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from clauseflow.llm import jaccard
from clauseflow.llm.jaccard import Similarity, drop_near_duplicates, link_components
from clauseflow.llm.linededup import dedup_lines
from clauseflow.llm.substrings import dedup_substrings

WHITE = " \t\n\x0b\x0c\r"


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def test_line_dedup(docs, rows, none):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[lower(line.strip(WHITE))].add(i)
    expect = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")

        def stays(line):
            k = lower(line.strip(WHITE))
            return i is None or len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == i

        kept = [x for x in lines if stays(x)]
        expect[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    got = dedup_lines(docs)
    assert "row" in got.columns and "doc" in got.columns
    found = Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect())
    assert found == expect
    assert sum(k[3] for k in found) > 0
    assert dedup_lines(none).count() == 0


def sets_of(text, n):
    words = [w for w in re.split("[" + WHITE + "]+", lower(text or "")) if w]
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([("short", *words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, sim):
    sets = [sets_of(t, sim.n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    usable = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    for a in usable:
        for b in usable:
            same = rows[a][0] == rows[b][0]
            both = len(sets[a] & sets[b])
            if a < b and (same or sim.den * both >= sim.num * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    least = {}
    for k in usable:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [
        (i, len(sets[k]), least[find(k)] if k in usable else i) for k, (i, _) in enumerate(rows)
    ]


@pytest.mark.parametrize("open_pairs", [2, 0.01])
@pytest.mark.parametrize("sim", [Similarity(4, 85, 100), Similarity()])
def test_components(docs, rows, sim, open_pairs, monkeypatch):
    if open_pairs < 1 and sim.n == 5:
        pytest.skip("one similarity is enough for the hub rounds")
    monkeypatch.setattr(jaccard, "OPEN_PAIRS", open_pairs)
    got = link_components(docs, sim=sim).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(
        brute_components(rows, sim)
    )
    staying = [r for r in got if r.stays]
    # one text of each component; rows without id or words all stay
    chosen = Counter(r.component_id for r in staying if r.n_shingles and r.doc_id is not None)
    texts = {(i, t) for i, t in rows}
    assert all(n == 1 or len([k for k in texts if k[0] == c]) < n for c, n in chosen.items())
    assert {r.component_id for r in got} == {r.component_id for r in staying}


def test_pairs_of_unequal_size(spark):
    """One text is the other plus words of its own, above, at and just below the threshold."""
    rows = []
    for k in range(48):
        size, more = ((55, 9), (51, 9), (51, 10), (120, 21))[k % 4]
        words = [f"w{k}x{i}" for i in range(size + 4 + more)]
        rows += [(2 * k, " ".join(words[: size + 4])), (2 * k + 1, " ".join(words))]
    sim = Similarity(5, 85, 100)
    got = link_components(spark.createDataFrame(rows, "doc_id long, text string"), sim=sim).collect()
    expect = brute_components(rows, sim)
    assert sum(c != i for i, _, c in expect) == 36
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(expect)


def test_empty_join(none):
    assert drop_near_duplicates(none).count() == 0


def test_choose_match_prefers_longer_prefixes_when_candidates_cost():
    import numpy as np

    assert jaccard.choose_match(np.zeros(20), 100, 10, 4) == 1
    assert jaccard.choose_match(np.full(20, 50.0), 5000, 10, 4) == 4


def brute_substrings(rows, window):
    texts = [[w for w in re.split("[" + WHITE + "]+", t or "") if w] for _, t in rows]
    seen = Counter()
    for w in texts:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)


@pytest.mark.parametrize("window", [35, 6])
def test_substrings(docs, rows, none, window):
    got = dedup_substrings(docs, window=window).collect()
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got)
    assert found == Counter(brute_substrings(rows, window))
    assert sum(k[2] for k in found) > 0
    assert all(sum(s.end - s.start for s in r.repeats) == r.n_removed for r in got)
    assert dedup_substrings(none).count() == 0


@pytest.mark.parametrize("folder", [True, False])
def test_filters_are_mapped_or_broadcast(spark, monkeypatch, folder):
    import numpy as np

    from clauseflow.llm import twofilters
    from clauseflow.llm.words import U, mix

    if not folder:
        monkeypatch.setattr(twofilters, "shared_dir", lambda s: "store://bucket/shared")
    ids = spark.createDataFrame([(i % 700,) for i in range(1000)], "id long").repartition(3)

    def keys_of(batch):
        yield mix(batch.column("id").to_numpy().astype(U))

    once, twice = twofilters.build(ids, keys_of, 1 << 17, 3)
    assert (once.path is None) != folder
    met = mix(np.arange(2000, dtype=U))
    assert once.hits(met)[:700].all() and once.hits(met)[700:].mean() < 0.01
    assert twice.hits(met)[:300].all() and twice.hits(met)[300:].mean() < 0.02
    seen = ids.mapInArrow(lambda bs: (b.filter(__import__("pyarrow").array(twice.hits(next(keys_of(b))))) for b in bs), "id long")
    assert seen.where("id < 300").count() == 600
    twice.release()
    once.release()


def test_values_of_a_column_come_in_slices():
    import pyarrow as pa

    from clauseflow.llm.words import chunks, each_value

    column = pa.array([None, b"", b"ab"] * 400 + [b"x" * (1 << 20)], pa.binary())
    assert list(each_value(column, 7)) == column.to_pylist()
    assert [list(c) for c in chunks(column, 100)] == [list(c) for c in chunks(column.to_pylist(), 100)]


def test_pairs_far_apart_are_not_verified(spark, monkeypatch):
    """Texts of one long passage and a few own words meet in all their prefixes, yet cannot link."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        both = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = both[: rng.integers(1, 300)], both[rng.integers(0, 200) :]
        differ = np.bitwise_count((jaccard.parity_map(a) ^ jaccard.parity_map(b)).view(np.uint64)).sum()
        assert differ <= len(np.setxor1d(a, b))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"{passage} a{i} b{i} c{i}") for i in range(40)] + [(90, f"{passage} a7 b7 c7 d")]
    verified = []
    plain = jaccard._verified

    def counted(pairs, texts, sim):
        verified.append(pairs.count())
        return plain(pairs, texts, sim)

    monkeypatch.setattr(jaccard, "_verified", counted)
    out = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert got == {i: 7 if i == 90 else i for i, _ in rows}
    assert 1 <= sum(verified) <= 150  # of 820 pairs


def test_maps_of_unequal_length_never_forbid_a_link(spark):
    """Folded maps cost less in the shuffle and still tell unrelated sets apart."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    sim = Similarity(4, 85, 100)
    rows, lengths = [], set()
    for k in range(120):
        size = int(rng.integers(1, 1200))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        own = rng.integers(0, 2**63, size).astype(np.uint64)
        for related, b in ((True, np.concatenate([a, own[: size // 9]])), (False, own)):
            links = sim.linked(np.sort(a), np.sort(b))
            maps = [jaccard.folded_map(x, sim).tolist() for x in (a, b)]
            lengths.add(tuple(map(len, maps)))
            rows.append((related, links, maps[0], maps[1], len(a) + len(b)))
    df = spark.createDataFrame(rows, "related boolean, links boolean, a array<bigint>, b array<bigint>, n long")
    got = df.withColumn("may", jaccard._maps_allow("a", "b", F.col("n"), sim)).collect()
    assert all(r.may for r in got if r.links) and sum(r.links for r in got) > 80
    assert sum(r.may for r in got if not r.related) <= 12
    assert {(1, 1), (2, 2), (4, 4), (8, 8)} <= lengths and any(x != y for x, y in lengths)
