"""Matching of predicted flags with reference findings.

Counts come from one conditional aggregation.  Pair scores need an order-dependent 1:1
assignment, which runs per episode inside the row that holds both arrays; an episode is
one document, so the arrays are bounded by one text.
"""

from __future__ import annotations

import difflib
from collections import Counter, defaultdict, deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clauseflow import lexicon as L
from clauseflow.functions import text as X
from clauseflow.lexicon import LexiconPack
from clauseflow.session import literal_table

PAIR = "array<struct<gold_idx:int,pred_idx:int,sem:double,ent:double,cr:double>>"
PAIR_FIELDS = ("gold_idx", "pred_idx", "sem", "ent", "cr")
PAIR_ARROW = pa.list_(
    pa.struct([(f, pa.int32() if f.endswith("idx") else pa.float64()) for f in PAIR_FIELDS])
)
VECTORS = "array<struct<quote:string,vector:array<double>>>"
#: Episodes whose findings are objects of Python at once.
EPISODES = 64


# ------------------------------------------------------------------ counts
def episode_counts(gold: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """Gold, predicted and matched counts per episode in a single shuffle.

    For exact types the 1:1 assignment matches min(gold, predicted) per type, so the count
    needs no pairs.  Both sides are stacked and folded into one conditional sum per type
    (the types are a fixed enumeration), with map-side partial aggregation.
    """
    stacked = gold.select(key, F.col("finding_type").alias("t"), F.lit(True).alias("is_gold")).unionByName(
        flags.select(key, F.col("flag_type").alias("t"), F.lit(False).alias("is_gold"))
    )
    sums = []
    for t in L.FINDING_TYPES:
        hit = F.col("t") == t
        sums.append(F.count_if(hit & F.col("is_gold")).alias(f"g_{t}"))
        sums.append(F.count_if(hit & ~F.col("is_gold")).alias(f"p_{t}"))
    return stacked.groupBy(key).agg(*sums).select(key, *match_totals())


def match_totals() -> list[Column]:
    """Gold, predicted and matched totals from the per-type columns ``g_*`` and ``p_*``."""

    def total(expr, types) -> Column:
        out = F.lit(0).cast("long")
        for t in types:
            out = out + expr(t)
        return out

    g, p = (lambda t: F.col(f"g_{t}")), (lambda t: F.col(f"p_{t}"))
    both = lambda t: F.least(g(t), p(t))
    return [
        total(g, L.FINDING_TYPES).alias("n_gold"),
        total(p, L.FINDING_TYPES).alias("n_pred"),
        total(g, L.SPECIFIC_TYPES).alias("n_gold_specific"),
        total(p, L.SPECIFIC_TYPES).alias("n_pred_specific"),
        total(both, L.FINDING_TYPES).alias("matched"),
        total(both, L.SPECIFIC_TYPES).alias("matched_specific"),
    ]


def text_type_counts(text: Column, pack: LexiconPack) -> list[Column]:
    """Per-type match counts of both pattern lists, straight from the text.

    One scan gives every count an episode needs: nothing is exploded and only numbers
    leave the row.
    """
    return [
        X.pattern_count(text, p).cast("long").alias(f"{side}_{p.finding_type}")
        for side, patterns in (("g", pack.gold), ("p", pack.flags))
        for p in patterns
    ]


def type_counts(gold: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Gold, predicted and matched counts per (keys, type)."""
    stacked = gold.select(
        *keys, F.col("finding_type").alias("ftype"), F.lit(1).alias("g"), F.lit(0).alias("p")
    ).unionByName(
        flags.select(
            *keys, F.col("flag_type").alias("ftype"), F.lit(0).alias("g"), F.lit(1).alias("p")
        )
    )
    return (
        stacked.groupBy(*keys, "ftype")
        .agg(F.sum("g").alias("gold"), F.sum("p").alias("pred"))
        .withColumn("matched", F.least("gold", "pred"))
    )


# ------------------------------------------------------------------ types
def synonyms(spark: SparkSession, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """Directed synonym pairs; at most 7 x 7 rows, so always safe to broadcast."""
    rows = [(g, p) for g, ps in table.items() for p in dict.fromkeys((g, *ps))]
    return literal_table(spark, rows, ("finding_type", "flag_type"))


def fuzzy_type_match(gold_type: Column, pred_type: Column, table=L.MATCHER_SYNONYMS) -> Column:
    hit = gold_type == pred_type
    for g, ps in table.items():
        hit = hit | ((gold_type == g) & pred_type.isin(*ps))
    known = (F.coalesce(gold_type, F.lit("")) != "") & (F.coalesce(pred_type, F.lit("")) != "")
    return known & hit


def candidate_totals(gold: DataFrame, flags: DataFrame, key: str, table) -> DataFrame:
    """Number of candidate pairs per episode and gold type under the synonym table.

    Counts are taken per type first, so the join meets at most 7 x 7 rows per episode and
    never the finding pairs themselves.
    """
    g = gold.groupBy(key, "finding_type").agg(F.count(F.lit(1)).alias("n_gold"))
    p = flags.groupBy(key, "flag_type").agg(F.count(F.lit(1)).alias("n_pred"))
    syn = F.broadcast(synonyms(gold.sparkSession, table))
    return (
        g.join(syn, "finding_type")
        .join(p, [key, "flag_type"])
        .groupBy(key, "finding_type")
        .agg(
            F.sum(F.col("n_gold") * F.col("n_pred")).alias("candidate_pairs"),
            F.max("n_gold").alias("n_gold"),
            F.sum("n_pred").alias("n_reachable"),
        )
    )


def containment_candidates(gold: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """(key, type, quote, flag_quote, n_gold, n_flag, cr) over all gold x flag candidates.

    Candidates are the findings and flags of one type in one episode. Equal quotes count once,
    with their numbers; a pair without a common token has the ratio 0 and is no row. The pairs
    come from a join on the token, so a quote meets only quotes it shares a token with.
    """

    def side(df: DataFrame, type_col: str, n: str) -> DataFrame:
        counted = df.groupBy(key, F.col(type_col).alias("type"), "quote").agg(F.count(F.lit(1)).alias(n))
        return counted.withColumn("tokens", X.tokens(F.col("quote")))

    g, p = side(gold, "finding_type", "n_gold"), side(flags, "flag_type", "n_flag")
    gt = g.select(key, "type", "quote", "n_gold", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    pt = p.select(key, "type", F.col("quote").alias("flag_quote"), "n_flag", F.explode("tokens").alias("token"))
    both = gt.join(pt, [key, "type", "token"])
    return both.groupBy(key, "type", "quote", "flag_quote").agg(
        F.first("n_gold").alias("n_gold"),
        F.first("n_flag").alias("n_flag"),
        (F.count(F.lit(1)) / F.first("size")).alias("cr"),
    )


# ------------------------------------------------------------------ assignment
def finding_arrays(
    gold: DataFrame, flags: DataFrame, vectors: DataFrame | None, key: str, pack: LexiconPack
) -> DataFrame:
    """One row per episode with both sides as ordered arrays, ready for ``assign``.

    ``vectors`` is (quote, vector), one row per distinct quote.  An episode holds the vector of a
    quote once, in ``vectors``, however many of its findings have the quote.  A frequent quote makes
    the episodes' side of that join skewed, which AQE splits; the dictionary side has unique keys.
    """

    def side(df: DataFrame, type_col: str, extra: list[str]) -> DataFrame:
        out = df.withColumn("quote", F.trim("quote"))
        ents = X.entities(F.col("quote"), pack)
        for c in extra:
            ents = F.array_union(ents, X.entities(F.col(c), pack))
        item = F.struct(
            "type_ord", "idx",
            F.col(type_col).alias("type"),
            "quote",
            X.tokens(F.col("quote")).alias("tokens"),
            ents.alias("entities"),
        )
        return out.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))

    g = side(gold, "finding_type", [c for c in ("description",) if c in gold.columns])
    wanted = gold.select(key).distinct()
    flags = flags.join(wanted, key, "left_semi")
    p = side(flags, "flag_type", [])
    both = g.withColumnRenamed("items", "gold").join(
        p.withColumnRenamed("items", "pred"), key, "left"
    )
    if vectors is None:
        return both.withColumn("vectors", F.lit(None).cast(VECTORS))
    quotes = gold.select(key, F.trim("quote").alias("quote")).unionByName(
        flags.select(key, F.trim("quote").alias("quote"))
    ).distinct()
    item = F.struct("quote", F.col("vector").cast("array<double>").alias("vector"))
    each = quotes.join(vectors, "quote").groupBy(key).agg(F.collect_list(item).alias("vectors"))
    return both.join(each, key, "left")


def _greedy(gold, pred, vectors, reach, gate, min_sim, use_entities, prefer_last):
    """Ordered 1:1 assignment of one episode; equal quotes share one queue and one score."""
    queues: dict[tuple, deque] = defaultdict(deque)
    sample: dict[tuple, dict] = {}
    for i, p in enumerate(pred):
        sig = (p["type"], p["quote"])
        queues[sig].append(i)
        sample.setdefault(sig, p)
    cache: dict[tuple, tuple] = {}
    out = []
    for gi, g in enumerate(gold):
        best = None
        for sig, queue in queues.items():
            if not queue or (reach is not None and sig[0] not in reach.get(g["type"], (g["type"],))):
                continue
            ck = (g["quote"], tuple(g["entities"]), sig)
            if ck not in cache:
                p = sample[sig]
                gv, pv = vectors.get(g["quote"]), vectors.get(p["quote"])
                sem = 0.0 if gv is None or pv is None else float(np.dot(gv, pv))
                ge, pe = set(g["entities"]), set(p["entities"])
                ent = len(ge & pe) / len(ge | pe) if ge and pe else 0.0
                gt = set(g["tokens"])
                cr = len(gt & set(p["tokens"])) / len(gt) if gt else 0.0
                cache[ck] = (sem, ent, cr)
            sem, ent, cr = cache[ck]
            if (gate is not None and cr < gate) or (min_sim is not None and sem < min_sim):
                continue
            head = queue[-1] if prefer_last else queue[0]
            rank = (sem, ent if use_entities else 0.0, head if prefer_last else -head)
            if best is None or rank > best[0]:
                best = (rank, sig, head, sem, ent, cr)
        if best is None:
            continue
        _, sig, head, sem, ent, cr = best
        queues[sig].pop() if prefer_last else queues[sig].popleft()
        out.append((gi + 1, head + 1, sem, ent, cr))
    return out


def _reach(strategy: str, table) -> dict | None:
    if strategy == "embedding":
        return None
    if strategy == "exact":
        return {}
    return {g: set(ps) | {g} for g, ps in table.items()}


def assign(
    arrays: DataFrame,
    strategy: str = "exact",
    table=L.MATCHER_SYNONYMS,
    gate: float | None = None,
    min_sim: float | None = None,
    by_entities: bool = True,
    prefer_last: bool = False,
) -> DataFrame:
    """Add ``pairs``: greedy 1:1 assignment in gold order.

    ``strategy`` is ``exact``, ``fuzzy`` (through ``table``) or ``embedding`` (type ignored,
    cosine at least ``min_sim``).  The matcher ranks by (cosine, entity Jaccard) and the
    earliest flag wins ties; the strategy comparison ranks by cosine and the latest wins.
    """
    reach = _reach(strategy, table)

    # findings become objects of Python, so only a few episodes at a time do
    @F.arrow_udf(PAIR)
    def run(gold: pa.Array, pred: pa.Array, vectors: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(gold), EPISODES):
            few = (x.slice(at, EPISODES).to_pylist() for x in (gold, pred, vectors))
            for g, p, vs in zip(*few):
                known = {v["quote"]: np.array(v["vector"]) for v in vs or [] if v["vector"] is not None}
                pairs = _greedy(g or [], p or [], known, reach, gate, min_sim, by_entities, prefer_last)
                found.append([dict(zip(PAIR_FIELDS, x)) for x in pairs])
        return pa.array(found, PAIR_ARROW)

    return arrays.withColumn("pairs", run("gold", "pred", "vectors"))


# ------------------------------------------------------------------ containment
def _step(n):
    return max(n // 2, 200)


def _fuzzy_tail(quote: str, tail: str, ratio: float) -> bool:
    """Sequence similarity of a quote with the windows of a tail, see ``tail_of``.

    Two bounds come before the matcher: by lengths, and by the characters both hold.
    """
    n, have = len(quote), Counter(quote)
    for i in range(0, len(tail), _step(n)):
        window = tail[i : i + 2 * n]
        whole = n + len(window)
        if 2 * min(n, len(window)) / whole < ratio:
            continue
        if 2 * sum((have & Counter(window)).values()) / whole < ratio:
            continue
        if difflib.SequenceMatcher(None, quote, window).ratio() >= ratio:
            return True
    return False


def tail_of(doc_norm: Column, quote_norm: Column) -> Column:
    """The part of a document in which a quote can pass the sequence test.

    The ratio is 2M/(|q|+|w|) with M <= |q|, so a full window of 2|q| characters stays at or
    below 2/3 and cannot pass: only windows cut short by the end of the text are left, the first
    of which begins at the first multiple of the step in the last 2|q| characters.
    """
    n, size = F.length(quote_norm), F.length(doc_norm)
    step = F.greatest(F.floor(n / 2), F.lit(200))
    start = F.ceil(F.greatest(size - 2 * n, F.lit(0)) / step) * step
    return F.substring(doc_norm, (start + 1).cast("int"), (2 * n).cast("int"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _fuzzy_each(pairs: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [bool(p) and _fuzzy_tail(p["q"], p["tail"], L.FUZZY_QUOTE_RATIO) for p in ps] if ps is not None else []
            for ps in pairs
        ],
        dtype=object,
    )


def contained_each(df: DataFrame, doc_norm: str, quotes: str, out: str) -> DataFrame:
    """Add ``out``: citation containment of each of a document's quotes (both normalised).

    The exact test is native. Quotes that it leaves open go to Python with the tail of the
    document they can match, never with the whole text.
    """

    def over(body) -> Column:
        # as the argument of a lambda the text is evaluated once a row
        return F.when(
            F.col(quotes).isNotNull() & (F.size(quotes) > 0),
            F.get(F.transform(F.array(F.coalesce(F.col(doc_norm), F.lit(""))), body), F.lit(0)),
        )

    exact = over(lambda d: F.transform(quotes, lambda q: (F.length(q) > 0) & F.contains(d, q)))
    open_ = over(
        lambda d: F.zip_with(
            quotes,
            "_exact",
            lambda q, hit: F.when(
                ~hit & (F.length(q) >= L.FUZZY_QUOTE_MIN_CHARS) & (F.length(d) > 0),
                F.struct(q.alias("q"), tail_of(d, q).alias("tail")),
            ),
        )
    )
    staged = df.withColumn("_exact", exact).withColumn("_open", open_)
    some = F.exists("_open", lambda x: x.isNotNull())
    staged = staged.withColumn("_fuzzy", _fuzzy_each(F.when(some, F.col("_open"))))
    hit = F.zip_with("_exact", "_fuzzy", lambda a, b: a | F.coalesce(b, F.lit(False)))
    none = F.array().cast("array<boolean>")
    return staged.withColumn(out, F.coalesce(hit, none)).drop("_exact", "_open", "_fuzzy")


def contained(df: DataFrame, doc_norm: str, quote: str, out: str) -> DataFrame:
    """Add the boolean ``out``: exact substring first, fuzzy windows for the rest.

    The document column ends here.
    """
    q = X.normalize_text(F.coalesce(F.col(quote), F.lit("")), compat=True)
    staged = contained_each(df.withColumn("_q", F.array(q)), doc_norm, "_q", "_hits")
    return staged.withColumn(out, F.get("_hits", F.lit(0))).drop(doc_norm, "_q", "_hits")
