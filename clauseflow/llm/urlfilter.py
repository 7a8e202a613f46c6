"""URL filters: stated rules, and association rules mined from the URLs they label.

A stated rule (verdict, host, path) fits its host, all subdomains of it, and paths that begin
with its path; the longest that fits gives the verdict. The URLs with such a verdict are the
labelled ones. Their tokens (host labels, path segments, names of query parameters; runs of
digits count as one 0) go through Spark's FP-growth together with the verdict as one more item.
Frequent sets that hold a verdict become rules *tokens -> verdict*; those below the least support
or confidence go, and so do those that a rule with one token less makes needless. A URL without
a stated rule takes the verdict of the most confident mined rule whose tokens it all has (then
more support, fewer tokens, tokens in order), found by an inverted index from a rule's rarest
token to the rule; where no rule fires, the verdict that most labelled URLs have (``allow`` on a
tie or without labels).

Size: mining combines all frequent tokens of a URL, at most (mean number of tokens) / support
different ones. Tokens that cannot change a result are not combined (see ``mine``), so a long URL
costs something only where many of its tokens tell different things. Everything covers all
rows and all tokens. Only DataFrame functions and FP-growth are used.

Nulls and odd input: a null URL, or one without ``://``, has empty host and path, no token and
the verdict of the majority; equal URLs get equal verdicts; an empty table gives an empty result.
Columns of the input that are called like a new column are replaced, all others stay. URLs are
read whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.llm.words import column
from clauseflow.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)\??([^#]*)"
ADDED = ("host", "path", "rule", "verdict", "basis", "evidence")


@dataclass(frozen=True)
class Rule:
    """A stated rule; host in lower case, path with its slash."""

    verdict: str
    host: str
    path: str = "/"


@dataclass(frozen=True)
class Mining:
    """Least share of the labelled URLs that a rule must cover rightly, least confidence, and, where
    fewer than all tokens of a URL shall be combined with each other, their number."""

    support: float = 0.01
    confidence: float = 0.8
    items: int | None = None


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; empty without ``://``."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3)

    def each(text: Column, mark: str, kind: str) -> Column:
        found = F.filter(F.split(text, mark), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(kind), F.regexp_replace(x, "[0-9]+", "0")))

    names = F.regexp_replace(query, "=[^&]*", "")
    return F.array_distinct(
        F.concat(
            each(host_of(url), r"\.", "host="), each(path_of(url), "/", "path="), each(names, "&", "query=")
        )
    )


def stated(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(size, rule, verdict) of the longest rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    listed = F.array(
        *[
            F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.verdict).alias("verdict"))
            for r in rules
        ]
    )
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
        & F.startswith(path, r["path"]),
    )
    sized = F.transform(
        fits,
        lambda r: F.struct(
            F.char_length(F.concat(r["host"], r["path"])).alias("size"),
            F.concat(r["host"], r["path"]).alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    return F.array_max(sized)


def _verdict_item(x: Column) -> Column:
    return F.startswith(x, F.lit("verdict="))


def _most_telling(labelled: DataFrame, least: int, share: float, items: int) -> DataFrame:
    """(tokens, verdict) with the ``items`` frequent tokens whose verdicts are least like the average."""
    frequent = (
        labelled.select(F.explode("tokens").alias("token"), "verdict")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == ALLOW).alias("a"))
        .where(F.col("n") >= least)
        .select("token", F.abs(F.col("a") / F.col("n") - F.lit(share)).alias("told"))
    )
    # at most (mean number of tokens) / support entries
    known = frequent.agg(F.map_from_entries(F.collect_list(F.struct("token", "told"))).alias("known"))
    told = F.transform(
        F.filter("tokens", lambda t: F.map_contains_key("known", t)),
        lambda t: F.struct((-F.element_at("known", t)).alias("told"), t.alias("token")),
    )
    return labelled.select("tokens", "verdict", known.scalar().alias("known")).select(
        F.transform(F.slice(F.array_sort(told), 1, items), lambda t: t["token"]).alias("tokens"), "verdict"
    )


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Mined rules (tokens sorted array, verdict, n, of, confidence) from (tokens, verdict).

    ``n`` labelled URLs have the tokens and the verdict, ``of`` have the tokens. Rules of one token
    follow from counts. Only tokens that can stand in a longer rule that is not needless are
    combined: none whose URLs all have one verdict (its own rule is certain), none that all URLs
    have, and one for all tokens of the same URLs, which are put in its place afterwards.
    """
    labelled = cut_lineage(labelled.select("tokens", "verdict"))
    total, allowed = labelled.agg(F.count(F.lit(1)), F.count_if(F.col("verdict") == ALLOW)).first()
    empty = labelled.sparkSession.createDataFrame(
        [], "tokens array<string>, verdict string, n long, of long, confidence double"
    )
    if not total:
        return empty
    least = math.ceil(how.support * total)
    if how.items is not None:
        labelled = cut_lineage(_most_telling(labelled, least, allowed / total, how.items))
    row = F.monotonically_increasing_id()
    single = cut_lineage(
        labelled.select("tokens", "verdict", F.xxhash64(row).alias("x"), F.xxhash64(row, F.lit(1)).alias("y"))
        .select(F.explode("tokens").alias("token"), "verdict", "x", "y")
        .groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("of"), F.count_if(F.col("verdict") == ALLOW).alias("a"),
            F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"),
        )
        .where(F.col("of") >= least)
    )
    votes = F.array(
        F.struct(F.lit(ALLOW).alias("verdict"), F.col("a").alias("n")),
        F.struct(F.lit(BLOCK).alias("verdict"), (F.col("of") - F.col("a")).alias("n")),
    )
    alone = single.select(F.array("token").alias("tokens"), "of", F.inline(votes))
    mixed = (
        single.where((F.col("of") < total) & (F.col("a") > 0) & (F.col("a") < F.col("of")))
        .groupBy("of", "a", "x", "y")
        .agg(F.array_sort(F.collect_set("token")).alias("same"))
    )
    # at most (mean number of tokens) / support entries
    classes = cut_lineage(
        mixed.agg(
            F.map_from_entries(F.collect_list(F.struct(F.get("same", F.lit(0)).alias("token"), "same"))).alias("classes")
        )
    )
    baskets = labelled.select("tokens", "verdict", classes.scalar().alias("classes")).select(
        F.concat(
            F.filter("tokens", lambda t: F.map_contains_key("classes", t)),
            F.array(F.concat(F.lit("verdict="), "verdict")),
        ).alias("items")
    )
    sets = cut_lineage(
        FPGrowth(itemsCol="items", minSupport=how.support, minConfidence=how.confidence)
        .fit(baskets)
        .freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
    )
    split = sets.select(
        F.filter("items", lambda x: ~_verdict_item(x)).alias("tokens"),
        F.regexp_replace(F.get(F.filter("items", _verdict_item), F.lit(0)), "^verdict=", "").alias("verdict"),
        "freq",
    ).where(F.size("tokens") > 1)
    each_of_class = F.aggregate(
        "tokens",
        F.array(F.array().cast("array<string>")),
        lambda made, t: F.flatten(
            F.transform(made, lambda m: F.transform(F.element_at("classes", t), lambda s: F.array_append(m, s)))
        ),
    )
    together = (
        split.where("verdict is not null")
        .withColumnRenamed("freq", "n")
        .join(split.where("verdict is null").select("tokens", F.col("freq").alias("of")), "tokens")
        .where(F.col("n") / F.col("of") >= how.confidence)
        .select("*", classes.scalar().alias("classes"))
        .select(F.explode(each_of_class).alias("tokens"), "verdict", "n", "of")
        .select(F.array_sort("tokens").alias("tokens"), "of", "verdict", "n")
    )
    rules = (
        alone.unionByName(together)
        .withColumn("confidence", F.col("n") / F.col("of"))
        .where((F.col("confidence") >= how.confidence) & (F.col("n") >= max(least, 1)))
    )
    rules = cut_lineage(rules)
    less = F.transform(
        F.sequence(F.lit(1), F.size("tokens")),
        lambda i: F.filter("tokens", lambda t, at: at != i - 1),
    )
    needless = (
        rules.where(F.size("tokens") > 1)
        .select("tokens", "verdict", "confidence", F.explode(less).alias("fewer"))
        .join(rules.select(F.col("tokens").alias("fewer"), "verdict", F.col("confidence").alias("c")), ["fewer", "verdict"])
        .where("c >= confidence")
        .select("tokens", "verdict")
    )
    return rules.join(needless, ["tokens", "verdict"], "left_anti").select(*empty.columns)


def inverted_index(rules: DataFrame) -> DataFrame:
    """One row: map from the rarest token of the rules' tokens to the rules that it leads to."""
    keyed = rules.select(F.explode("tokens").alias("token"), "tokens", "verdict", "n", "of", "confidence")
    spread = keyed.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    led = (
        keyed.join(spread, "token")
        .groupBy("tokens", "verdict", "n", "of", "confidence")
        .agg(F.min_by("token", F.struct("uses", "token")).alias("token"))
        .select(
            "token",
            F.struct(
                (-F.col("confidence")).alias("lack"),
                (-F.col("n")).alias("less"),
                F.size("tokens").alias("size"),
                F.array_join("tokens", " ").alias("evidence"),
                "verdict",
                "tokens",
            ).alias("rule"),
        )
        .groupBy("token")
        .agg(F.collect_list("rule").alias("rules"))
    )
    return led.agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index"))


def judge(
    pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", how: Mining = Mining()
) -> DataFrame:
    """All rows with host, path, rule (host and path of the stated rule, else null), verdict,
    basis (``rule``, ``mined`` or ``default``) and evidence (tokens of the mined rule, else null)."""
    kept = [c for c in pages.columns if c not in ADDED]
    url = column(pages, url_col).cast("string")
    read = pages.select(
        F.struct(*[column(pages, c) for c in kept]).alias("row"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        tokens_of(url).alias("tokens"),
    ).withColumn("stated", stated(F.col("host"), F.col("path"), rules))
    labelled = read.where("stated is not null").select("tokens", F.col("stated.verdict").alias("verdict"))
    mined = cut_lineage(mine(labelled, how))
    usual = labelled.agg(
        F.when(F.count_if(F.col("verdict") == BLOCK) > F.count_if(F.col("verdict") == ALLOW), BLOCK)
        .otherwise(ALLOW).alias("usual")
    )
    met = read.select(
        "*", inverted_index(mined).scalar().alias("index"), usual.scalar().alias("usual")
    ).withColumn(
        "fired",
        F.array_min(
            F.filter(
                F.flatten(
                    F.transform(
                        F.filter("tokens", lambda t: F.map_contains_key("index", t)),
                        lambda t: F.element_at("index", t),
                    )
                ),
                lambda r: F.size(F.array_except(r["tokens"], "tokens")) == 0,
            )
        ),
    )
    return met.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "host",
        "path",
        F.col("stated.rule").alias("rule"),
        F.coalesce("stated.verdict", "fired.verdict", "usual").alias("verdict"),
        F.when(F.col("stated").isNotNull(), "rule").when(F.col("fired").isNotNull(), "mined")
        .otherwise("default").alias("basis"),
        F.when(F.col("stated").isNull(), F.col("fired.evidence")).alias("evidence"),
    )
