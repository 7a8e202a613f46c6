"""Secret scan: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Fixed patterns give the base spans (assign, access, hex). The method adds spans of kind
``random``: runs of at least ``LEAST`` token characters that look drawn at random. For each run
the encoding is inferred from its characters; over that alphabet three statistics are taken:
chi-squared against uniform use, runs above and below the middle of the alphabet, and the serial
correlation of neighbours. A run is kept out when the three together (Fisher) reject randomness.
Its p-value is that of a chi-squared as low as its own in ordinary text of the same length, in
which some characters are far more common than others; longer runs thus reach lower p-values,
and they carry more weight. Over all runs of all documents the false-discovery rate is held by
the step-up rule on weighted p-values (counted in bins of a twentieth of a decade, rounded
upwards), so the threshold comes from at most ``BINS`` counts.

Nulls and odd input: a null text counts as empty and has no spans; spans are code points, end
exclusive; a table without runs has no random spans; repeated rows are ordinary rows; an empty
table gives an empty result. Every text is scanned whole, and no text leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.llm.words import column


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (
    "(" + "|".join(map(_either_case, KEYWORDS)) + ")"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Base kinds with their patterns; a run of these classes is always matched whole.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run, and the least number of them.
LEAST = 20
RUN = "[A-Za-z0-9+/_-]{20,}"
#: False-discovery rate, least combined p-value of the battery, most weight in characters.
RATE, GATE, MOST_WEIGHT = 0.05, 0.001, 64
BINS = 400

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order they are tried: characters, pattern, and the chance that two
#: characters of ordinary text in that alphabet are equal.
ENCODINGS = (
    (DIGITS, "^[0-9]+$", 0.20),
    (DIGITS + "abcdef", "^[0-9a-f]+$", 0.12),
    (DIGITS + "ABCDEF", "^[0-9A-F]+$", 0.12),
    (LOWER, "^[a-z]+$", 0.0655),
    (UPPER, "^[A-Z]+$", 0.0655),
    (UPPER + DIGITS, "^[A-Z0-9]+$", 0.065),
    (LOWER + DIGITS, "^[a-z0-9]+$", 0.065),
    (UPPER + LOWER + DIGITS + "+/_-", "^.*$", 0.06),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches, in code points."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    steps = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(
            F.char_length(gap).cast("long").alias("gap"), F.char_length(found).cast("long").alias("size")
        ),
    )
    start = F.struct(empty.alias("spans"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        span = F.struct(begin.alias("start"), (begin + s["size"]).alias("end"))
        return F.struct(F.concat(acc["spans"], F.array(span)).alias("spans"), (begin + s["size"]).alias("at"))

    inner = F.filter(steps, lambda s: s["size"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(inner, start, step, lambda acc: acc["spans"])).otherwise(empty)


def assignments(text: Column) -> Column:
    """Spans of assignments whose value has ``ASSIGN_LEAST`` characters or more."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    both = F.zip_with(
        matches(text, ASSIGN), values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), v.alias("v"))
    )
    kept = F.filter(both, lambda x: F.char_length(x["v"]) >= ASSIGN_LEAST)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(text.rlike(ASSIGN), spans).otherwise(empty)


def normal_below(z: Column) -> Column:
    """Standard normal distribution function (rational approximation, error below 1e-7)."""

    def tail(z: Column) -> Column:
        def poly(t: Column) -> Column:
            # Coefficients of the approximation.
            inner = -0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))
            return 0.3989422804014327 * F.exp(-z * z / 2) * t * (0.319381530 + t * inner)

        return let(1 / (1 + 0.2316419 * F.abs(z)), lambda t: F.when(z < 0, poly(t)).otherwise(1 - poly(t)))

    return let(z, tail)


def chi_above(x: Column, freedom: Column | float) -> Column:
    """P(chi-squared > x), by the cube-root normal approximation."""
    k = F.lit(freedom) if isinstance(freedom, (int, float)) else freedom
    spread = F.lit(2.0) / (9 * k)
    return normal_below(-(F.pow(x / k, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))


def battery(run: Column) -> Column:
    """struct<n, p>: length and p-value of one run under ordinary text (1 where not random)."""
    kind = F.lit(len(ENCODINGS) - 1)
    for i in reversed(range(len(ENCODINGS) - 1)):
        kind = F.when(run.rlike(ENCODINGS[i][1]), F.lit(i)).otherwise(kind)

    def pick(i: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)

    def of_values(v: Column, i: Column) -> Column:
        n = F.size(v).cast("double")
        a = pick(i, [float(len(e[0])) for e in ENCODINGS])
        squares = F.aggregate(
            F.array_distinct(v),
            F.lit(0.0),
            lambda acc, d: acc + F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0)),
        )
        chi = a * squares / n - n
        total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        high = F.size(F.filter(v, lambda x: x >= a / 2)).cast("double")
        changes = F.size(F.filter(pairs, lambda p: (p["x"] >= a / 2) != (p["y"] >= a / 2))).cast("double")

        def scored(s: Column) -> Column:
            # s: n, a, chi, mean, high, runs, ordinary
            n, a, mean = s["n"], s["a"], s["mean"]
            expected = 2 * s["high"] * (n - s["high"]) / n + 1
            variance = (expected - 1) * (expected - 2) / (n - 1)
            z_runs = F.when(variance > 0, (s["runs"] - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
            around = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
            beside = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["x"] - mean) * (p["y"] - mean))
            z_serial = F.when(around > 0, (beside / around + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))

            def log_p(p: Column) -> Column:
                return F.ln(F.greatest(p, F.lit(1e-300)))

            fisher = -2 * (
                log_p(chi_above(s["chi"], a - 1))
                + log_p(2 * normal_below(-F.abs(z_runs)))
                + log_p(2 * normal_below(-F.abs(z_serial)))
            )
            surplus = n * (a * s["ordinary"] - 1)
            z = (s["chi"] - (a - 1) - surplus) / F.sqrt(2 * (a - 1) + 4 * surplus)
            p = F.when(chi_above(fisher, 6.0) >= GATE, normal_below(z)).otherwise(F.lit(1.0))
            return F.struct(n.cast("long").alias("n"), p.alias("p"))

        return let(
            F.struct(
                n.alias("n"), a.alias("a"), chi.alias("chi"), (total / n).alias("mean"),
                high.alias("high"), (changes + 1).alias("runs"),
                pick(i, [e[2] for e in ENCODINGS]).alias("ordinary"),
            ),
            scored,
        )

    def of_kind(i: Column) -> Column:
        alphabet = pick(i, [e[0] for e in ENCODINGS])
        values = F.transform(F.split(run, "", -1), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        return let(F.filter(values, lambda x: x >= 0), lambda v: of_values(v, i))

    return let(kind, of_kind)


def runs(text: Column) -> Column:
    """array<struct<start,end,n,p>> of the runs of token characters with their p-values."""
    scored = F.zip_with(
        matches(text, RUN),
        F.regexp_extract_all(text, F.lit(RUN), F.lit(0)),
        lambda m, r: let(
            battery(r),
            lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), b["n"].alias("n"), b["p"].alias("p")),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,n:bigint,p:double>>")
    return F.when(text.rlike(RUN), scored).otherwise(empty)


def weight(n: Column) -> Column:
    return F.least(n, F.lit(MOST_WEIGHT)).cast("double")


def bin_of(p: Column, n: Column, mean_weight: float) -> Column:
    """Twentieths of a decade of the weighted p-value, rounded so that p is never understated."""
    q = F.greatest(p * mean_weight / weight(n), F.lit(1e-20))
    return F.least(F.floor(-20 * F.log10(q)), F.lit(BINS)).cast("int")


def threshold(scored: DataFrame, rate: float) -> tuple[float, int]:
    """(mean weight, least bin discovered) over the rows (n, p) of all runs."""
    total, mean = scored.agg(F.count(F.lit(1)), F.avg(weight(F.col("n")))).first()
    if not total:
        return 1.0, BINS + 1
    counts = scored.groupBy(bin_of(F.col("p"), F.col("n"), mean).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    best, found = BINS + 1, 0
    for row in counts.orderBy(F.desc("bin")).collect():  # BINS rows or so
        found += row.c
        if 10 ** (-row.bin / 20) * total <= rate * found:
            best = row.bin
    return mean, best


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.array_join(texts, ",")


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """All rows with assign, access, hex, random (arrays of start, end), base and spans string.

    ``base`` and ``spans`` list the base spans and all spans as kind:start:end. The false-
    discovery rate of the random spans, over all rows, is held at ``rate``.
    """
    added = {*KINDS, "base", "spans"}
    kept = [c for c in docs.columns if c not in added]
    packed = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("body"),
    )
    body = F.col("body")
    scored = packed.where(body.rlike(RUN)).select(F.inline(runs(body))).select("n", "p")
    mean, least = threshold(scored, rate)
    found = packed.select(
        "row",
        assignments(body).alias("assign"),
        matches(body, ACCESS).alias("access"),
        matches(body, HEX).alias("hex"),
        F.filter(runs(body), lambda r: bin_of(r["p"], r["n"], mean) >= least).alias("random"),
    )
    base = F.concat(*[_tagged(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    every = F.concat(*[_tagged(F.col(k), i) for i, k in enumerate(KINDS)])
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept],
        *[F.col(k) for k in KINDS[:3]],
        F.transform("random", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("random"),
        _listed(base).alias("base"),
        _listed(every).alias("spans"),
    )
