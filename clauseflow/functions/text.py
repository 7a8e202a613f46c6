"""Native text expressions: normalisation, tokens, entities, quotes, lexicon counts.

Everything here is a Column built from Spark functions, so it runs inside the JVM
and can be pushed next to the scan.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from clauseflow.lexicon import FlagPattern, LexiconPack, java_ci, java_unicode

CASE_FREE = {
    "brand_marker", "equivalent", "units", "ranges", "standards", "restrictive",
    "spec_marker", "restrictive_word", "characteristic_word", "rule_equivalent",
    "section_words",
}
TOKEN = r"[\p{L}\p{N}_]+"


def native(pack: LexiconPack, name: str) -> str:
    """Java pattern of a pack field (neutral patterns carry their own flags)."""
    pattern = getattr(pack, name)
    if pack.name == "neutral":
        return pattern
    return java_ci(pattern) if name in CASE_FREE else java_unicode(pattern)


@lru_cache(maxsize=1)
def compat_pattern() -> str:
    """Words with a character that NFKC changes, joins to the one before, or puts in order.

    The characters follow from the Unicode data of the running Python: those with another form,
    those with a combining class, and those that end a composed pair. Words begin behind white
    space, which takes no part in compositions, so a word can be normalised by itself.
    """
    marked = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for cp in range(0xA0, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0xAC00 <= cp < 0xD7A4:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch) or unicodedata.normalize("NFKC", ch) != ch:
            marked.add(cp)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and "<" not in parts[0]:
            marked.add(int(parts[1], 16))

    def ranges(cps: list[int]) -> str:
        out, first = [], None
        for i, cp in enumerate(cps):
            first = cp if first is None else first
            if i + 1 == len(cps) or cps[i + 1] != cp + 1:
                out.append(f"\\x{{{first:X}}}-\\x{{{cp:X}}}")
                first = None
        return "".join(out)

    known = sorted(cp for cp in marked if cp > 0x7F)
    low, high = [c for c in known if c < 0x100], [c for c in known if c >= 0x100]
    # most texts are decided by the two small classes; the long one is asked beyond Latin-1 only
    one = f"(?:[{ranges(low)}]|(?=[^\\x00-\\xFF])[{ranges(high)}])"
    return rf"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r]*?{one}[^ \t\n\x0B\f\r]*"


def _nfkc_words(words: pd.Series) -> pd.Series:
    return words.map(
        lambda ws: None if ws is None else [unicodedata.normalize("NFKC", w) for w in ws]
    )


def compat_text(c: Column) -> Column:
    """NFKC of a text; only the words that it changes leave the JVM."""
    pattern = compat_pattern()
    some = F.rlike(c, F.lit(pattern))
    # marked so that the optimizer leaves the call where it is and never repeats it in a lambda
    fix = F.pandas_udf(_nfkc_words, T.ArrayType(T.StringType())).asNondeterministic()
    words = fix(
        F.when(some, F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    )
    pieces = F.zip_with(
        F.split(c, pattern, -1), words, lambda gap, word: F.array(gap, F.coalesce(word, F.lit("")))
    )
    return F.when(some, F.array_join(F.flatten(pieces), "")).otherwise(c)


# white space of all scripts, spelled out because ``(?U)\\s`` is several times slower
_BREAKS = r"\t\n\x0B\f\r\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_RUN = f"[{_BREAKS}][ {_BREAKS}]*| [ {_BREAKS}]+"


def collapse_spaces(c: Column) -> Column:
    """Every run of white space becomes one space; single spaces are not touched."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def normalize_text(c: Column, compat: bool = False) -> Column:
    """Lower-cased text with single spaces, after NFKC where ``compat`` asks for it."""
    base = compat_text(c) if compat else c
    return collapse_spaces(F.lower(base))


def normalize_each(texts: Column) -> Column:
    """``normalize_text`` with NFKC of each of a row's short texts, in one pass over all of them.

    NFKC leaves line feeds alone and joins nothing across them, so the texts are joined by them
    and taken apart again; a line feed inside a text is white space in any case.
    """
    lines = F.array_join(F.transform(texts, lambda x: F.translate(F.coalesce(x, F.lit("")), "\n", " ")), "\n")
    split = F.when(F.size(texts) > 0, F.split(compat_text(lines), "\n", -1)).otherwise(F.array().cast("array<string>"))
    return F.transform(split, lambda x: collapse_spaces(F.lower(x)))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def holds_none(text: Column, p: FlagPattern) -> Column | None:
    """The cheap test of a pattern says that the text has no match; null without such a test."""
    if p.literal:
        return ~F.contains(text, F.lit(p.literal))
    return ~F.rlike(text, F.lit(p.probe)) if p.probe else None


def pattern_matches(text: Column, p: FlagPattern) -> Column:
    """Group 1 of every match of a flag pattern."""
    found, none = all_matches(text, p.pattern, 1), holds_none(text, p)
    return found if none is None else F.when(none, F.array().cast("array<string>")).otherwise(found)


def pattern_count(text: Column, p: FlagPattern) -> Column:
    """Number of matches of a flag pattern."""
    found, none = F.regexp_count(text, F.lit(p.pattern)), holds_none(text, p)
    return found if none is None else F.when(none, F.lit(0)).otherwise(found)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column) -> Column:
    """Distinct lower-cased word tokens."""
    return F.array_distinct(all_matches(F.lower(F.coalesce(c, F.lit(""))), TOKEN))


def token_containment(gold: Column, pred: Column) -> Column:
    """Share of the gold quote's tokens found in the other quote; empty gold gives 0."""
    g, p = tokens(gold), tokens(pred)
    return F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(g, p)) / F.size(g)
    )


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets held as arrays; an empty side gives 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def entities(c: Column, pack: LexiconPack) -> Column:
    """Typed entity set: quoted names, standards, catalogue codes, codes with a digit."""
    t = F.coalesce(c, F.lit(""))
    quoted = F.filter(
        F.transform(
            all_matches(t, native(pack, "entity_quoted"), 1), lambda x: F.lower(F.trim(x))
        ),
        lambda x: F.length(x).between(2, 60),
    )
    standards = F.transform(
        all_matches(t, native(pack, "entity_standard")),
        lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", "")),
    )
    codes = all_matches(t, native(pack, "entity_catalogue"))
    latin = F.transform(
        F.filter(all_matches(t, native(pack, "entity_latin")), lambda x: x.rlike("[0-9]")),
        F.lower,
    )

    def tag(name: str, arr: Column) -> Column:
        return F.transform(arr, lambda x: F.concat(F.lit(name + ":"), x))

    return F.array_distinct(
        F.concat(tag("q", quoted), tag("gost", standards), tag("ktru", codes), tag("lat", latin))
    )


def quote_around(text: Column, pos: Column, before: int = 30, after: int = 70) -> Column:
    """Evidence quote around a 0-based position."""
    start = F.greatest(F.lit(0), pos - before)
    return F.trim(F.translate(F.substring(text, start + 1, pos + after - start), "\n", " "))


def guarded_at(text: Column, pos: Column, pattern: str, radius: int = 200) -> Column:
    """An equivalence phrase lies within ``radius`` characters of a 0-based position."""
    start = F.greatest(F.lit(0), pos - radius)
    return F.substring(text, start + 1, pos + radius - start).rlike(pattern)


def window_has(
    text: Column, start: Column, end: Column, pattern: str, radius: int
) -> Column:
    """A pattern occurs in the span widened by ``radius`` on both sides (0-based, half-open)."""
    lo = F.greatest(F.lit(0), start - radius)
    return F.substring(text, lo + 1, end + radius - lo).rlike(pattern)


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _snippet(t: Column, size: Column, quote: Column, context: int) -> Column:
    def cut(found: Column) -> Column:
        q, pos = found["q"], found["pos"]
        start = F.greatest(F.lit(1), pos - context)
        stop = F.least(size, pos + F.length(q) - 1 + context)
        body = F.concat(
            F.when(start > 1, F.lit("…")).otherwise(F.lit("")),
            F.trim(F.substring(t, start, stop - start + 1)),
            F.when(stop < size, F.lit("…")).otherwise(F.lit("")),
        )
        return F.when((pos > 0) & (F.length(q) > 0), body).otherwise(quote)

    return _once(
        normalize_text(quote), lambda q: _once(F.struct(q.alias("q"), F.instr(t, q).alias("pos")), cut)
    )


def context_snippets(text: Column, quotes: Column, context: int = 200) -> Column:
    """:func:`context_snippet` of each of a text's quotes; the text is normalised once."""
    return _once(
        normalize_text(text),
        lambda t: _once(F.length(t), lambda n: F.transform(quotes, lambda q: _snippet(t, n, q, context))),
    )


def context_snippet(text: Column, quote: Column, context: int = 200) -> Column:
    """Quote with its surroundings in normalised text; the quote itself when absent."""
    return F.element_at(context_snippets(text, F.array(quote), context), 1)


def literal_quote_ok(text: Column, quote: Column) -> Column:
    """Whitespace- and case-insensitive quote check; quotes under 12 characters pass."""
    q = normalize_text(F.coalesce(quote, F.lit("")))
    return F.when(F.length(q) < 12, F.lit(True)).otherwise(
        F.contains(normalize_text(F.coalesce(text, F.lit(""))), q)
    )


def exact_containment(doc_norm: Column, quote: Column) -> Column:
    """Normalised quote is a substring; an empty quote or document never is."""
    q = normalize_text(F.coalesce(quote, F.lit("")), compat=True)
    d = F.coalesce(doc_norm, F.lit(""))
    return (F.length(q) > 0) & (F.length(d) > 0) & F.contains(d, q)


def lexicon_counts(text: Column, pack: LexiconPack) -> list[Column]:
    """Counts and flags of the lexicon pack over one text."""
    return [
        count_matches(text, native(pack, "equivalent")).alias("equivalent_count"),
        count_matches(text, native(pack, "units")).alias("units_count"),
        text.rlike(native(pack, "ranges")).alias("has_ranges"),
        count_matches(text, native(pack, "standards")).alias("standard_count"),
        text.rlike(native(pack, "catalogue")).alias("has_catalogue_code"),
        count_matches(text, native(pack, "restrictive")).alias("restrictive_count"),
    ]


def model_codes(text: Column, pack: LexiconPack) -> Column:
    """Latin model codes: 3+ characters, 2+ letters, no stop word, no Roman-numeral prefix."""
    stop = F.array(*[F.lit(s) for s in pack.stop_tokens])
    need_digit = "(?s).*" if pack.name == "neutral" else "[0-9]"
    return F.filter(
        # F.trim itself takes two arguments: transform would give it the index as what to strip
        F.transform(all_matches(text, native(pack, "model_code"), 1), lambda c: F.trim(c)),
        lambda c: (F.length(c) >= 3)
        & c.rlike(need_digit)
        & ~F.array_contains(stop, F.upper(c))
        & (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) >= 2)
        & ~c.rlike(r"^(?:I{1,3}|IV|V|VI{0,3}|IX|X)(?:$|[^\p{L}\p{N}_])"),
    )


def sigil_brands(text: Column, pack: LexiconPack) -> Column:
    """Word in front of a trademark sigil, punctuation stripped."""
    stop = F.array(*[F.lit(s) for s in pack.stop_tokens])
    raw = all_matches(text, r"([^ \n\t\r™®$]{2,40})[ ]?" + f"(?:{pack.sigil})", 1)
    return F.filter(
        F.transform(raw, lambda x: F.btrim(x, F.lit(",.;:()[]«»\""))),
        lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, F.upper(x)),
    )


def with_catalogue_codes(df: DataFrame, text: str, pack: LexiconPack, keep: int = 5) -> DataFrame:
    """Add ``long_codes`` and ``short_codes``: distinct long codes, and short codes that do
    not begin a long one, first five each.

    The long codes become a column first, so the test on each short code reads an array
    instead of running the pattern again.
    """
    staged = df.withColumn(
        "_long", F.array_distinct(all_matches(F.col(text), native(pack, "long_code"), 1))
    )
    short = F.filter(
        F.array_distinct(all_matches(F.col(text), native(pack, "short_code"), 1)),
        lambda s: ~F.exists("_long", lambda k: F.startswith(k, s)),
    )
    return (
        staged.withColumn("long_codes", F.slice("_long", 1, keep))
        .withColumn("short_codes", F.slice(short, 1, keep))
        .drop("_long")
    )


def incomplete_short(text: Column, pack: LexiconPack, limit: int = 2000) -> Column:
    """Short text without any specification marker."""
    return (F.length(text) < limit) & ~text.rlike(native(pack, "spec_marker"))


def restrictive_near_characteristic(text: Column, pack: LexiconPack, radius: int = 80) -> Column:
    """A restrictive word with a characteristic word within ``radius`` characters."""
    word, near = pack.restrictive_word, pack.characteristic_word
    flags = "(?is)" if pack.name == "neutral" else "(?isuU)"
    w, c = word.replace("(?i)", ""), near.replace("(?i)", "")
    gap = rf"[\s\S]{{0,{radius}}}"
    return text.rlike(f"{flags}{w}{gap}(?:{c})|(?:{c}){gap}{w}")


def pack_findings(text: Column, patterns, field: str = "flag_type") -> Column:
    """All findings of a pack as one array of structs, in (type, match) order.

    The array is built in the row that holds the text: no shuffle, no join.
    """

    def one(ord_: int, p) -> Column:
        return F.transform(
            pattern_matches(text, p),
            lambda q, i: F.struct(
                F.lit(ord_).alias("type_ord"),
                F.lit(p.finding_type).alias(field),
                (i + 1).alias("idx"),
                q.alias("quote"),
                F.round(F.lit(p.confidence) - F.lit(0.05) * (F.length(q) % 3), 2).alias(
                    "confidence"
                ),
            ),
        )

    return F.concat(*[one(i, p) for i, p in enumerate(patterns, start=1)])
