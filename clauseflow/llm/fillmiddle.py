"""Fill-in-middle transformation with content-defined chunk memoization.

Cuts fall between units: a run of white space with the word behind it, or the white space at the
end of a text. A unit that ends in a word ends where the word does, so a text is known by the
ends of its words. Texts are cut into chunks where a rolling hash of the last 32 bytes says so;
equal stretches of different documents thus fall into equal chunks. A chunk's summary (its code
points, the word ends inside it, whether it begins and ends inside a word) is computed once and
remembered under its content; the content itself is the key, so a summary never comes from
another chunk. A text's number of units is the sum of its chunks' counts plus the words that end
just at a seam. A cut is found in the running sums of the counts: only the chunk that holds it is
read again.

Nulls and odd input: a null text counts as empty; an empty text has no unit and the form
``plain``; a null id counts as an empty string in the draw, so all rows without id share theirs;
equal rows get equal results; a text of white space only is one unit; an empty table gives an
empty result. Columns of the input that are called like a new column are replaced, all others
stay. Texts are read whole, whatever their length: a task holds a few texts of one slice (1 MB,
or a single longer text) and at most ``REMEMBER`` bytes of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clauseflow.llm.words import WHITE, column

#: A cut needs this many low bits of the rolling hash to be zero: about one place in 512.
CUT_BITS = 9
#: A cut closer than ``LEAST`` bytes to the hash's cut before it does not count; longer stretches
#: without a cut are cut every ``MOST`` bytes.
LEAST, MOST = 64, 4096
#: Bytes of chunks that a task remembers.
REMEMBER = 8 << 20
#: Bytes of texts handled together.
SLICE = 1 << 20

PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text (at least one byte long); the last is the text's end."""
    n = len(data)
    rolling = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < n:
            rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint32(step))
    found = np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1
    found = found[np.diff(found, prepend=0) >= LEAST]
    ends = np.append(found[found < n], n)
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= MOST:
        return ends
    parts = -(-sizes // MOST)
    first = np.repeat(ends - sizes, parts)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
    return np.minimum(first + nth * MOST, np.repeat(ends, parts))


#: Fields of a summary: code points, word ends inside, begins inside a word, ends inside a word.
CHARS, ENDS, OPENS, CLOSES = range(4)


class Summaries:
    """Summaries of chunks by content; forgotten all at once when they grow too large."""

    def __init__(self, limit: int = REMEMBER):
        self.known: dict[bytes, tuple[int, int, int, int]] = {}
        self.limit, self.size, self.computed = limit, 0, 0

    def of(self, chunks: list[bytes]) -> np.ndarray:
        """(4, number of chunks), see the field names."""
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            size = sum(map(len, new))
            if self.size + size > self.limit:
                known.clear()
                self.size = 0
                new, size = list(dict.fromkeys(chunks)), sum(map(len, set(chunks)))
            self.size += size
            self.computed += len(new)
            known.update(zip(new, zip(*(f.tolist() for f in summarise(new)))))
        return np.array([known[c] for c in chunks], np.int64).T


def summarise(chunks: list[bytes]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(chunks), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    starts = np.concatenate(([0], ends[:-1]))
    white = WHITE[data]
    stop = np.zeros(len(data), np.int64)
    stop[:-1] = ~white[:-1] & white[1:]
    stop[ends - 1] = 0  # a word that ends at the chunk's end is counted at the seam
    points = ((data & 0xC0) != 0x80).astype(np.int64)
    return (
        np.add.reduceat(points, starts),
        np.add.reduceat(stop, starts),
        (~white[starts]).astype(np.int64),
        (~white[ends - 1]).astype(np.int64),
    )


class Units:
    """The units of one text of at least one byte."""

    def __init__(self, data: bytes, ends: np.ndarray, summary: np.ndarray):
        self.data, self.ends, self.summary = data, ends, summary
        seam = summary[CLOSES].copy()
        seam[:-1] &= 1 - summary[OPENS][1:]
        #: words that end in or just behind each chunk, summed
        self.upto = np.cumsum(summary[ENDS] + seam)
        self.chars = np.cumsum(summary[CHARS])
        self.words = int(self.upto[-1])
        self.n = self.words + (0 if summary[CLOSES][-1] else 1)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k == 0:
            return 0, 0
        if k > self.words or (k == self.n):
            return len(self.data), int(self.chars[-1])
        c = int(np.searchsorted(self.upto, k))
        start = int(self.ends[c - 1]) if c else 0
        nth = k - (int(self.upto[c - 1]) if c else 0)
        if nth > self.summary[ENDS][c]:  # the word that ends at the seam
            return int(self.ends[c]), int(self.chars[c])
        chunk = np.frombuffer(self.data, np.uint8, int(self.ends[c]) - start, start)
        white = WHITE[chunk]
        at = int(np.flatnonzero(~white[:-1] & white[1:])[nth - 1]) + 1
        before = int(self.chars[c - 1]) if c else 0
        return start + at, before + int(np.count_nonzero((chunk[:at] & 0xC0) != 0x80))


def units_of(texts: list[bytes], memo: Summaries) -> list[Units | None]:
    """The units of each text, None for an empty one."""
    ends = [chunk_ends(np.frombuffer(t, np.uint8)) if t else None for t in texts]
    chunks: list[bytes] = []
    for t, e in zip(texts, ends):
        if e is not None:
            stops = e.tolist()
            chunks += map(t.__getitem__, map(slice, [0, *stops], stops))
    summary = memo.of(chunks) if chunks else np.zeros((4, 0), np.int64)
    out, done = [], 0
    for t, e in zip(texts, ends):
        if e is None:
            out.append(None)
        else:
            out.append(Units(t, e, summary[:, done : done + len(e)]))
            done += len(e)
    return out


@dataclass(frozen=True)
class Plan:
    """Seed of the draw, shares in percent, and the marks before prefix, suffix and middle."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self):
        marks = self.marks
        # a mark can then be met neither across a seam nor inside another mark
        if any(len(m) < 2 or m[0] in other[1:] for m in marks for other in marks) or len(set(marks)) < 3:
            raise ValueError("marks must differ, and none may hold another's first character further on")


def _slices(column_: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column_), 0).to_numpy(zero_copy_only=False)
    lo = size = 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and size + s > limit:
            yield lo, i
            lo, size = i, 0
        size += s
    if lo < len(sizes):
        yield lo, len(sizes)


#: One table of summaries in a worker, so that it outlives a batch.
_memo = Summaries()

CUT = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,left:bigint,right:bigint>"


def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """Units of each text and its two cuts, in code points and in bytes."""
    h1, h2 = (h.to_numpy(zero_copy_only=False) for h in (one, two))
    rows = np.zeros((5, len(text)), np.int64)
    for lo, hi in _slices(text):
        texts = [t or b"" for t in text.slice(lo, hi - lo).to_pylist()]
        for i, u in enumerate(units_of(texts, _memo), lo):
            if u is not None:
                a, b = sorted((int(h1[i]) % (u.n + 1), int(h2[i]) % (u.n + 1)))
                left, at = u.cut(a)
                right, upto = u.cut(b)
                rows[:, i] = u.n, at, upto - at, left, right
    return pa.StructArray.from_arrays(
        [pa.array(r) for r in rows], ["n", "prefix_chars", "middle_chars", "left", "right"]
    )


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and key."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(whole.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()
) -> DataFrame:
    """All rows with n long, form, prefix_chars and middle_chars long, and output string.

    The lengths are null where the form is ``plain``; the output is then the text itself.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    body = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    drawn = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        body.cast("binary").alias("body"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(column(docs, id_col), plan.seed), 1)],
    )
    cut = drawn.select("row", "body", "h3", "h4", F.arrow_udf(_cuts, CUT)("body", "h1", "h2").alias("cut"))
    text = F.col("body").cast("string")
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in plan.marks])
    plain = (F.octet_length("body") == 0) | marked | (F.col("h3") % 100 >= plan.rate)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < plan.spm_rate, SPM).otherwise(PSM)

    def part(start, size) -> Column:
        return F.substring("body", (start + 1).cast("int"), size.cast("int")).cast("string")

    left, right = F.col("cut.left"), F.col("cut.right")
    prefix = F.concat(F.lit(plan.prefix), part(F.lit(0), left))
    middle = F.concat(F.lit(plan.middle), part(left, right - left))
    suffix = F.concat(F.lit(plan.suffix), part(right, F.octet_length("body") - right))
    return cut.withColumn("form", form).select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("cut.n").alias("n"),
        "form",
        *[F.when(F.col("form") != PLAIN, F.col("cut")[c]).alias(c) for c in ("prefix_chars", "middle_chars")],
        F.when(F.col("form") == PLAIN, text)
        .when(F.col("form") == PSM, F.concat(prefix, suffix, middle))
        .otherwise(F.concat(suffix, prefix, middle))
        .alias("output"),
    )


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The exact text behind an output: a mark is in it once, and only where it was put."""
    p, s, m = plan.marks
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(
        F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1)
    )
    spm = F.concat(
        F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1)
    )
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
