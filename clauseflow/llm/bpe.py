"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token contains can never end up inside one
token, so a cut between the two is certain. Every pre-token is cut at all such pairs; the
fragments are merged independently and their ids concatenated. Fragments of pre-tokens repeat
a great deal, so each task keeps a bounded table of those it has merged.

Nulls and odd input: a null text counts as empty and gives no ids; null ids decode to an empty
text; bytes that are not UTF-8 after decoding become replacement characters; an empty table
gives an empty result. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Units of each of the two ages a task remembers; a unit longer than ``LONG`` is not kept.
MAX_UNITS, LONG = 30_000, 200
#: Rows of a batch that are Python objects at once, and characters encoded together.
ROWS, GROUP = 256, 1 << 18
#: Fragments longer than this are merged one by one with a heap.
SCAN = 256

# Fixed value: the pre-token pattern of byte-level BPE. White space is the Unicode property.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+"
    r"| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})"
    r"|\p{White_Space}+"
)
#: A space with white space or nothing behind it.
ODD_SPACE = re.compile(r" (?=\s|\Z)")
CUT_SPACE = re.compile(r" (?=\S)")
#: ASCII marks that are a pre-token of their own behind letters.
MARKS = frozenset(".,;:!?")
NO_PAIR = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file: token bytes, merge ranks, certain cuts, specials."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        alphabet = byte_alphabet()
        ids = model["vocab"]
        tokens = {i: bytes(map(alphabet.__getitem__, t)) for t, i in ids.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = ids[char]
        self.merges: dict[tuple[int, int], int] = {}
        merged = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[left], ids[right]] = rank
            merged.append(ids[left + right])
        self.merged = np.array(merged, np.int32)
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(self.merges.values(), np.int32, len(keys))[order]
        every = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_ranks = self.ranks(*every).reshape(256, 256)
        certain = np.ones((256, 256), bool)
        for token in tokens.values():
            b = np.frombuffer(token, np.uint8)
            certain[b[:-1], b[1:]] = False
        self.certain = certain
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.specials = (
            re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        )
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.token_sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NO_PAIR where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def merge_all(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece) of pieces of bytes that end at ``ends``.

        The pieces are cut at every pair of bytes that no token contains, and all fragments are
        merged side by side: in each round every fragment merges its pair of lowest rank, the
        leftmost first, until it has none.
        """
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        last[:-1] |= self.certain[data[:-1], data[1:]]
        stops = np.flatnonzero(last) + 1
        sizes = np.diff(stops, prepend=0)
        done_ids: list[np.ndarray] = []
        done_frag: list[np.ndarray] = []
        tok = self.byte_ids[data]
        frag = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        long = np.flatnonzero(sizes > SCAN)
        for f in long:
            ids = self._merge_long(tok[stops[f] - sizes[f] : stops[f]].tolist())
            done_ids.append(np.array(ids, np.int32))
            done_frag.append(np.full(len(ids), f, np.int32))
        rank = np.full(len(tok), NO_PAIR, np.int32)
        rank[:-1] = np.where(last[:-1], NO_PAIR, self.byte_ranks[data[:-1], data[1:]])
        if len(long):
            short = (sizes <= SCAN)[frag]
            tok, frag, rank = tok[short], frag[short], rank[short]
        while len(tok):
            heads = np.flatnonzero(np.diff(frag, prepend=np.int32(-1)))
            least = np.minimum.reduceat(rank, heads)
            count = np.diff(np.append(heads, len(tok)))
            over = least == NO_PAIR
            if over.any():
                gone = np.repeat(over, count)
                done_ids.append(tok[gone])
                done_frag.append(frag[gone])
                tok, frag, rank = tok[~gone], frag[~gone], rank[~gone]
                least, count = least[~over], count[~over]
                if not len(tok):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            at = hit[np.diff(frag[hit], prepend=np.int32(-1)) != 0]
            tok[at] = self.merged[rank[at]]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            tok, frag, rank = tok[keep], frag[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = NO_PAIR
            for i in (at[at + 1 < len(tok)], at[at > 0] - 1):
                i = i[frag[i] == frag[i + 1]]
                rank[i] = self.ranks(tok[i], tok[i + 1])
        ids = np.concatenate(done_ids) if done_ids else tok
        of = np.concatenate(done_frag) if done_frag else frag
        ids = ids[np.argsort(of, kind="stable")]
        piece = np.searchsorted(ends, stops)  # piece of each fragment
        return ids, np.bincount(piece[of], minlength=len(ends))

    def _merge_long(self, parts: list[int]) -> list[int]:
        merges, merged, n = self.merges, self.merged, len(parts)
        right = list(range(1, n)) + [-1]
        left = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = merges.get((parts[i], parts[i + 1]))
            if rank is not None:
                heap.append((rank, i, parts[i], parts[i + 1]))
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = int(merged[rank]), -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0:
                    rank = merges.get((parts[x], parts[y]))
                    if rank is not None:
                        heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class _Units(dict):
    """Unit of text, as it stands after ``lead``, to its ids (little-endian, 32 bits).

    A full table becomes the old one; what is met again there comes back, the rest goes with it.
    """

    def __init__(self, vocabulary: Vocabulary, lead: str):
        self.vocabulary, self.lead = vocabulary, lead
        self.old: dict[str, bytes] = {}

    def learn(self, units: set[str]) -> list[str]:
        """Encode the units not yet known; returns those to be forgotten after use."""
        new = units.difference(self)
        if len(self) + len(new) > MAX_UNITS:
            self.old = dict(self)
            self.clear()
            new = units
        again = new & self.old.keys()
        if again:
            self.update(zip(again, map(self.old.__getitem__, again)))
            new = new - again
        # a unit of letters is one pre-token; letters and one mark are two
        plain = [u for u in new if u.isalpha()]
        rest = [u for u in new if not u.isalpha()]
        marked = [u for u in rest if u[-1:] in MARKS and u[:-1].isalpha()]
        others = [u for u in rest if not (u[-1:] in MARKS and u[:-1].isalpha())]
        lead, pieces, counts = self.lead, [], []
        for u in others:
            found = PRETOKEN.findall(lead + u)
            pieces += found
            counts.append(len(found))
        sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + len(lead)
        two = np.fromiter(map(len, marked), np.int64, len(marked)) + len(lead) - 1
        two = np.stack([two, np.ones_like(two)], axis=1).ravel()
        sizes = np.concatenate([sizes, two, np.fromiter(map(len, pieces), np.int64, len(pieces))])
        text = "".join([lead + lead.join(plain)] * bool(plain) + [lead + lead.join(marked)] * bool(marked) + pieces)
        each_unit = np.array([1] * len(plain) + [2] * len(marked) + counts, np.int64)
        known = plain + marked + others
        if len(sizes):
            data = np.frombuffer(text.encode(), np.uint8)
            begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            ids, each = self.vocabulary.merge_all(data, begins[np.cumsum(sizes)])
            total = np.concatenate(([0], np.cumsum(each)))
            stops = (total[np.concatenate(([0], np.cumsum(each_unit)))] * 4).tolist()
            packed = ids.astype("<u4").tobytes()
            self.update(zip(known, map(packed.__getitem__, map(slice, stops, stops[1:]))))
        else:
            self.update(dict.fromkeys(known, b""))
        return [u for u in known if len(u) > LONG]


def take_apart(text: str) -> list[str]:
    """The text cut before every space that a character other than white space follows.

    Such a space always begins a pre-token, whatever stands before it; other spaces stay with
    what comes before them.
    """
    if ODD_SPACE.search(text) is None:
        return text.split(" ")
    return CUT_SPACE.split(text)


class Encoder:
    """Encodes and decodes whole texts; holds the tables of one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.inner = _Units(vocabulary, " ")
        self.first = _Units(vocabulary, "")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special, specials = self.vocabulary.special, self.vocabulary.specials
        runs: list[list] = []
        heads: set[str] = set()
        later: set[str] = set()
        for text in texts:
            pieces = [text] if specials is None or specials.search(text) is None else specials.split(text)
            run: list = []
            for p in pieces:
                if p in special:
                    run.append(special[p].to_bytes(4, "little"))
                elif p:
                    parts = take_apart(p)
                    head = parts[0]
                    del parts[0]
                    heads.add(head)
                    later.update(parts)
                    run.append((head, parts))
            runs.append(run)
        first, inner = self.first, self.inner
        forget = [(first, first.learn(heads)), (inner, inner.learn(later))]
        out = []
        for run in runs:
            data: list[bytes] = []
            for r in run:
                if isinstance(r, bytes):
                    data.append(r)
                else:
                    data.append(first[r[0]])
                    data += map(inner.__getitem__, r[1])
            out.append(b"".join(data))
        for table, units in forget:
            for u in units:
                table.pop(u, None)
        return out

    def decode(self, ids: bytes) -> str:
        v = self.vocabulary
        at = np.frombuffer(ids, "<u4")
        at = at[at < len(v.token_sizes)]
        sizes = v.token_sizes[at]
        place = np.repeat(v.token_starts[at] - (np.cumsum(sizes) - sizes), sizes)
        return v.token_bytes[place + np.arange(len(place))].tobytes().decode("utf-8", "replace")


def read_file(spark: SparkSession, path: str) -> str:
    """The text of a vocabulary file, local to the driver or in a store that Spark reads."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return spark.read.text(path, wholetext=True).first()[0]


def groups(texts: list[str | None], limit: int = GROUP) -> Iterator[list[str]]:
    """Texts in groups of about ``limit`` characters; null counts as empty."""
    group: list[str] = []
    size = 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def in_slices(values: pa.Array, kind: pa.DataType, run: Callable[[list], list]) -> pa.Array:
    """``run`` over a few hundred values at a time, so that few of them are Python objects at once."""
    parts = [
        pa.array(run(values.slice(at, ROWS).to_pylist()), kind) for at in range(0, len(values), ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


#: One encoder in a worker, so that its tables outlive a batch.
_encoders: dict[int, Encoder] = {}


class BytePairs:
    """Column functions over one vocabulary file (a parameter, never copied)."""

    def __init__(self, spark: SparkSession, path: str):
        spec = read_file(spark, path)
        key = hash(spec)
        sent = spark.sparkContext.broadcast(spec)

        def encoder() -> Encoder:
            have = _encoders.get(key)
            if have is None:
                _encoders.clear()
                have = _encoders[key] = Encoder(Vocabulary(sent.value))
            return have

        @F.arrow_udf("binary")
        def encode(texts: pa.Array) -> pa.Array:
            run = encoder().encode
            return in_slices(texts, pa.binary(), lambda part: [i for g in groups(part) for i in run(g)])

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            run = encoder().decode
            return in_slices(ids, pa.string(), lambda part: [run(i) if i else "" for i in part])

        self.encoder = encoder
        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Binary of the ids, little-endian unsigned 32-bit; never null."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of such a binary; never null."""
        return self._decode(ids)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All rows with ids binary, n_tokens long and decoded string.

    Rows come back a few hundred at a time, so a task never holds the ids of a whole batch.
    """
    encoder = BytePairs(docs.sparkSession, path).encoder
    kept = [c for c in docs.columns if c not in {"ids", "n_tokens", "decoded"}]
    fields = [docs.schema[c] for c in kept]
    cells = [docs["`" + c.replace("`", "``") + "`"].alias(f"c{i}") for i, c in enumerate(kept)]
    if text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType):
        at = kept.index(text_col)
    else:
        at = len(kept)
        cells.append(docs["`" + text_col.replace("`", "``") + "`"].cast("string").alias("body"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder()
        names = [f"c{i}" for i in range(len(kept))] + ["ids", "decoded"]
        for batch in batches:
            for lo in range(0, len(batch), ROWS):
                part = batch.slice(lo, ROWS)
                ids = [i for g in groups(part.column(at).to_pylist()) for i in run.encode(g)]
                texts = [run.decode(i) if i else "" for i in ids]
                cells = [part.column(i) for i in range(len(kept))]
                cells += [pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    out = T.StructType(
        [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    )
    return (
        docs.select(*cells)
        .mapInArrow(code, out)
        .select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
            "ids",
            F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            "decoded",
        )
    )
