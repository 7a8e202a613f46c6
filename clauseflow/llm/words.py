"""Vectorised word splitting and hashing of byte texts (numpy, inside tasks).

Both word classes in use are decided byte by byte in UTF-8, so a batch of texts is joined into
one buffer and split by a lookup table. Hashes are 64 bits wide: a polynomial over the bytes
of the word, or a tree of mixed pairs over word hashes, each passed through a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_B = U(0x9E3779B97F4A7C15)
_B_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes hashed at once; a longer piece is cut at a separator.
SLICE = 1 << 17
#: Bytes of text handled together.
CHUNK = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are maximal runs without white space.
SPACED = ~WHITE
#: Words are runs of ASCII letters, digits and bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

AS_IS = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, everything else unchanged.
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, key: str, n: int) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 2), base, U)
        steps[0] = U(1)
        have = _powers[key] = np.cumprod(steps, dtype=U)
    return have[:n]


class Words:
    """The words of a list of texts, one after the other.

    starts, ends: byte places in ``buffer``; first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, texts: list[bytes], members: np.ndarray):
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        inside = members[self.buffer].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.offsets)

    @classmethod
    def of(cls, words: pa.LargeBinaryArray) -> Words:
        """A column of words, none of them empty, each a text of its own."""
        made = cls.__new__(cls)
        _, places, data = words.buffers()
        offsets = np.frombuffer(places, np.int64)[words.offset : words.offset + len(words) + 1]
        made.buffer = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        made.starts, made.ends, made.offsets = offsets[:-1], offsets[1:], offsets
        made.first = np.arange(len(words) + 1)
        return made

    def hashes(self, fold: np.ndarray = AS_IS) -> np.ndarray:
        """One 64-bit hash for each word, after ``fold`` of its bytes."""
        out = np.empty(len(self.starts), U)
        lo = 0
        while lo < len(out):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + SLICE, side="right")))
            s, e = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            size = int(e[-1])
            value = fold[self.buffer[base : base + size]].astype(U) + U(1)
            total = np.zeros(size + 1, U)
            np.cumsum(value * _power(_B, "b", size), out=total[1:])
            out[lo:hi] = (total[e] - total[s]) * _power(_B_INV, "i", size)[s]
            lo = hi
        return mix(out)

    def text(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes()


def join_two(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * U(0xD6E8FEB86659FD93) + right * U(0xA0761D6478BD642F) + U(0x2545F4914F6CDD1D))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each place on; the last n - 1 places are left out."""
    out, done, level, width = None, 0, hashes, 1
    while width <= n:
        if n & width:
            part = level[done : len(level)] if done else level
            out = part if out is None else join_two(out[: len(part)], part[: len(out)])
            done += width
        if 2 * width <= n:
            level = join_two(level[:-width], level[width:]) if len(level) > width else level[:0]
        width *= 2
    keep = max(0, len(hashes) - n + 1)
    return out[:keep]


def each_value(values: list | pa.Array, rows: int = 256) -> Iterator:
    """The values one after the other; of a column only a few are Python objects at a time."""
    if isinstance(values, list):
        yield from values
    else:
        for at in range(0, len(values), rows):
            yield from values.slice(at, rows).to_pylist()


def chunks(values: list | pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) in groups of about ``limit`` bytes; null counts as empty."""
    group: list[bytes] = []
    size = start = 0
    for i, v in enumerate(each_value(values)):
        v = v or b""
        if group and size + len(v) > limit:
            yield start, group
            group, size, start = [], 0, i
        group.append(v)
        size += len(v)
    if group:
        yield start, group


def byte_values(column: pa.Array) -> list:
    """Python byte strings of a binary column."""
    return column.to_pylist()


def column(df, name: str):
    """The column of exactly this name, quoted so that dots in names are safe."""
    return df["`" + name.replace("`", "``") + "`"]
