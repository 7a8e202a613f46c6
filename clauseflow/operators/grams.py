"""Hashes of word 1- and 2-grams of texts (numpy, inside tasks)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Characters taken apart together.
SLICE = 1 << 19


@cache
def _members() -> np.ndarray:
    """Which code points are letters, numbers or the underscore."""
    kinds = [unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)]
    kinds[ord("_")] = True
    return np.array(kinds)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, U(b))
        steps[0] = U(1)
        both.append(np.cumprod(steps, dtype=U))
    return both[0], both[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of each 1- and 2-gram of tokens of two or more characters."""
    buffer = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), np.uint32)
    inside = _members()[buffer].view(np.int8)
    edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    tokens = ends - starts >= 2
    starts, ends = starts[tokens], ends[tokens]
    size = 1 << max(len(buffer), SLICE).bit_length()
    power, inverse = _powers(size)
    total = np.zeros(len(buffer) + 1, U)
    np.cumsum((buffer.astype(U) + U(1)) * power[: len(buffer)], out=total[1:])
    one = mix((total[ends] - total[starts]) * inverse[starts])
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.searchsorted(bounds, starts, side="right").astype(np.int32)
    follows = owner[1:] == owner[:-1]
    two = mix(one[:-1] * U(0xD6E8FEB86659FD93) + one[1:] * U(0xA0761D6478BD642F) + U(0x2545F4914F6CDD1D))
    return np.concatenate([owner, owner[:-1][follows]]), np.concatenate([one, two[follows]])


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in groups of about ``SLICE`` characters; null counts as empty."""
    held: list[str] = []
    first = size = 0
    for i, raw in enumerate(texts):
        t = (raw or b"").decode("utf-8", "replace")
        if held and size + len(t) > SLICE:
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, hash, frequency) of every different term of a text, by text."""
    parts = [(np.empty(0, np.int32), np.empty(0, U), np.empty(0, np.int32))]
    for first, some in _slices(texts):
        owner, terms = grams(some)
        order = np.lexsort((terms, owner))
        owner, terms = owner[order], terms[order]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        parts.append((owner[at] + np.int32(first), terms[at], np.diff(at, append=len(terms)).astype(np.int32)))
    owner, terms, counts = (np.concatenate(x) for x in zip(*parts))
    return owner, terms, counts


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight: what is mostly zero then lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of ``planes``."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
