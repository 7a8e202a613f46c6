from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in ("th", "on", "er", "in", "le", "ou") for b in ("a", "es", "ing", "on", "ux", "ent")]

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that the operators use for their own columns
        *[T.StructField(n, T.LongType()) for n in ("row", "doc", "body", "n_words", "kept_text", "node")],
    ]
)


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(("", "", "", ",", ".")) + str(rng.randrange(40)))
    return " ".join(out)


def cases() -> list[tuple]:
    """(id, text): nulls, empties, copies, near copies, shared lines and passages, long texts."""
    rng = random.Random(7)
    lines = [prose(rng, 9) for _ in range(6)]
    passage = prose(rng, 60)
    base = prose(rng, 120).split(" ")
    rows: list[tuple] = [(0, None), (1, ""), (2, "   \n\t "), (3, "a"), (4, "Two words"), (5, "Two words")]
    for i in range(10, 22):  # near copies: one or two words changed
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(30, 36):
        rows.append((i, prose(rng, 40) + " " + passage + " " + prose(rng, 25)))
    for i in range(40, 52):
        own = [prose(rng, 7) for _ in range(3)]
        rows.append((i, "\n".join([own[0], lines[i % 6], "  " + lines[(i + 1) % 6].upper() + "\t", *own[1:]])))
    rows.append((60, prose(rng, 6000)))
    rows.append((61, "spam " * 200))
    rows.append((62, "ünï çödé ÀÉ — 中文字符 \U0001f600 " * 12))
    rows.append((63, "".join("é" for _ in range(50))))
    rows.append((30, rows[18][1]))  # the same row again
    rows.append((70, rows[20][1] + " tail"))
    rows.append((70, prose(rng, 50)))  # one id with two texts
    rows.append((None, prose(rng, 45)))
    rows.append((None, rows[20][1]))
    return rows


@pytest.fixture(scope="session")
def rows():
    return cases()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
