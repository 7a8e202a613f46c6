"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained on the driver by stochastic gradient descent in numpy, on a bounded sample
of labelled rows (``per_language`` rows of each language, whole texts, of which only the counts of
their hashed subwords reach the driver); prediction runs in the tasks over whole texts. A part of the sample sets a temperature,
so that scores are calibrated, and the score below which a prediction is rejected.

Nulls and odd input: a text that is null or has no letter gets ``und`` with score 0 and is
rejected; rows without label, text or id are not learned from; with nothing to learn from every
text gets ``und``; repeated rows are ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseflow.llm.words import ALNUM, LOWER, U, chunks, column

#: Buckets of subword hashes, width of an embedding, subword lengths in bytes.
BUCKETS, WIDTH, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANGUAGE = 1_500
#: Parts that a language's rows are dealt into before its sample is taken.
PARTS = 64
EPOCHS, RATE, SEED = 6, 0.5, 20240601
#: Share of the sample kept for calibration.
CALIBRATION = 5
#: Rejected: a score below that of all but this share of the calibration rows, and below so many
#: times the score of a guess.
REJECT_SHARE = 0.002
REJECT_GUESS = 1.4

#: Bytes of letters are folded to lower case, digits and all other ASCII bytes are one boundary.
FOLD = np.where(ALNUM, LOWER, np.uint8(0x20)).astype(np.uint8)
FOLD[0x30:0x3A] = 0x20


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all subwords, number of subwords of each text).

    A subword is 2 to 4 bytes of a word with the boundary before and after it as one byte.
    """
    raw = np.frombuffer(b" " + b"  ".join(texts) + b"     ", np.uint8)
    data = FOLD[raw].astype(np.uint32)
    letter = data != 0x20
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(sizes[:-1] + 2))) if len(texts) else sizes
    end = begin + sizes + 1
    n = len(data) - 4
    found, places = [], []
    code = data[:n].copy()
    inner = np.ones(n, bool)
    for size in range(2, max(SIZES) + 1):
        code = code | (data[size - 1 : n + size - 1] << np.uint32(8 * (size - 1)))
        if size > 2:
            inner = inner & letter[size - 2 : n + size - 2]
        if size in SIZES:
            if size == 2:
                ok = letter[:n] | letter[1 : n + 1]
            else:
                ok = inner
            at = np.flatnonzero(ok)
            key = (code[at].astype(U) + U(size << 40)) * U(0x9E3779B97F4A7C15)
            found.append((key >> U(64 - 15)).astype(np.int32))
            places.append(at)
    bucket, place = np.concatenate(found), np.concatenate(places)
    order = np.argsort(place, kind="stable")
    bucket, place = bucket[order], place[order]
    counts = np.searchsorted(place, end) - np.searchsorted(place, begin)
    keep = np.zeros(len(place) + 1, np.int64)
    np.add.at(keep, np.searchsorted(place, begin), 1)
    np.add.at(keep, np.searchsorted(place, end), -1)
    return bucket[np.cumsum(keep[:-1]) > 0], counts


#: Buckets of a text's subwords and how often each occurs.
Counts = tuple[np.ndarray, np.ndarray]


def subword_counts(text: bytes) -> Counts:
    bucket, count = np.unique(subwords([text])[0], return_counts=True)
    return bucket.astype(np.uint16), count.astype(np.float32)


@dataclass
class Model:
    """Languages, embeddings x output weights folded to one table, temperature, rejection."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities (text, language)."""
        bucket, counts = subwords(texts)
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(counts)
        if len(some):
            starts = np.concatenate(([0], np.cumsum(counts)))[some]
            out[some] = np.add.reduceat(self.table[bucket], starts, axis=0) / counts[some, None]
        return softmax((out + self.bias) / self.temperature)

    def scores_of(self, rows: list[Counts]) -> np.ndarray:
        """The same from subword counts."""
        out = np.zeros((len(rows), len(self.languages)))
        for i, (bucket, count) in enumerate(rows):
            if len(bucket):
                out[i] = count @ self.table[bucket] / count.sum()
        return softmax((out + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[Counts], labels: list[str], seed: int = SEED) -> Model:
    """Fit embeddings and softmax by gradient descent; every CALIBRATION-th row calibrates."""
    languages = sorted(set(labels))
    if not languages:
        return Model()
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(v) for v in labels])
    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    weight = rng.normal(0, 0.1, (WIDTH, k))
    bias = np.zeros(k)
    held = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    fit = np.flatnonzero(~held)
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            bucket, count = rows[i]
            done += 1
            if not len(bucket):
                continue
            share = (count / count.sum())[:, None]
            vector = (embed[bucket] * share).sum(0)
            z = vector @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            rate = RATE * (1 - done / steps)
            back = weight @ p
            weight -= rate * np.outer(vector, p)
            bias -= rate * 0.1 * p
            # an average spreads the step thinly over its subwords, hence the factor
            embed[bucket] -= rate * 20 * share * back
    model = Model(languages, (embed @ weight).astype(np.float32), bias.astype(np.float32))
    check = np.flatnonzero(held) if held.any() else fit
    truth = y[check]

    def loss(t: float) -> float:
        model.temperature = t
        log_p = np.log(np.maximum(model.scores_of([rows[i] for i in check]), 1e-12))
        hit = log_p[np.arange(len(check)), truth]
        # targets of a finite sample stay off 0 and 1, or separable languages would ask for
        # scores of exactly 1 even for texts like nothing in the sample
        miss = 1 / (len(check) + 2)
        return float(-((1 - miss) * hit + miss * log_p.mean(axis=1)).mean())

    grid = [2.0**e for e in np.arange(-4, 4.5, 0.5)]
    model.temperature = min(grid, key=loss)
    top = np.sort(model.scores_of([rows[i] for i in check]).max(axis=1))
    model.reject_below = float(min(REJECT_GUESS / k, top[int(REJECT_SHARE * len(top))]))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Model:
    """Train on at most ``per_language`` rows of each language that are not held out.

    The rows are those with the smallest hash of id and text, so the sample is spread evenly. A
    language's rows are dealt into parts and each part gives its first ones, so none is sorted in
    one task; whole texts stay in the tasks, subword counts come to the driver.
    """
    ident, label, text = column(docs, id_col), column(docs, label_col), column(docs, text_col)
    usable = docs.where(label.isNotNull() & text.isNotNull() & ident.isNotNull() & ~held_out(ident))
    # the hash alone is ordered; equal hashes are equal rows but for chance
    keyed = usable.select(
        label.cast("string").alias("label"), F.xxhash64(ident, text).alias("h"), text.cast("binary").alias("t")
    )
    hashes = keyed.select("label", "h", F.pmod(F.shiftright("h", 20), F.lit(PARTS)).alias("part"))
    first = Window.partitionBy("label", "part").orderBy("h")
    few = hashes.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language)
    every = Window.partitionBy("label").orderBy("h")
    chosen = few.withColumn("r", F.row_number().over(every)).where(F.col("r") <= per_language)
    # at most per_language rows of each language; a text that occurs again is taken as often as chosen
    sample = chosen.groupBy("label", "h").agg(F.count(F.lit(1)).alias("times"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                bucket, times = subword_counts(batch.column("t")[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, 1) for c in ("label", "h", "times")],
                        pa.array([bucket.astype("<u2").tobytes()], pa.binary()),
                        pa.array([times.astype("<f4").tobytes()], pa.binary()),
                    ],
                    names=["label", "h", "times", "bucket", "count"],
                )

    found = (
        keyed.join(F.broadcast(sample), ["label", "h"])
        .mapInArrow(count, "label string, h bigint, times bigint, bucket binary, count binary")
        .dropDuplicates(["label", "h"])
        .toArrow()
        .sort_by([("h", "ascending"), ("label", "ascending")])
    )
    rows, labels = [], []
    for name, times, bucket, n in zip(*(found[c].to_pylist() for c in ("label", "times", "bucket", "count"))):
        rows += [(np.frombuffer(bucket, "<u2"), np.frombuffer(n, "<f4"))] * times
        labels += [name] * times
    return train(rows, labels)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows with lang_pred string, score double (0 to 1) and rejected boolean."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = column(docs, text_col).cast("string")

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        langs: list[str] = []
        scores: list[float] = []
        for _, group in chunks(texts, 1 << 17):
            p = model.scores(group)
            best = p.argmax(axis=1)
            langs += [model.languages[b] for b in best]
            scores += p[np.arange(len(best)), best].tolist()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
        )

    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    kept = [c for c in docs.columns if c not in {"lang_pred", "score", "rejected"}]
    found = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        lettered.alias("ok"),
        predict(F.when(lettered, text.cast("binary"))).alias("p") if model.languages
        else F.lit(None).cast("struct<lang:string,score:double>").alias("p"),
    )
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.when(F.col("ok"), F.col("p.lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("ok"), F.col("p.score")).otherwise(0.0).alias("score"),
        (~F.col("ok") | (F.col("p.score") < model.reject_below)).alias("rejected"),
    )


