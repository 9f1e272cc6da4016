"""A quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

Features are the words and word pairs of a text, once as they are written and once
as shapes (letters of a kind to one sign, a repeated word to '='), hashed into
2**``bits`` places.  A feature's value is its share of the text's n-grams, so
long texts weigh as short ones.  Weights follow the regularised leader: per-place
learning rates, an L1 threshold that keeps the model sparse, L2 shrinkage.

Training reads at most ``rows`` labelled texts (those with the smallest hashes of
their ids) and ``held`` bytes of their features, documented bounds, in one task; a text is taken whole or not at all.  Scoring reads
every whole text and is a sparse dot product with the broadcast weights, whose size is
bounded by ``bits``.

Edge cases: a null or wordless text has no features and scores the intercept;
labels without a text, null labels and repeated labels train nothing twice (a
repeated id trains once, with its largest label); without any labelled row the
score is 0.5; a very long text is scored as a whole and weighs as a short one; equal texts
have equal scores; a null id is never held out; an empty table gives an empty result;
further columns stay, but for those named held_out, score and predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled texts that training reads.
TRAIN_ROWS = 4000
#: The most bytes of their features that training holds: it takes texts, whole, in the order of their ids' hashes until the next would exceed it.
TRAIN_BYTES = 128 << 20
BITS = 20

_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-z\xdf-\xff]{2,}"), re.compile(r"[a-z\xdf-\xff]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    return _LOWER.sub("a", _UPPER.sub("AA", _DIGIT.sub("0", word)))


class _Words(dict):
    """Numbers words as they come; ``written`` and ``shaped`` hold their hashes by number."""

    def __init__(self, limit: int):
        super().__init__()
        self.written, self.shaped = np.empty(limit, np.uint64), np.empty(limit, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.written[k] = xxhash.xxh3_64_intdigest(word)
        self.shaped[k] = xxhash.xxh3_64_intdigest(shape(word.decode(errors="replace")), 1)
        return k


class Features:
    """Hashed n-grams of texts; keeps the hashes of the words it has met, up to a bound."""

    def __init__(self, bits: int = BITS, limit: int = 1 << 19):
        self.mask, self.limit = np.uint64((1 << bits) - 1), limit
        self.words = _Words(limit)

    def places(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """(place of each n-gram, number of words)."""
        words = (text or b"").split()
        if not words:
            return np.empty(0, np.int64), 0
        if len(self.words) + len(words) > self.limit:
            self.words = _Words(max(self.limit, len(words)))
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        written, shaped = self.words.written[at], self.words.shaped[at]
        shaped[1:][at[1:] == at[:-1]] = np.uint64(61)  # '=': the word before again
        grams = [written, shaped]
        for h in (written, shaped):
            grams.append((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7)))
        h = np.concatenate(grams)
        return ((h ^ (h >> np.uint64(32))) & self.mask).astype(np.int64), len(words)

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, values), places ascending and each once."""
        places, n = self.places(text)
        places, counts = np.unique(places, return_counts=True)
        return places, counts / max(n, 1)


class Ftrl:
    """Follow-the-regularised-leader with per-place rates for logistic loss."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias, self.bias_n = 0.0, 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(places)
        p = 1 / (1 + np.exp(-np.clip(w @ values + self.bias, -30, 30)))
        g = weight * (p - label) * values
        sigma = (np.sqrt(self.n[places] + g * g) - np.sqrt(self.n[places])) / self.alpha
        self.z[places] += g - sigma * w
        self.n[places] += g * g
        gb = weight * (p - label)
        self.bias_n += gb * gb
        self.bias -= 0.1 * gb / np.sqrt(1e-9 + self.bias_n)


@dataclass
class Model:
    """The weights that aren't 0, by place, and the intercept."""

    bits: int
    places: np.ndarray
    weights: np.ndarray
    bias: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.places] = self.weights
        return out


def fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, passes: int) -> tuple[np.ndarray, float]:
    """(weights, intercept) of (label, places, values) rows, both classes weighing the same."""
    y = np.array([r[0] for r in rows], int)
    share = np.bincount(np.clip(y, 0, 1), minlength=2)
    if not share.all():
        return np.zeros(1 << bits, np.float32), 0.0 if not len(y) else (4.0 if share[1] else -4.0)
    balance, model = len(y) / (2 * share), Ftrl(bits)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            model.learn(rows[i][1], rows[i][2].astype(float), int(y[i]), float(balance[y[i]]))
    return model.weights().astype(np.float32), float(model.bias)


def trained(
    docs: DataFrame, labels: DataFrame, label: str, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, bits: int = BITS, passes: int = 6, held: int = TRAIN_BYTES
) -> Model:
    """The model of the texts of at most ``rows`` labels, as many of them as ``held`` bytes of features hold.

    Labels without a text don't count towards the bound.  It is the bound of what is broadcast, so no text
    is shuffled; vectors meet, one a label, in one task, and the driver gets the weights.
    """
    known = docs.filter(F.col(text).isNotNull()).select(key)
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.join(known, key, "left_semi").orderBy(F.xxhash64(key), key).limit(rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            found = []
            for v in batch.column(1):
                at, share = features.of(v.as_py())
                found.append((at.astype(np.int32).tobytes(), share.astype(np.float32).tobytes()))
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.binary()) for c in columns)], names=[key, "y", "places", "shares"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                row = tuple(v.as_py() for v in row)
                size += len(row[2]) + len(row[3])
                if size <= held:
                    found.append(row)
        found.sort()
        if found:
            weights, bias = fitted([(y, np.frombuffer(p, np.int32), np.frombuffer(s, np.float32)) for _, y, p, s in found], bits, passes)
            at = np.flatnonzero(weights)
            columns = [pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([weights[at].tobytes()], pa.binary()), pa.array([bias])]
            yield pa.RecordBatch.from_arrays(columns, names=["places", "weights", "bias"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).cast("binary").alias("t"))
    made = texts.join(F.broadcast(chosen), key).select(key, "t", "y").mapInArrow(vectors, f"`{key}` {kind}, y int, places binary, shares binary")
    once = made.groupBy(key).agg(F.min(F.struct("y", "places", "shares")).alias("v")).select(key, "v.*")  # of a repeated id, the least
    model = once.repartition(1).sortWithinPartitions(F.xxhash64(key), key).mapInArrow(fit, "places binary, weights binary, bias double").first()
    if model is None:
        return Model(bits, np.empty(0, np.int32), np.empty(0, np.float32))
    return Model(bits, np.frombuffer(model["places"], np.int32), np.frombuffer(model["weights"], np.float32), model["bias"])


def scored(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score column, for use in ``docs.withColumn``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        weights, features = model.dense(), Features(model.bits)
        for batch in batches:
            out = np.empty(len(batch))
            for k, value in enumerate(batch):
                places, n = features.places(value.as_py())
                out[k] = weights[places].sum(dtype=float) / max(n, 1) + model.bias
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    # annotations name the kind of function to Spark
    return F.arrow_udf(score, "double")(F.col(text).cast("binary"))


def held_out(id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more; their columns stay as they are."""
    model = trained(docs, labels.filter(~held_out(id)).select(id, label), label, text, id)
    return docs.filter(scored(docs, model, text) >= 0.5)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    model = trained(docs, labels.filter(~held_out(id)).select(id, label), label, text, id)
    found = docs.withColumn("held_out", held_out(id)).withColumn("score", scored(docs, model, text))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
