"""Importance resampling towards a target: hashed n-gram counts of the corpus and of the target weigh each document.

Two passes over whole texts, in Arrow batches.  The first counts buckets: each task gives one vector
(np.bincount), and a tree adds the vectors up.  A bucket's gain is the scaled logarithm of how much
likelier it is in the target, both counts smoothed by one a bucket.  The gains, one number a bucket, are broadcast; the second
pass sums them over each document's features (np.bincount with weights).  A Gumbel draw
that depends on the document's id and the seed alone is added, and the highest scores are drawn: sampling without replacement in
proportion to exp(weight / 1000), that repeats exactly.

Features are runs of 1 to 3 consecutive words, joined by one space; a feature's bucket is its CRC-32 modulo
the number of buckets.  Words are looked up once; the CRCs of longer runs follow from those of
their words, as the CRC of joined bytes is the first one's, moved on by the second's length, xor the second's (``joined``).
Texts are taken in pieces of about PIECE bytes that overlap by two words, so memory doesn't grow with a text.

Ranks: rows are range partitioned by score and numbered within, so no task sees all of them.

Edge cases: a null or empty text, or one without words, has no features, weight 0, and is never drawn; with
fewer words than n there are no runs of n; repeated rows are rows each; ties go to the smaller id (nulls
last), then the earlier row; a null id draws as an empty one; an empty table gives an empty result; an empty
target or null target texts count nothing; further columns stay, but for those whose names the result uses.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import dense_ids, scratch, stage, tree_sum

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
#: Bytes of text whose words are held at once, and words whose CRC is kept.
PIECE, WORDS = 1 << 20, 200_000
#: ASCII letters in lower case, digits and all bytes of other characters make up words; the rest is a gap.
_GAPS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


# -- CRC-32 of joined words ---------------------------------------------------------


def _zero_byte() -> np.ndarray:
    """What one zero byte makes of a CRC register, as a table by byte place and value; the map is linear."""
    out = np.zeros((4, 256), np.uint32)
    for place in range(4):
        for value in range(256):
            c = value << 8 * place
            for _ in range(8):
                c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
            out[place, value] = c
    return out


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0, crc & 255] ^ tables[1, crc >> 8 & 255] ^ tables[2, crc >> 16 & 255] ^ tables[3, crc >> 24]


class Shifts:
    """Moves CRCs on by numbers of bytes: by table up to SHORT bytes, beyond that by powers of two as well."""

    SHORT = 64

    def __init__(self) -> None:
        one = _zero_byte()
        short = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * p) for p in range(4)])]
        while len(short) < self.SHORT:
            short.append(_moved(one, short[-1]))
        self.short = np.stack(short)
        self.powers = [_moved(one, short[-1])]  # 64 bytes, 128, 256, ...

    def by(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``crc`` moved on by ``n`` bytes each."""
        low, at = n % self.SHORT, [crc & 255, crc >> 8 & 255, crc >> 16 & 255, crc >> 24]
        out = self.short[low, 0, at[0]] ^ self.short[low, 1, at[1]] ^ self.short[low, 2, at[2]] ^ self.short[low, 3, at[3]]
        high = n // self.SHORT
        for k in range(int(high.max(initial=0)).bit_length()):
            if k == len(self.powers):
                self.powers.append(_moved(self.powers[-1], self.powers[-1]))
            some = np.flatnonzero(high >> k & 1)
            out[some] = _moved(self.powers[k], out[some])
        return out

    def joined(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC of first + b" " + second, the second of ``length`` bytes."""
        spaced = _moved(self.short[1], first) ^ np.uint32(zlib.crc32(b" "))
        return self.by(spaced, length) ^ second


class _Words(dict):
    """CRC of a word, kept for the words met so far; forgets all at WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


# -- features -----------------------------------------------------------------------


def _pieces(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (text's number, piece) of about PIECE bytes; a text is cut at gaps only."""
    group, size = [], 0
    for k, text in enumerate(texts):
        text = (text or b"").translate(_GAPS)
        start = 0
        while start < len(text):
            end = text.find(b" ", start + PIECE) if len(text) - start > PIECE else -1
            piece = text[start : end if end >= 0 else None]
            start += len(piece)
            group.append((k, piece))
            size += len(piece)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def featured(texts: list[bytes | None], shifts: Shifts, known: _Words, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of (text's number and bucket of each feature, text's number of each word) of all texts."""
    carried, last = [], -1  # two words of a text's piece before
    for group in _pieces(texts):
        words, owner, old = [], [], []
        for k, piece in group:
            if k != last:
                carried = []
            found = piece.split()
            words += carried
            owner.append((k, len(carried) + len(found)))
            old += [True] * len(carried) + [False] * len(found)
            words += found
            carried, last = (carried + found)[-2:], k
        crc = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        text = np.repeat([k for k, _ in owner], [n for _, n in owner]).astype(np.int64)
        new = ~np.array(old, bool)
        two = shifts.joined(crc[:-1], crc[1:], length[1:])  # of words i and i + 1
        three = shifts.joined(two[:-1], crc[2:], length[2:])
        in_two = new[1:] & (text[1:] == text[:-1])
        in_three = new[2:] & (text[2:] == text[:-2])
        at = np.concatenate([text[new], text[1:][in_two], text[2:][in_three]])
        found = np.concatenate([crc[new], two[in_two], three[in_three]]) % np.uint32(buckets)
        yield at, found.astype(np.int64), text[new]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, known, total = Shifts(), _Words(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, at, _ in featured(batch.column(0).to_pylist(), shifts, known, buckets):
                total += np.bincount(at, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    return tree_sum(docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "n binary"), buckets)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A gain for each bucket: 1000 times the logarithm of the ratio of smoothed shares, rounded down."""
    a, b, n = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = [float((t + 1) * (a + n)) / float((s + 1) * (b + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(id: object, seed: int = SEED) -> int:
    """A Gumbel draw that depends on the id and the seed, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` without the text, with n_words, n_features, weight and score; written."""
    others = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, known, value = Shifts(), _Words(), shared.value.astype(float)
        for batch in batches:
            n = batch.num_rows
            words, features, weight = (np.zeros(n) for _ in range(3))
            for at, bucket, word in featured(batch.column(0).to_pylist(), shifts, known, len(value)):
                features += np.bincount(at, minlength=n)
                weight += np.bincount(at, weights=value[bucket], minlength=n)
                words += np.bincount(word, minlength=n)
            drawn = np.fromiter((noise(v, seed) for v in batch.column(1).to_pylist()), np.int64, n)
            whole = [words.astype(np.int64), features.astype(np.int64), weight.astype(np.int64), weight.astype(np.int64) + drawn]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *map(pa.array, whole)], names=[*others, "n_words", "n_features", "weight", "score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"{c} long" for c in ("n_words", "n_features", "weight", "score")])
    found = stage(docs.select(F.col(text).cast("binary"), F.col(id).cast("string").alias("_id"), *others).mapInArrow(weigh, schema), "weighed")
    shared.destroy()
    return found


def resampled(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``docs`` without the text, with n_words, n_features, weight, score and rank: 1, 2, 3 ... of the rows drawn, else null.

    Of the documents with ``least`` words or more, ``percent`` in a hundred are drawn.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("n_words", "n_features", "weight", "score", "rank")])
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    with scratch(docs.sparkSession) as keep:
        found = weighed(docs, gain, id, text, seed)
        drawn = percent * found.filter(F.col("n_words") >= least).count() // 100
        keys = {"_short": (F.col("n_words") < least).cast("int"), "_down": -F.col("score"), "_row": F.monotonically_increasing_id()}
        placed = keep(dense_ids(found.withColumns(keys), ["_short", "_down", id, "_row"], "_place"))
    return placed.withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop(*keys, "_place")
