"""Compressed vectors: integer codebooks for parts of vectors, nearest entries found by VA-file filtering.

A component x becomes floor(scale * x).  Vectors are cut into equal consecutive parts; each part has a
codebook of at most 256 entries, which starts as that part of the vectors with the smallest ids and
is moved to the means (rounded down) of the parts nearest to its entries, ``rounds`` times.

Nearest entries are found as a vector approximation file finds neighbours.  Every coordinate of an entry
is quantised to a cell of a few bits (``Cells``).  For a part that asks, tables with one row for each
position and cell give the least and the greatest squared distance to whatever lies in the cell; summed
over an entry's cells they bound its distance from below and above.  Only entries whose lower bound is
not above the smallest upper bound are refined, with integer distances, ties to the smaller index.

Each round reads the vectors once.  A task sends sums and counts of entries, a vector of one size however
many rows it read; a tree adds them up, and the driver divides them.  Nothing else leaves the tasks.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, nor
do those whose length the parts don't divide, or that is not the length of the vector with the smallest id; repeated
ids are rows each, and among equal ids the lesser vector is the earlier entry; null ids come last; with fewer than 256 vectors the
codebooks have that many entries; an empty table gives an empty result; components too large for
64-bit distances are an error; further columns stay, but for those whose names the result uses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import stage, tree_sum

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a cell's number.
BITS = 4
#: Vectors whose bounds are taken at once.
AT_ONCE = 1024


class Cells:
    """The entries of one codebook (entries x width, integers) with the cells of their coordinates."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        entries, width = book.shape
        count = min(1 << bits, max(entries, 1))
        place = np.argsort(np.argsort(book, axis=0, kind="stable"), axis=0, kind="stable")
        self.cell = place * count // max(entries, 1)  # entries x width; each cell of a position holds about as many entries
        self.low, self.high = np.zeros((width, count)), np.zeros((width, count))
        self.holds = np.zeros((width * count, entries))
        for j in range(width):
            for c in range(count):
                inside = book[self.cell[:, j] == c, j]
                if len(inside):
                    self.low[j, c], self.high[j, c] = inside.min(), inside.max()
            self.holds[j * count + self.cell[:, j], np.arange(entries)] = 1

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each row of ``asked`` to each entry, by its cells alone."""
        x = asked[:, :, None].astype(float)
        near = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        far = np.maximum(self.high - x, x - self.low)
        return (near * near).reshape(len(x), -1) @ self.holds, (far * far).reshape(len(x), -1) @ self.holds

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) pairs that the bounds leave open, by row and entry; sums of doubles get some room."""
        lower, upper = self.bounds(asked)
        return np.nonzero(lower * (1 - 1e-9) <= upper.min(axis=1, keepdims=True) * (1 + 1e-9))

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row, exact."""
        at, distance = np.empty(len(asked), np.int64), np.empty(len(asked), np.int64)
        for s in range(0, len(asked), AT_ONCE):
            some = asked[s : s + AT_ONCE]
            row, entry = self.candidates(some)
            apart = some[row] - self.book[entry]
            exact = (apart * apart).sum(axis=1)
            least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(some))))
            best = np.flatnonzero(exact == least[row])[::-1]  # the smallest index of equals is written last
            at[s + row[best]] = entry[best]
            distance[s : s + len(some)] = least
        return at, distance


def whole(vector: str) -> Column:
    """The vector is there, and so are all its components, as finite numbers."""
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: F.coalesce(c.cast("double") * 0 != 0, F.lit(True)))  # 0 * inf is no number


def matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Whole vectors of one length as rows of integers."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(len(column), dim)
    if len(x) and np.abs(x).max() >= np.sqrt((1 << 61) / dim) / 2:
        raise ValueError("a component is too large for 64-bit distances")
    return x.astype(np.int64)


def _of_dim(rows: DataFrame, id: str, vector: str, parts: int) -> tuple[DataFrame, int]:
    kept = rows.filter(whole(vector) & (F.size(vector) % parts == 0))
    first = kept.select(F.col(id).alias("i"), F.size(vector).alias("n")).orderBy(F.col("i").asc_nulls_last(), "n").first()
    dim = first["n"] if first else 0
    return kept.filter(F.size(vector) == dim), dim


def trained(kept: DataFrame, dim: int, id: str, vector: str, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of whole vectors of length ``dim``."""
    smallest = kept.select(id, vector).orderBy(F.col(id).asc_nulls_last(), vector).limit(entries).select(vector).toArrow()
    start = matrix(smallest.column(0).combine_chunks(), dim, scale) if smallest.num_rows else np.zeros((0, dim), np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    shape = (*books.shape[:2], books.shape[2] + 1)
    for _ in range(rounds if len(start) else 0):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, cells = np.zeros(shape, np.int64), [Cells(b) for b in books]
            for batch in batches:
                x = matrix(batch.column(0), dim, scale)
                for p, part in enumerate(np.split(x, parts, axis=1) if len(x) else []):
                    at, _ = cells[p].nearest(part)
                    order = np.argsort(at, kind="stable")
                    met, begin = np.unique(at[order], return_index=True)
                    total[p, met, :-1] += np.add.reduceat(part[order], begin, axis=0)
                    total[p, met, -1] += np.diff([*begin, len(at)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        total = tree_sum(kept.select(vector).mapInArrow(sums, "sums binary"), int(np.prod(shape))).reshape(shape)
        used = total[..., -1:] > 0
        books = np.where(used, total[..., :-1] // np.maximum(total[..., -1:], 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(kept: DataFrame, books: np.ndarray, vector: str, scale: float = SCALE) -> DataFrame:
    """``kept`` without the vector, with code (two hex digits a part) and error (squared distances, summed)."""
    others = [c for c in kept.columns if c not in (vector, "code", "error")]
    dim = books.shape[0] * books.shape[2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            x = matrix(batch.column(0), dim, scale)
            found = [cells[p].nearest(part) for p, part in enumerate(np.split(x, len(books), axis=1))]
            digits = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            step = 2 * len(books)
            code = pa.array([digits[k : k + step] for k in range(0, len(digits), step)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], code, pa.array(sum(d for _, d in found), pa.int64())], names=[*others, "code", "error"])

    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others] + ["code string", "error long"])
    return kept.select(vector, *others).mapInArrow(encode, schema)


def decoded(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(books))
    return np.concatenate([b[at[:, p]] for p, b in enumerate(books)], axis=1)


def compressed(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", bits_of: float = SCALE, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """Rows with code, error, label_error (error summed over rows of an equal label) and codebooks_sha256; without the vector."""
    rows = rows.select(*[c for c in rows.columns if c not in ("code", "error", "label_error", "codebooks_sha256")])
    kept, dim = _of_dim(rows, id, vector, parts)
    books = trained(kept, dim, id, vector, bits_of, parts, rounds=rounds)
    found = stage(encoded(kept, books, vector, bits_of), "codes")
    totals = found.groupBy(F.col(label).alias("_l")).agg(F.sum("error").alias("label_error"))  # summed in each task first
    return found.join(totals, F.col(label).eqNullSafe(F.col("_l"))).drop("_l").withColumn("codebooks_sha256", F.lit(digest(books)))
