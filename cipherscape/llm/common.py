"""What several corpus operators share: words, hashes, written stages, numbering."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the six ASCII white-space
#: characters.  ``bytes.split()`` cuts UTF-8 at exactly these bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- written stages -----------------------------------------------------------

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, on a local master, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cipherscape-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The files are compressed, every executor sees them, and a lost executor
    costs no recomputation.  They lie in a folder of the application's own; ``scratch``
    removes those that a finished step leaves behind.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, the folders that ``stage`` wrote inside, but for the last one before each call of what it gives."""
    kept: list[str] = []
    _scopes.append([])

    def keep(staged: DataFrame) -> DataFrame:
        kept.append(_scopes[-1].pop())
        return staged

    try:
        yield keep
    finally:
        for path in _scopes.pop():
            remove(spark, path)
        if _scopes:  # what is kept here may go with the scope around it
            _scopes[-1].extend(kept)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that no column has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of literals that the driver holds."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{schema}>>"))))


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order of ``order``, without one task seeing all rows.

    Rows are range partitioned and sorted; the written partitions are counted,
    and each row adds its place to the rows of the partitions before its own.
    """
    placed = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    placed = placed.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    placed = stage(placed.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())
    start, starts = 0, {}
    for p, n in sizes:
        starts[p] = start
        start += n
    offsets = small_table(df.sparkSession, [{"_p": p, "_start": s} for p, s in starts.items()], "_p:long,_start:long")  # a row for each partition
    return (
        placed.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_m", "_start")
    )


def tree_sum(rows: DataFrame, length: int, depth: int = 3) -> np.ndarray:
    """The sum of vectors of ``length`` 64-bit integers, one a row as bytes, added up in a tree: the driver gets a few of them."""

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    vectors = rows.rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    return vectors.treeAggregate(np.zeros(length, np.int64), add, add, depth)


# -- words and windows as numbers ------------------------------------------------


class WordHashes(dict):
    """xxh3 of a word, kept for the words met so far; forgets all at ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Odd numbers whose powers weigh the words of a window; each gives a hash of its own.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def windows(hashes: np.ndarray, width: int, base: int = FIRST) -> np.ndarray:
    """A hash of every run of ``width`` consecutive words; empty when there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * np.uint64(pow(base, k + 1, 1 << 64))
    return mixed(out)


def ascii_lower(text: bytes) -> bytes:
    """A-Z to a-z; bytes.lower() leaves all bytes of other characters alone."""
    return text.lower()


def power_of_two(n: float, least: int = 1, most: int = 1 << 20) -> int:
    k = least
    while k < n and k < most:
        k *= 2
    return k


# -- hashes by bucket ------------------------------------------------------------


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    shift = buckets.bit_length() - 1
    return (h >> np.uint64(64 - shift)).astype(np.int32) if shift else np.zeros(len(h), np.int32)


def rest_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits below those that name the bucket."""
    shift = buckets.bit_length() - 1
    return ((h << np.uint64(shift)) >> np.uint64(32)).astype(np.uint32)


def by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of a sorted array, one for each bucket that it has."""
    b = bucket_of(h, buckets)
    cuts = np.flatnonzero(np.diff(b)) + 1
    starts = np.concatenate(([0], cuts)) if len(h) else []
    ends = np.concatenate((cuts, [len(h)])) if len(h) else []
    for s, e in zip(starts, ends, strict=True):
        yield int(b[s]), slice(int(s), int(e))


def binary_rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=names)
