"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of the partial scores that ``slices`` slices of the dimensions
give.  Each slice is a node of its own: its rows hold the slice of a block of candidates and
no other dimension.  Queries meet them in blocks, never pair by pair.

1. *Gather.*  For a query every slice lists its best candidates of each block.  Their
   whole scores are resolved; the k-th best of all is a safe cutoff: k candidates reach it.
2. *Send the cutoff, collect.*  The cutoff goes back to the nodes with the queries.  Whoever
   reaches it must exceed, in one slice at least, the slice's own level by an equal share
   of what the cutoff exceeds all levels by.  Each slice sends only such entries; a candidate
   whose slice is too short to reach the share (Cauchy-Schwarz) is not multiplied at all.
3. *Resolve.*  The entries of a block's slices meet, the partial scores that are still missing
   are computed for these entries alone, and those that reach the cutoff, at most k a
   query and block, are ranked.

``work`` counts what was multiplied and sent.  Scores are integers; products that could exceed
2**53 are taken in 64-bit integers instead of doubles.

Edge cases: vectors that are null or hold null or non-finite components take no
part; a query meets vectors of its own length only; rows with the query's id are
never its candidates, so a repeated row does not find itself; repeated candidate
rows are candidates each; ties go to the smaller id; with fewer than k candidates
all are returned; very long vectors make smaller blocks; an empty table gives an empty
result; a null id takes no part; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherscape.llm.common import stage

#: Vectors of a block of candidates, and of queries; a block's matrix has at most BLOCK_BYTES.
BLOCK, QUERY_BLOCK, BLOCK_BYTES = 8192, 1024, 32 << 20
#: Blocks of queries that a cell of the grid holds, and of candidates that it reads one after another; either on average.
HELD, READ = 16, 16


def integer_vectors(rows: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of the vectors that take part."""
    x = F.col(vector)
    whole = ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    kept = rows.filter(F.col(id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole)
    return kept.select(F.col(id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def blocked(rows: DataFrame, block: int, slices: int) -> DataFrame:
    """Rows (id, v[, cutoff, levels]) in blocks of one vector length: (number, dim, ids, parts, cutoffs, levels), written.

    parts holds the matrix of each slice.
    """
    with_cutoff = "cutoff" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            ids = np.array([p[0] for p in part], np.int64)
            matrix = np.stack([p[1] for p in part])
            cut = np.array([LOWEST if p[2] is None else p[2] for p in part], np.int64)
            levels = np.array([p[3] or [0] * slices for p in part], np.int64)
            parts = [np.ascontiguousarray(matrix[:, s::slices]).tobytes() for s in range(min(slices, dim))]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([parts], pa.list_(pa.binary())), *(pa.array([x.tobytes()], pa.binary()) for x in (cut, levels))],
                names=["dim", "ids", "parts", "cutoffs", "levels"],
            )

        for batch in batches:
            more = (batch.column(2).to_pylist(), batch.column(3).to_pylist()) if with_cutoff else ([None] * len(batch),) * 2
            for i, v, c, low in zip(batch.column(0).to_pylist(), batch.column(1), *more, strict=True):
                values = v.values.to_numpy(zero_copy_only=False).astype(np.int64)
                held.setdefault(len(values), []).append((i, values, c, low))
                if len(held[len(values)]) >= min(block, max(1, BLOCK_BYTES // (8 * len(values)))):
                    yield out(len(values))
        for dim in list(held):
            yield out(dim)

    found = rows.mapInArrow(pack, "dim int, ids binary, parts array<binary>, cutoffs binary, levels binary")
    return stage(found.select(F.monotonically_increasing_id().alias("number"), "*"), "blocks")


#: Of a query for which fewer than k candidates were gathered.
LOWEST = -(1 << 62)


CELL = ["dim", "row", "col", "slice"]


def cells(candidates: DataFrame, queries: DataFrame, slices: int, entries: DataFrame | None = None) -> DataFrame:
    """The grid in which blocks meet, sorted so that a cell's queries come first.

    Blocks of queries are dealt to rows and go to all columns, blocks of candidates to columns and to all rows, so a block of
    candidates is sent once for some HELD blocks of queries, and no row holds two matrices.  A task keeps a cell's queries
    and reads its candidates one by one.  Each slice has cells of its own; with ``entries`` blocks stay whole, and a
    candidate is followed by its entries, by query.
    """
    asks, blocks = queries.count(), candidates.count()
    rows = -(-asks // HELD) or 1
    spread = -(-queries.sparkSession.sparkContext.defaultParallelism // (rows * slices))
    cols = max(-(-blocks // READ), min(blocks, spread), 1)
    place = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("long")
    asked = queries.select("dim", place("number", rows).alias("row"), every(cols).alias("col"), F.lit(0).alias("side"), none.alias("c"), F.col("number").alias("q"), "ids", "parts", "cutoffs", "levels")
    own = candidates.select("dim", every(rows).alias("row"), place("number", cols).alias("col"), F.lit(1).alias("side"), F.col("number").alias("c"), none.alias("q"), "ids", "parts")
    both = asked.unionByName(own, allowMissingColumns=True)
    if entries is None:
        fields = [c for c in both.columns if c != "parts"]
        both = both.select(*fields, F.size("parts").alias("nodes"), F.posexplode("parts").alias("slice", "matrix"))
        return both.repartition(*CELL).sortWithinPartitions(*CELL, "side", "c", "q")
    found = entries.select("dim", place("q", rows).alias("row"), place("c", cols).alias("col"), F.lit(1).alias("side"), "c", "q", "slice", "q_at", "c_at", "partial")
    return both.unionByName(found, allowMissingColumns=True).repartition(*CELL[:3]).sortWithinPartitions(*CELL[:3], "side", "c", "q", "slice")  # nulls, the blocks, come first


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield dict(zip(batch.schema.names, row, strict=True))


def _kept(row: dict) -> dict:
    """A copy, as a value of a batch keeps the whole batch."""
    return {name: pa.scalar(value.as_py(), value.type) for name, value in row.items()}


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """(query block, candidate block) of each cell."""
    cell, held = None, []
    for row in _columns(batches):
        here = tuple(row[c].as_py() for c in CELL)
        if here != cell:
            cell, held = here, []
        if row["side"].as_py() == 0:
            held.append(_kept(row))
        else:
            yield from ((q, row) for q in held)


def _matrix(ids: np.ndarray, data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.int64).reshape(len(ids), -1)


def _kind(q: np.ndarray, c: np.ndarray) -> type:
    """Of numbers in which the products are exact."""
    return np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2.0**53 else np.int64


ENTRIES = "dim int, q long, c long, slice int, q_at binary, c_at binary, partial binary, levels binary, multiplied long, sent long"


def _entries(q: dict, c: dict, a: np.ndarray, b: np.ndarray, partial: np.ndarray, levels: np.ndarray, multiplied: int) -> pa.RecordBatch:
    blobs = [x.astype(kind).tobytes() for x, kind in ((a, np.int32), (b, np.int32), (partial, np.int64), (levels, np.int64))]
    columns = [pa.array([x.as_py()], t) for x, t in ((c["dim"], pa.int32()), (q["q"], pa.int64()), (c["c"], pa.int64()), (c["slice"], pa.int32()))] + [pa.array([x], pa.binary()) for x in blobs]
    return pa.RecordBatch.from_arrays([*columns, pa.array([multiplied], pa.int64()), pa.array([len(a)], pa.int64())], names=[x.split()[0] for x in ENTRIES.split(", ")])


def gathered(grid: DataFrame, length: int) -> DataFrame:
    """ENTRIES: each slice's ``length`` best of a block for each query; levels has its least partial scores."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, own in _meetings(batches):
            ids, q_ids = (np.frombuffer(x["ids"].as_py(), np.int64) for x in (own, asked))
            c, q = _matrix(ids, own["matrix"]), _matrix(q_ids, asked["matrix"])
            kind = _kind(q, c)
            p = q.astype(kind) @ c.astype(kind).T
            low = p.min(axis=1)
            same = q_ids[:, None] == ids[None, :]
            p[same] = -np.inf if kind is np.float64 else LOWEST
            m = min(length, p.shape[1])
            b = np.argpartition(p, p.shape[1] - m, axis=1)[:, p.shape[1] - m :]
            a = np.repeat(np.arange(len(q)), m)
            keep = ~same[a, b.ravel()]
            a, b = a[keep], b.ravel()[keep]
            yield _entries(asked, own, a, b, p[a, b], low, p.size)

    return grid.mapInArrow(gather, ENTRIES)


def collected(grid: DataFrame, slices: int) -> DataFrame:
    """ENTRIES: those that exceed their slice's level by the uniform share."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, own in _meetings(batches):
            ids, q_ids, cut = (np.frombuffer(x.as_py(), np.int64) for x in (own["ids"], asked["ids"], asked["cutoffs"]))
            c, q = _matrix(ids, own["matrix"]), _matrix(q_ids, asked["matrix"])
            levels = np.frombuffer(asked["levels"].as_py(), np.int64).reshape(len(q), slices)
            nodes = min(slices, own["nodes"].as_py())
            share = (cut.astype(float) - levels[:, :nodes].astype(float).sum(1)) / nodes
            least = levels[:, own["slice"].as_py()] + share - 1e-6 * np.abs(share) - 1e-6
            # no partial score is above the product of the two lengths
            long, reach = np.sqrt((c.astype(float) ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1))
            wanted = np.divide(least, reach, out=np.where(least > 0, np.inf, 0.0), where=(least > 0) & (reach > 0))
            wanted = np.flatnonzero(long * (1 + 1e-9) >= wanted.min())
            c, kind = c[wanted], _kind(q, c)
            p = q.astype(kind) @ c.astype(kind).T
            a, b = np.nonzero((p >= least[:, None]) & (q_ids[:, None] != ids[wanted][None, :]))
            yield _entries(asked, own, a, wanted[b], p[a, b], np.empty(0), p.size)

    return grid.mapInArrow(collect, ENTRIES)


def resolved(entries: DataFrame, candidates: DataFrame, queries: DataFrame, slices: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): whole scores of the entries, at most k a query and block, from its cutoff up.

    The entries of a block's slices meet in the grid, and only the partial scores that they lack are computed.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(asked: dict, own: dict, found: list[dict]) -> pa.RecordBatch:
            ids, q_ids, cut = (np.frombuffer(x.as_py(), np.int64) for x in (own["ids"], asked["ids"], asked["cutoffs"]))
            lists = [(r["slice"].as_py(), *(np.frombuffer(r[n].as_py(), t) for n, t in (("q_at", np.int32), ("c_at", np.int32), ("partial", np.int64)))) for r in found]
            lists = [(s, a.astype(np.int64) * len(ids) + b, partial) for s, a, b, partial in lists]
            key = np.unique(np.concatenate([x[1] for x in lists]))
            a, b, score = key // len(ids), key % len(ids), np.zeros(len(key), np.int64)
            for s, (x, y) in enumerate(zip(own["parts"], asked["parts"], strict=True)):
                missing = np.ones(len(key), bool)
                for slice, pairs, partial in lists:
                    if slice == s:
                        at = np.searchsorted(key, pairs)
                        score[at] += partial
                        missing[at] = False
                c, q, at = _matrix(ids, x), _matrix(q_ids, y), np.flatnonzero(missing)
                for some in np.array_split(at, len(at) * c.shape[1] // (1 << 21) + 1):
                    score[some] += np.einsum("ij,ij->i", q[a[some]], c[b[some]])
            keep = score >= cut[a]
            a, b, score = a[keep], b[keep], score[keep]
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            keep = np.arange(len(a)) - np.searchsorted(a, np.arange(len(q_ids)))[a] < k
            return pa.RecordBatch.from_arrays([pa.array(q_ids[a[keep]]), pa.array(ids[b[keep]]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

        cell, held, own, found = None, {}, None, []
        for row in _columns(batches):
            here = tuple(row[c].as_py() for c in CELL[:3])
            c, q = row["c"].as_py(), row["q"].as_py()
            if found and (here, c, q) != (cell, found[0]["c"].as_py(), found[0]["q"].as_py()):
                yield scored(held[found[0]["q"].as_py()], own, found)
                found = []
            if here != cell:
                cell, held = here, {}
            if row["side"].as_py() == 0:
                held[q] = _kept(row)
            elif q is None:
                own = row
            else:
                found.append(row)
        if found:
            yield scored(held[found[0]["q"].as_py()], own, found)

    return cells(candidates, queries, slices, entries.filter("sent > 0")).mapInArrow(resolve, "query_id long, vec_id long, score long")


def cutoffs(scores: DataFrame, k: int) -> DataFrame:
    """(id, cutoff): the k-th best of a query's scores; null with fewer."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = scores.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    return kth.groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.col("n") == k, F.col("score"))).alias("cutoff"))


def levels(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, levels): each slice's least partial score for a query.  The share is right with any levels."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, low, ids in zip(*batch.columns, strict=True):
                q = np.frombuffer(ids.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), s.as_py(), np.int32)), pa.array(np.frombuffer(low.as_py(), np.int64))], names=["id", "slice", "low"])

    rows = entries.select("q", "slice", "levels").join(queries.select(F.col("number").alias("q"), "ids"), "q").select("slice", "levels", "ids")
    least = rows.mapInArrow(opened, "id long, slice int, low long").groupBy("id", "slice").agg(F.min("low").alias("low"))
    return least.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slice", "low"))), lambda x: x["low"]).alias("levels"))


def phases(rows: DataFrame, is_query: Column, k: int, id: str, vector: str, scale: float, slices: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what phase 1 gathered, what phase 2 collected, what phase 3 resolved)."""
    candidates = blocked(integer_vectors(rows, id, vector, scale), BLOCK, slices)
    # a repeated query id asks once, with its least vector
    asked = stage(integer_vectors(rows.filter(is_query), id, vector, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    first = blocked(asked, QUERY_BLOCK, slices)
    blocks = candidates.count()
    best = stage(gathered(cells(candidates, first, slices), min(k, max(2, -(-4 * k // max(blocks, 1))))), "gathered")
    cut = cutoffs(resolved(best, candidates, first, slices, k), k)
    low = levels(best, first).withColumn("levels", F.expr(f"transform(sequence(0, {slices - 1}), s -> coalesce(get(levels, s), 0))"))
    second = blocked(asked.join(cut, "id", "left").join(low, "id", "left").select("id", "v", "cutoff", "levels"), QUERY_BLOCK, slices)
    found = stage(collected(cells(candidates, second, slices), slices), "collected")
    return best, found, resolved(found, candidates, second, slices, k)


def work(gathered: DataFrame, collected: DataFrame) -> DataFrame:
    """(phase, multiplied, sent): partial scores that were computed, and entries that were sent."""
    return reduce(DataFrame.union, [f.groupBy().agg(F.lit(n).alias("phase"), F.sum("multiplied").alias("multiplied"), F.sum("sent").alias("sent")) for n, f in (("gather", gathered), ("collect", collected))])


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, slices: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which ``is_query`` holds."""
    *_, found = phases(rows, is_query, k, id, vector, scale, slices)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
