"""Rows in packs: many texts as one Arrow stream, and questions and answers by bucket.

Operators that compare hashes of all texts with each other read the texts more than
once and must find the same texts again when an answer comes back.  ``packed`` writes
the rows once, several megabytes of text to a pack, compressed, with all their
columns.  A pack asks by bucket: one entry for each distinct hash, in an order
that it can make again.  A bucket answers with one bit an entry, keyed by the pack.
Nothing is gathered on the driver and nothing broadcast, so there is no table
of hashes that fills up as the corpus grows.

A hash that a third of all texts hold is one entry a pack, not one a text.

There is a bucket for each few million entries, so their number grows with the corpus.
A pack sends a row for each bucket only while there are few; beyond that it sends a row
for each *part* (a range of buckets), and tasks that hold many packs' rows of a part deal
them out to its buckets (``exchanged``).  Rows then grow with the entries, not with packs times buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import FIRST, WordHashes, by_bucket, power_of_two, rest_of, stage, windows

#: Bytes of text in a pack, about; a longer text is a pack of its own.  A task works on one pack at a time and
#: needs some 40 times as much memory; larger packs ask less often for what their texts share.
PACK_BYTES = 3 << 20
#: Entries a bucket gets, about.
PER_BUCKET = 4_000_000
#: Rows a pack sends, at most, and gets back.
PARTS = 512
#: Bytes of many packs' rows that a task deals out to the buckets of a part at a time, about.
BUNDLE_BYTES = 16 << 20
#: Buckets for which the packs' rows of a part go to one place, by a number drawn from the pack; a part of more is several places.
PLACE_BUCKETS = 2048


def packed(docs: DataFrame, text: str) -> DataFrame:
    """(pack, size, data): the rows of ``docs``, written; size is the bytes of their texts."""
    at = docs.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as stream:
                stream.write_table(whole, max_chunksize=max(1, len(whole)))
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["size", "data"])

        for batch in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start, before = 0, 0
            while start < len(batch):
                stop = min(len(batch), int(np.searchsorted(lengths, before + PACK_BYTES - size)) + 1)
                held.append(batch.slice(start, stop - start))
                size += int(lengths[stop - 1]) - before
                start, before = stop, int(lengths[stop - 1])
                if size >= PACK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows = docs.mapInArrow(lambda batches: freed(pack(batches)), "size long, data binary")
    return stage(rows.select(F.monotonically_increasing_id().alias("pack"), "size", "data"), "packs")


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def freed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows; what a task has freed goes back to the system at its end, as Spark keeps its workers."""
    yield from rows
    pa.default_memory_pool().release_unused()


def text_column(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    """The texts as UTF-8; a null one is empty."""
    for value in batch.column(text).cast(pa.binary()):
        yield value.as_py() or b""


def buckets_for(packs: DataFrame) -> int:
    """Buckets for about one entry a word, by sixths of the bytes; it never changes a result."""
    size = packs.agg(F.sum("size").alias("n")).first()["n"] or 0
    return power_of_two(size / 6 / PER_BUCKET, least=16, most=1 << 30)


class Words:
    """The word hashes of a pack's texts, one text after another."""

    def __init__(self, texts: Iterable[bytes], words: WordHashes):
        parts = [words.of(t.split()) for t in texts]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), self.counts)
        self.starts = np.cumsum(self.counts) - self.counts

    def windows(self, width: int, base: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, place of the first word) of the windows that lie in one text."""
        found = windows(self.hashes, width, base)
        at = np.flatnonzero(self.doc[: len(found)] == self.doc[width - 1 : width - 1 + len(found)]) if len(found) else np.empty(0, np.int64)
        return found[at], at


# -- answers -----------------------------------------------------------------------


def bits(*planes: np.ndarray) -> bytes:
    return np.packbits(np.concatenate(planes)).tobytes()


def planes_of(data: bytes, count: int, planes: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count * planes).reshape(planes, count).astype(bool)


def answers(packs: list[int], bucket: int, sizes: list[int], *planes: np.ndarray) -> pa.Table:
    """(pack, bucket, bits) of the packs that some entry's bit is set for; entries lie pack by pack."""
    out, at = [], 0
    for pack, n in zip(packs, sizes, strict=True):
        own = [p[at : at + n] for p in planes]
        if any(p.any() for p in own):
            out.append((pack, bits(*own)))
        at += n
    return pa.table({
        "pack": pa.array([p for p, _ in out], pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int32()), "bits": pa.array([b for _, b in out], pa.binary()),
    })


ANSWER = "pack long, answers array<struct<bucket:int,bits:binary>>"
REPLY = pa.struct([("bucket", pa.int32()), ("bits", pa.binary())])


def by_pack(answered: DataFrame, name: str = "marks") -> DataFrame:
    """(pack, name): a pack's answers, of which it has at most one a bucket."""
    return answered.groupBy("pack").agg(F.flatten(F.collect_list("answers")).alias(name))


def marks(replies: list[dict] | None, bucket: np.ndarray, planes: int = 1) -> np.ndarray:
    """The answered bits of all entries, whose buckets are given in order; what wasn't answered is False."""
    out = np.zeros((planes, len(bucket)), bool)
    for r in replies or ():
        s, e = np.searchsorted(bucket, [r["bucket"], r["bucket"] + 1])
        out[:, s:e] = planes_of(r["bits"], int(e - s), planes)
    return out


def short_hashes(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice, bytes]]:
    """(bucket, its slice, 32 bits of each hash below those that name the bucket)."""
    for b, s in by_bucket(sorted_hashes, buckets):
        yield b, s, rest_of(sorted_hashes[s], buckets).tobytes()


# -- the way to the buckets and back -----------------------------------------------


def lists(cuts: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    """The values as lists that start at ``cuts``; ``count`` is the number of all."""
    return pa.ListArray.from_arrays(pa.array(np.append(cuts, count), pa.int32()), values)


def starts_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def flat(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([chunk.flatten() for chunk in rows.column(name).chunks])


def parents(rows: pa.Table, name: str) -> np.ndarray:
    """For each value of a column of lists, the row that holds it."""
    return np.repeat(np.arange(len(rows)), pc.list_value_length(rows.column(name)).to_numpy())


def replies(pack: np.ndarray, bucket: pa.Array, bits: pa.Array) -> pa.Table:
    """Answers of several packs as rows of ANSWER, one a pack."""
    order = np.argsort(pack, kind="stable")
    cuts = starts_of(pack[order])
    each = pa.StructArray.from_arrays([bucket.take(pa.array(order)), bits.take(pa.array(order))], fields=list(REPLY))
    return pa.table({"pack": pa.array(pack[order][cuts], pa.int64()), "answers": lists(cuts, len(order), each)})


def replied(answered: pa.Table) -> pa.Table:
    whole = answered.combine_chunks()
    return replies(whole.column("pack").to_numpy(), *(pa.concat_arrays(whole.column(c).chunks) if len(whole) else pa.array([], t) for c, t in (("bucket", pa.int32()), ("bits", pa.binary()))))


def in_parts(asked: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """A pack's rows, which come by bucket in order, as one row a part with lists of buckets and of what they get."""
    for batch in asked:
        part = batch.column("bucket").to_numpy() >> shift
        cuts = starts_of(part)
        columns = [lists(cuts, len(part), c) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([batch.column("pack").take(pa.array(cuts)), pa.array(part[cuts], pa.int32()), *columns], names=["pack", "part", *batch.schema.names[1:]])


def bundles(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``in_parts``, sorted by part and pack, as one row a bucket with lists of packs and of what they send.

    A bundle, named by its part and first pack, holds packs of one part up to ``most`` bytes.
    """

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        bucket, pack = flat(whole, "bucket").to_numpy(), whole.column("pack").to_numpy()
        order = np.argsort(bucket, kind="stable")
        cuts = starts_of(bucket[order])
        lists_of = [pa.array(pack[parents(whole, "bucket")][order], pa.int64()), *(flat(whole, c).take(pa.array(order)) for c in whole.column_names[3:])]
        first = [pa.array(np.full(len(cuts), whole.column("part")[0].as_py()), pa.int32()), pa.array(np.full(len(cuts), pack[0]), pa.int64()), pa.array(bucket[order][cuts], pa.int32())]
        return pa.RecordBatch.from_arrays([*first, *(lists(cuts, len(order), v) for v in lists_of)], names=["part", "first", "bucket", "pack", *whole.column_names[3:]])

    held, size = [], 0
    for batch in rows:
        part = batch.column("part").to_numpy()
        cuts = starts_of(part).tolist()
        for s, e in zip(cuts, [*cuts[1:], len(part)][: len(cuts)], strict=True):
            if held and (size >= most or held[0].column("part")[0].as_py() != part[s]):
                yield out(held)
                held, size = [], 0
            held.append(batch.slice(s, e - s))
            size += held[-1].nbytes
    if held:
        yield out(held)


def exchanged(packs: DataFrame, sent: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[str], met: Callable[[tuple, pa.Table], pa.Table], buckets: int) -> DataFrame:
    """ANSWER rows: what ``met`` answers, by bucket, to the rows (pack, bucket, columns) that ``sent`` makes of ``packs``.

    ``met`` gets all rows of a bucket and returns ``answers``.  With more than ``PARTS`` buckets rows go in two steps: a
    pack sends a row a part, many packs' rows of a part become one row a bucket, and the answers go back the same way.
    The bundles on the way depend on nothing but their rows, so a task that runs again makes the same.
    """
    if buckets <= PARTS:
        asked = packs.mapInArrow(lambda batches: freed(sent(batches)), f"pack long, bucket int, {', '.join(f'{c} binary' for c in columns)}")
        return asked.groupBy("bucket").applyInArrow(lambda key, group: replied(met(key, group)), ANSWER)
    shift, most, each = (buckets // PARTS).bit_length() - 1, BUNDLE_BYTES, ", ".join(f"{c} array<binary>" for c in columns)

    def in_bucket(key: tuple, group: pa.Table) -> pa.Table:
        pack, row = flat(group, "pack"), parents(group, "pack")
        table = pa.table({"pack": pack, "bucket": pa.array(np.full(len(pack), key[0].as_py()), pa.int32()), **{c: flat(group, c) for c in columns}})
        got = met(key, table).combine_chunks()
        of = row[pc.index_in(got.column("pack"), value_set=pack).to_numpy()] if len(got) else np.empty(0, np.int64)
        order = np.argsort(of, kind="stable")
        cuts, got = starts_of(of[order]), got.take(pa.array(order))
        own = group.select(["part", "first", "bucket"]).take(pa.array(of[order][cuts]))
        values = [pa.array(got.column("pack").to_numpy(), pa.int64()), pa.concat_arrays(got.column("bits").chunks) if len(got) else pa.array([], pa.binary())]
        return pa.table([*own.columns, *(lists(cuts, len(order), v) for v in values)], names=["part", "first", "bucket", "pack", "bits"])

    def back(key: tuple, group: pa.Table) -> pa.Table:
        bucket = group.column("bucket").to_numpy()[parents(group, "pack")]
        return replies(flat(group, "pack").to_numpy(), pa.array(bucket, pa.int32()), flat(group, "bits"))

    place = F.pmod(F.xxhash64("pack"), F.lit(max(1, buckets // PLACE_BUCKETS)))
    by_part = packs.mapInArrow(lambda batches: freed(in_parts(sent(batches), shift)), f"pack long, part int, bucket array<int>, {each}")
    dealt = by_part.repartition("part", place).sortWithinPartitions("part", "pack")
    bundled = dealt.mapInArrow(lambda batches: freed(bundles(batches, most)), f"part int, first long, bucket int, pack array<long>, {each}")
    answered = bundled.groupBy("bucket").applyInArrow(in_bucket, "part int, first long, bucket int, pack array<long>, bits array<binary>")
    return answered.groupBy("part", "first").applyInArrow(back, ANSWER)
