"""Substring deduplication with fixed-block anchors.

A window is ``width`` consecutive words of one text.  A word goes when some
window that covers it also starts in a document with a smaller id.

1. *Index and probe.*  Every reference text is cut into non-overlapping blocks of
   ``(width + 1) // 2`` words; any window holds exactly one or more whole
   blocks.  The blocks are the index; every rolling window of block length of
   every text probes it.  A pack of texts (see ``packs``) asks once for each of its
   block hashes (4 bytes and a mark for indexed ones); where a hash meets, it is a hit
   if it is indexed and occurs more than once, and each pack gets its hits back as bits.
2. *Extend.*  Around each hit the text is extended to all windows of ``width``
   words that hold it.  A pack sends each of them once, with the smallest id of its
   own documents that hold it; where the minima meet, each pack learns which windows
   start in a smaller document elsewhere.  Overlapping windows together cover the
   maximal exact repeats, which ``repeats`` returns as spans.

A window that a third of all documents share is one entry a pack, and never a pair
of documents.  There is no cap on hits, nothing is broadcast and nothing is gathered on
the driver.  Windows are compared by 64 bits of one hash and the bucket's bits of
another, so the more texts, the more bits: 81 at 100 TB.

Edge cases: a null or short text has no windows and keeps all its words; rows
that repeat an id are one document each with equal results for equal texts, and
an id is never smaller than itself; a null id is smaller than none, and such a
row loses nothing; a very long text is a pack of its own, read as a whole; an empty
table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import SECOND, WordHashes, binary_rows, bucket_of, stage
from cipherscape.llm.packs import Words, answers, buckets_for, by_pack, exchanged, freed, marks, packed, planes_of, short_hashes, text_column, unpacked


def block_length(width: int) -> int:
    return (width + 1) // 2


@dataclass
class Blocks:
    """The rolling blocks of a pack: distinct hashes in order, and for each block its place and hash."""

    hashes: np.ndarray
    of: np.ndarray
    at: np.ndarray

    @classmethod
    def read(cls, words: Words, width: int) -> Blocks:
        found, at = words.windows(block_length(width))
        hashes, of = np.unique(found, return_inverse=True)
        return cls(hashes, of, at)

    def indexed(self, words: Words, width: int) -> np.ndarray:
        """Of the distinct hashes, those of a block on its text's grid."""
        out = np.zeros(len(self.hashes), bool)
        out[self.of[(self.at - words.starts[words.doc[self.at]]) % block_length(width) == 0]] = True
        return out


def anchor_hits(packs: DataFrame, width: int, text: str, buckets: int) -> DataFrame:
    """ANSWER rows: the blocks of each pack that are indexed and occur more than once anywhere."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for pack, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = Words(text_column(unpacked(data.as_buffer()), text), known)
                blocks = Blocks.read(words, width)
                indexed, several = blocks.indexed(words, width), np.bincount(blocks.of, minlength=len(blocks.hashes)) > 1
                rows = [(pack, b, h, np.packbits(np.stack((indexed[s], several[s]))).tobytes()) for b, s, h in short_hashes(blocks.hashes, buckets)]
                yield binary_rows(["pack", "bucket", "hashes", "flags"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    def met(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint32) for x in group.column("hashes")]
        sizes = [len(p) for p in parts]
        flags = np.concatenate([planes_of(y.as_py(), n, 2) for y, n in zip(group.column("flags"), sizes, strict=True)], 1)
        _, of, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        indexed = np.bincount(of[flags[0]], minlength=len(count)) > 0
        several = (count > 1) | (np.bincount(of[flags[1]], minlength=len(count)) > 0)
        return answers(group.column("pack").to_pylist(), key[0].as_py(), sizes, (indexed & several)[of])

    return exchanged(packs.select("pack", "data"), sent, ["hashes", "flags"], met, buckets)


@dataclass
class Entries:
    """The windows of a pack that hold a hit.

    ``at`` and ``doc`` are a window's first word and text, ``of`` its entry.  An entry is a distinct
    window: its bucket, hash and the smallest id in the pack, in order of bucket and document.
    """

    at: np.ndarray
    doc: np.ndarray
    of: np.ndarray
    bucket: np.ndarray
    hash: np.ndarray
    least: np.ndarray

    @classmethod
    def read(cls, words: Words, blocks: Blocks, hit: np.ndarray, ids: np.ndarray, valid: np.ndarray, width: int, buckets: int) -> Entries:
        found, at = words.windows(width)
        starts = np.zeros(len(words.hashes) + 2, np.int32)
        starts[blocks.at[hit[blocks.of]] + 1] = 1
        before = np.cumsum(starts)
        doc = words.doc[at]
        held = np.flatnonzero((before[at + width - block_length(width) + 1] > before[at]) & valid[doc])
        at, doc, found = at[held], doc[held], found[held]
        bucket = bucket_of(words.windows(width, SECOND)[0][held], buckets)
        order = np.lexsort((ids[doc], found))
        new = np.ones(len(order), bool)
        new[1:] = (found[order][1:] != found[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        first = order[new]  # the smallest id comes first
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        sent = np.argsort((bucket[first].astype(np.int64) << 32) | doc[first], kind="stable")  # equal ids in a row compress
        place = np.empty(len(sent), np.int64)
        place[sent] = np.arange(len(sent))
        first = first[sent]
        return cls(at, doc, place[of], bucket[first], found[first], ids[doc[first]])


@dataclass
class Reader:
    """How a pack is read; what a task needs to know."""

    width: int
    id: str
    text: str
    buckets: int

    def entries(self, batch: pa.RecordBatch, hits: list[dict] | None, known: WordHashes) -> tuple[Words, Entries, np.ndarray]:
        """The words of a pack, its entries and its ids."""
        words = Words(text_column(batch, self.text), known)
        blocks = Blocks.read(words, self.width)
        hit = marks(hits, bucket_of(blocks.hashes, self.buckets))[0]
        column = batch.column(self.id)
        ids, valid = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        return words, Entries.read(words, blocks, hit, ids, valid, self.width, self.buckets), ids

    def gone(self, batch: pa.RecordBatch, hits: list[dict] | None, earlier: list[dict] | None, known: WordHashes) -> list[np.ndarray | None]:
        """For each row which of its words go; None if none does."""
        if not hits:
            return [None] * len(batch)
        words, entries, ids = self.entries(batch, hits, known)
        start = entries.at[marks(earlier, entries.bucket)[0][entries.of] | (ids[entries.doc] > entries.least[entries.of])]
        edge = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        hurt = np.bincount(words.doc[start], minlength=len(batch)) > 0
        return [covered[s : s + n] if h else None for s, n, h in zip(words.starts, words.counts, hurt, strict=True)]


def earlier_windows(packs: DataFrame, hits: DataFrame, reader: Reader) -> DataFrame:
    """ANSWER rows: the entries of each pack that also start in a document with a smaller id than the pack has."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for pack, data, hit in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                _, entries, _ = reader.entries(unpacked(data.as_buffer()), hit.as_py(), known)
                cuts = np.flatnonzero(np.diff(entries.bucket, prepend=-1)).tolist()
                rows = [
                    (pack, int(entries.bucket[s]), entries.hash[s:e].tobytes(), entries.least[s:e].tobytes())
                    for s, e in zip(cuts, [*cuts[1:], len(entries.bucket)][: len(cuts)], strict=True)
                ]
                yield binary_rows(["pack", "bucket", "hashes", "least"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)

    def judged(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        least = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("least")])
        _, of, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order = np.argsort(of, kind="stable")
        smallest = np.minimum.reduceat(least[order], np.cumsum(count) - count)
        return answers(group.column("pack").to_pylist(), key[0].as_py(), [len(p) for p in parts], smallest[of] < least)

    asking = packs.select("pack", "data").join(by_pack(hits, "hits"), "pack").select("pack", "data", "hits")
    return exchanged(asking, sent, ["hashes", "least"], judged, reader.buckets)


def with_answers(docs: DataFrame, width: int, id: str, text: str) -> tuple[DataFrame, Reader]:
    """(data, hits, earlier) of every pack of ``docs``, and the reader that finds a pack's repeats in them."""
    packs = packed(docs, text)
    reader = Reader(width, id, text, buckets_for(packs))
    hits = stage(anchor_hits(packs, width, text, reader.buckets), "hits")
    earlier = stage(earlier_windows(packs, hits, reader), "earlier")
    found = packs.join(by_pack(hits, "hits"), "pack", "left").join(by_pack(earlier, "earlier"), "pack", "left")
    return found.select("data", "hits", "earlier"), reader


def _spans(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    return b" ".join([w for w, g in zip(text.split(), gone.tolist(), strict=True) if not g])


def substring_digest(docs: DataFrame, width: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, repeats): what stays of each text, and the spans of words that go."""
    rows, reader = with_answers(docs.select(id, text), width, id, text)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for packs in batches:
            for data, hits, earlier in zip(*packs.columns, strict=True):
                batch, out = unpacked(data.as_buffer()), []
                for value, gone in zip(text_column(batch, text), reader.gone(batch, hits.as_py(), earlier.as_py(), known), strict=True):
                    words = value.split()
                    spans = [] if gone is None else _spans(gone)
                    kept = b" ".join(words) if gone is None else _kept(value, gone)
                    out.append((len(words), sum(e - s for s, e in spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in spans]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(id), *columns], names=[id, "n_words", "n_removed", "kept_sha256", "repeats"])

    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(lambda batches: freed(digest(batches)), f"`{id}` {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,stop:int>>")


def without_repeats(docs: DataFrame, width: int = 13, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated words cut from ``text``.

    A text that loses nothing stays as it is; of the others the kept words are
    joined by one space, and a text that loses every word becomes empty.
    """
    (rows, reader), place = with_answers(docs, width, id, text), docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for packs in batches:
            for data, hits, earlier in zip(*packs.columns, strict=True):
                batch = unpacked(data.as_buffer())
                gone = reader.gone(batch, hits.as_py(), earlier.as_py(), known)
                if any(g is not None for g in gone):
                    texts = [t.as_py() if g is None else _kept(t.as_py().encode(), g).decode() for t, g in zip(batch.column(place), gone, strict=True)]
                    columns = batch.columns
                    columns[place] = pa.array(texts, batch.schema.field(place).type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return rows.mapInArrow(lambda batches: freed(cut(batches)), docs.schema)
