"""Similarity join of documents by the Jaccard index of their word n-grams.

Two texts link when ``100 * |A and B| >= percent * |A or B|`` for their sets of
distinct n-grams (ASCII letters lowered).  The overlaps are entries of the
product of the sparse document x n-gram incidence matrix with its transpose,
formed in blocks:

1. *Document frequencies.*  Every n-gram column is counted over all documents: a pack of
   texts (see ``packs``) asks once for each of its columns, 4 bytes each, and gets two bits
   back, whether more than one set holds it and whether it is frequent.
2. *First block.*  A size-derived bound says that two linked sets share one of
   their first ``n - ceil(t n) + 1`` columns in any common order; frequent
   columns come last in ours.  Only these columns are multiplied.  Pairs whose
   sizes, or whose places in the order, leave less than the needed overlap are
   dropped at once.
3. *Bounds by block.*  Every set counts its columns in small blocks.  Two sets share
   at most the smaller count in each block, so pairs whose sum of these is below the
   needed overlap are dropped.
4. *Remaining blocks.*  The full overlap of a surviving pair is accumulated
   from both sets, and the exact test decides.

Equal sets are one vertex from the start.  A column of many sets (a passage, a
group of near copies) isn't expanded into all pairs: first every set is tested
against one hub of its column; pairs within one component need no further test, and
a second round tests every remaining pair across components, block of rows against
block of rows.  So no link between different components is lost, and no cap is set
anywhere.  Nothing is broadcast and nothing gathered on the driver; a hot column's
rows are never one group, only counted by partial aggregates and joined.

Edge cases: a null or wordless text has the empty set and links with nothing;
fewer words than ``n`` make one shorter n-gram; repeated rows get equal results;
rows with a null id take part and get their class's smallest id (null if it has
none); a very long text is a pack of its own and one set like others; an empty table
gives an empty result; further columns are ignored, whatever their names.  Sets and
n-grams are compared by 64-bit hashes: among 3e10 different sets some 24 pairs are
expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from cipherscape.llm.common import WordHashes, ascii_lower, binary_rows, bucket_of, stage, windows
from cipherscape.llm.packs import answers, buckets_for, by_pack, exchanged, freed, marks, packed, short_hashes, text_column, unpacked

#: A column of more sets than this comes last in the order of columns.
FREQUENT = 12


def shingle_set(text: bytes | None, n: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    if not text:
        return np.empty(0, np.uint64)
    h = words.of(ascii_lower(text).split())
    if not len(h):
        return h
    # a shorter text is one n-gram; its width goes into the hash
    return np.unique(windows(h, n)) if len(h) >= n else windows(h, len(h)) + np.uint64(len(h))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap with which sets of these sizes link."""
    return -((-(a + b) * percent) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Columns of which two linked sets must share one: all but the least overlap with any partner, plus one."""
    return n - (-(-n * percent // 100)) + 1


def column_marks(packs: DataFrame, n: int, text: str, buckets: int) -> DataFrame:
    """ANSWER rows: of each pack's columns, those that two sets or more hold, and those that over FREQUENT hold."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for pack, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sets = distinct_sets(text_column(unpacked(data.as_buffer()), text), n, words)
                columns, counts = np.unique(np.concatenate([NO_COLUMN, *sets.values()]), return_counts=True)
                rows = []
                for b, s, rest in short_hashes(columns, buckets):
                    more = np.flatnonzero(counts[s] > 1)
                    rows.append((pack, b, rest, more.astype(np.uint32).tobytes(), counts[s][more].astype(np.uint32).tobytes()))
                yield binary_rows(["pack", "bucket", "columns", "more", "counts"], [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], rows)

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        columns, counts = [], []
        for x, y, z in zip(group.column("columns"), group.column("more"), group.column("counts"), strict=True):
            columns.append(np.frombuffer(x.as_py(), np.uint32))
            counts.append(np.ones(len(columns[-1]), np.int64))
            counts[-1][np.frombuffer(y.as_py(), np.uint32)] = np.frombuffer(z.as_py(), np.uint32)
        _, of = np.unique(np.concatenate(columns), return_inverse=True)
        total = np.bincount(of, np.concatenate(counts))[of]
        return answers(group.column("pack").to_pylist(), key[0].as_py(), [len(c) for c in columns], total > 1, total > FREQUENT)

    return exchanged(packs.select("pack", "data"), sent, ["columns", "more", "counts"], counted, buckets)


NO_COLUMN = np.empty(0, np.uint64)


def distinct_sets(texts: Iterable[bytes], n: int, words: WordHashes) -> dict[int, np.ndarray]:
    """The different sets of a pack by id."""
    out = {}
    for t in texts:
        shingles = shingle_set(t, n, words)
        if len(shingles):
            out.setdefault(set_id(shingles), shingles)
    return out


#: A column of more sets than this goes by way of a hub first.
SHORT = 24
#: Rows of a long column that meet as many others in one task.
BLOCK_ROWS = 4096


def read_once(packs: DataFrame, n: int, percent: int, id: str, text: str, id_type: DataType, buckets: int) -> DataFrame:
    """Rows of two kinds from one pass over the packs.

    With a column: an entry of the first block of the incidence matrix, as its column and its
    set's id, size, place and number of frequent columns.  Without: a row of the input, as its
    pack and place, id, n_shingles, sid and counts by block.
    """
    names = ["pack", "at", id, "n_shingles", "blocks", "sid", "column", "size", "place", "weight"]
    kinds = [pa.int64(), pa.int32(), to_arrow_type(id_type), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for pack, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own, sets, keys, sizes, blocks = unpacked(data.as_buffer()), {}, [], [], []
                for t in text_column(own, text):
                    shingles = shingle_set(t, n, words)
                    key = set_id(shingles) if len(shingles) else None
                    keys.append(key)
                    sizes.append(len(shingles))
                    blocks.append(block_counts(shingles).tobytes())
                    if key is not None:
                        sets.setdefault(key, shingles)
                k = len(own)
                rows = [pa.array([pack] * k, kinds[0]), pa.array(range(k), kinds[1]), own.column(id), pa.array(sizes, kinds[3]), pa.array(blocks, kinds[4]), pa.array(keys, kinds[5])]
                yield pa.RecordBatch.from_arrays([*rows, *(pa.nulls(k, t) for t in kinds[6:])], names=names)
                columns, of = np.unique(np.concatenate([NO_COLUMN, *sets.values()]), return_inverse=True)
                shared, frequent = marks(found.as_py(), bucket_of(columns, buckets), 2)[:, of]
                parts, at = [], 0
                for key, shingles in sets.items():
                    both, late = shared[at : at + len(shingles)], frequent[at : at + len(shingles)]
                    at += len(shingles)
                    first = first_places(shingles, late, prefix_length(len(shingles), percent))
                    keep = np.flatnonzero(both[first])
                    if len(keep):
                        parts.append((np.full(len(keep), key), shingles[first[keep]].view(np.int64), np.full(len(keep), len(shingles)), keep, np.full(len(keep), late.sum())))
                if parts:
                    entries = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), kinds[5:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(entries[0]), t) for t in kinds[:5]), *entries], names=names)

    return packs.mapInArrow(lambda batches: freed(sent(batches)), f"pack long, at int, `{id}` {id_type.simpleString()}, n_shingles long, blocks binary, sid long, column long, size int, place int, weight int")


def first_places(shingles: np.ndarray, late: np.ndarray, length: int) -> np.ndarray:
    """Where the first ``length`` columns of a set lie; frequent columns come last."""
    early = np.flatnonzero(~late)
    first = early[first_columns(shingles[early], length)]
    if len(first) < length:
        rest = np.flatnonzero(late)
        first = np.concatenate((first, rest[first_columns(shingles[rest], length - len(first))]))
    return first


def first_columns(shingles: np.ndarray, length: int) -> np.ndarray:
    """Places of the first ``length`` columns in an order of all columns that has nothing to do with their buckets."""
    order = shingles * np.uint64(0xC2B2AE3D27D4EB4F)  # odd, so no two columns have one place
    if length < len(order):
        some = np.argpartition(order, length - 1)[:length] if length else np.empty(0, np.int64)
        return some[np.argsort(order[some])]
    return np.argsort(order)


def block_counts(shingles: np.ndarray) -> np.ndarray:
    """How many columns of a set lie in each of about a quarter as many blocks of the range of hashes."""
    bits = max(0, (len(shingles) // 4).bit_length() - 1)
    if not bits:
        return np.array([len(shingles)], np.uint16)
    return np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def most_shared(p: np.ndarray, q: np.ndarray) -> int:
    """The most columns that sets with these counts can share; the finer counts are summed up to the coarser."""
    if len(p) > len(q):
        p, q = q, p
    return int(np.minimum(p, q.reshape(len(p), -1).sum(1)).sum())


def bounded(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the counts by block leave possible."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint16), np.frombuffer(y.as_py(), np.uint16)
                keep.append(most_shared(p, q) >= needed(int(p.sum()), int(q.sum()), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(counts.toDF("a", "pa"), "a").join(counts.toDF("b", "pb"), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(lambda batches: freed(kept(batches)), "a long, b long")


def shared_columns(entries: DataFrame) -> DataFrame:
    """Entries of columns that two sets or more hold: (column, sid, size, place, length, hub).

    length is the number of the column's sets; hub is its set (sid, size, place) with most frequent
    columns for its size.  Counts and hubs are partial aggregates, joined back by column; Spark
    splits a hot column's rows.
    """
    once = entries.groupBy("column", "sid").agg(*[F.first(c).alias(c) for c in ("size", "place", "weight")])  # a set that several packs sent
    once = stage(once, "entries")
    central = F.max_by(F.struct("sid", "size", "place"), F.struct(F.col("weight") / F.col("size"), "sid"))
    of = once.groupBy("column").agg(F.count("*").alias("length"), central.alias("hub")).filter("length > 1")
    return once.drop("weight").join(of, "column")


def _need(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((a + b) * percent / (100 + percent))


def _possible(a: tuple[str, str], b: tuple[str, str], percent: int) -> Column:
    """Whether (size, place) of two entries of one column leave enough overlap for a link."""
    (size, place), (other, there) = map(F.col, a), map(F.col, b)
    need = _need(size, other, percent)
    return (F.least(size - place, other - there) >= need) & (F.least(size, other) >= need)


def _pair() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def hub_pairs(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b): every set of a long column with the column's hub, where sizes and places allow a link."""
    rows = columns.filter((F.col("length") > SHORT) & (F.col("sid") != F.col("hub.sid"))).filter(_possible(("size", "place"), ("hub.size", "hub.place"), percent))
    return rows.select(F.col("sid").alias("a"), F.col("hub.sid").alias("b")).select(*_pair()).distinct()


def short_pairs(columns: DataFrame, percent: int) -> DataFrame:
    """(a, b): all possible pairs of sets of one column of at most SHORT."""
    rows = columns.filter(F.col("length") <= SHORT)
    one = rows.select("column", F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    two = rows.select("column", F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"))
    both = one.join(two, "column").filter((F.col("a") < F.col("b")) & _possible(("size_a", "place_a"), ("size_b", "place_b"), percent))
    return both.select("a", "b").distinct()


def long_pairs(columns: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b): all possible pairs of sets of one long column whose components differ.

    One of the two is outside the column's largest component, so those rows meet all rows of the
    column, a block of at most about BLOCK_ROWS of the one with a block of the other.
    """
    rows = columns.filter(F.col("length") > SHORT).select("column", "sid", "size", "place").join(labels, "sid", "left")
    rows = stage(rows.withColumn("label", F.coalesce("label", "sid")), "labelled")
    each = rows.groupBy("column", "label").agg(F.count("*").alias("n"))
    mixed = each.groupBy("column").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most")
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("long")
    mixed = mixed.select("column", "top", blocks(F.col("n")).alias("right"), blocks(F.col("n") - F.col("most")).alias("left"))
    rows = rows.join(mixed, "column")
    block = lambda n, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = rows.filter("label <> top").select(
        "column", F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"), F.col("label").alias("label_a"), block("left", 1).alias("x"), upto("right").alias("y")
    )
    inside = rows.select(
        "column", F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b"), F.col("label").alias("label_b"), block("right", 2).alias("y"), upto("left").alias("x")
    )
    both = outside.join(inside, ["column", "x", "y"]).filter((F.col("label_a") != F.col("label_b")) & _possible(("size_a", "place_a"), ("size_b", "place_b"), percent))
    return both.select(*_pair()).distinct()


def candidate_sets(packs: DataFrame, n: int, text: str, wanted: DataFrame) -> DataFrame:
    """(sid, shingles): the sets of the rows (sid, pack, at), found again in their packs."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for data, rows in zip(*batch.columns, strict=True):
                own = unpacked(data.as_buffer())
                rows = rows.as_py()
                texts = text_column(own.take(pa.array([r["at"] for r in rows], pa.int64())), text)
                yield binary_rows(["sid", "shingles"], [pa.int64(), pa.binary()], [(r["sid"], shingle_set(t, n, words).tobytes()) for r, t in zip(rows, texts, strict=True)])

    each = wanted.groupBy("pack").agg(F.collect_list(F.struct("sid", "at")).alias("rows"))  # at most the rows of a pack
    return packs.join(each, "pack").select("data", "rows").mapInArrow(lambda batches: freed(found(batches)), "sid long, shingles binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass the exact test."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                run = np.concatenate((p, q))
                run.sort(kind="stable")  # two sorted runs: one merge
                both = int((run[1:] == run[:-1]).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.withColumnsRenamed({"sid": "a", "shingles": "pa"}), "a")
    return left.join(sets.withColumnsRenamed({"sid": "b", "shingles": "pb"}), "b").select("a", "b", "pa", "pb").mapInArrow(tested, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(sid, label): the smallest id of each vertex's component, by repeated minima and shortcuts.

    Each round takes the least label of the neighbours, then the label of that
    label, so paths halve; rounds end when no label has changed.
    """
    both = stage(edges.union(edges.select("b", "a")).toDF("sid", "other").distinct(), "edges")
    labels = stage(both.groupBy("sid").agg(F.least(F.col("sid"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("sid").alias("other"), F.col("label").alias("theirs")), "other")
        near = near.groupBy("sid").agg(F.min("theirs").alias("theirs"))
        nearer = labels.join(near, "sid").select("sid", "label", F.least("label", "theirs").alias("low"))
        jump = labels.select(F.col("sid").alias("low"), F.col("label").alias("lower"))
        moved = stage(nearer.join(jump, "low", "left").select("sid", F.coalesce("lower", "low").alias("label"), "label").toDF("sid", "label", "before"), "labels")
        labels = moved.select("sid", "label")
        if moved.filter("label <> before").isEmpty():
            return labels


def classes(docs: DataFrame, id: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The packs of ``docs``, and (pack, at, id, n_shingles, sid, label, component_id, first): each row with its class.

    first is the place of the row that stands for the class: of the smallest id, nulls last,
    then the earliest.  sid names the row's set of n-grams (null when it is empty).
    """
    packs = packed(docs, text)
    buckets = buckets_for(packs)
    found = stage(column_marks(packs, n, text, buckets), "marks")
    with_marks = packs.join(by_pack(found), "pack", "left").select("pack", "data", "marks")
    once = stage(read_once(with_marks, n, percent, id, text, docs.schema[id].dataType, buckets), "incidence")
    columns = stage(shared_columns(once.filter("column is not null").select("column", "sid", "size", "place", "weight")), "columns")
    rows = once.filter("column is null").select("pack", "at", id, "n_shingles", "sid", "blocks")
    one = rows.filter("sid is not null").groupBy("sid")
    one = stage(one.agg(F.min(F.struct("pack", "at")).alias("r"), F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), "pack", "at")).alias("first"), F.first("blocks").alias("blocks")), "sets")

    counts = one.select("sid", "blocks")
    pairs = stage(bounded(short_pairs(columns, percent).union(hub_pairs(columns, percent)).distinct(), counts, percent), "pairs")
    # the second round's pairs are of long columns; with their sets fetched now, the texts are read once for both
    sids = pairs.select("a").union(pairs.select("b")).union(columns.filter(F.col("length") > SHORT).select("sid")).toDF("sid").distinct()
    sets = stage(candidate_sets(packs, n, text, one.join(sids, "sid", "left_semi").select("sid", "r.pack", "r.at")), "candidates")
    labels = components(stage(linked(pairs, sets, percent), "links"))
    pairs = stage(bounded(long_pairs(columns, labels, percent), counts, percent), "pairs")
    if not pairs.isEmpty():
        more = stage(linked(pairs, sets, percent), "links")
        if not more.isEmpty():
            labels = components(labels.select(F.col("sid").alias("a"), F.col("label").alias("b")).filter("a <> b").union(more))
    # one row for each class of equal sets, then one for each component: both summed before they are sent
    known = one.select("sid", "first").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = known.groupBy("label").agg(F.min("first").alias("first"))
    known = stage(known.select("sid", "label").join(least, "label"), "classes")
    return packs, rows.drop("blocks").join(known, "sid", "left")


def jaccard_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, sid, component_id): each row with the smallest id of its class of linked texts.

    sid names the row's set of n-grams (null when it is empty).
    """
    _, rows = classes(docs.select(id, text), id, text, n, percent)
    return rows.select(id, "n_shingles", "sid", F.expr(f"if(sid is null, `{id}`, first.id)").alias("component_id"))


def single_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without copies: of each class of linked texts one row stays, with its columns as they are.

    It is that of the smallest id, null ids last; of rows that repeat an id, one.  Texts without words are no class.
    """
    packs, rows = classes(docs, id, text, n, percent)
    copies = rows.filter("sid is not null and (pack <> first.pack or at <> first.at)").groupBy("pack").agg(F.collect_list("at").alias("copies"))  # at most the rows of a pack

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, gone in zip(*batch.columns, strict=True):
                own = unpacked(data.as_buffer())
                keep = np.ones(len(own), bool)
                keep[gone.as_py() or []] = False
                yield own.filter(pa.array(keep))

    return packs.join(copies, "pack", "left").select("data", "copies").mapInArrow(lambda batches: freed(kept(batches)), docs.schema)
