"""Quality rules on lines: how many documents of a host share a line.

Each text is read once for its own counts and the hashes of its normalised lines
(words lower-cased, joined by one space).  For each host and line the distinct
documents are counted.  A line is removed that stands in more than ``max_docs`` of a host's
documents and in more than ``max_share`` of them, so the limit grows with the host.  A document of
which less than ``min_left`` of its words remain is rejected, as is one that fails the
rules on its own text.

Counting sums in each partition before it sends, and the lines found to be
frequent join back to the documents' lines by (host, line); Spark splits a join's
hot key.  There is no cap.

Edge cases: a null or wordless text has no lines and fails the rule on words; a
null host is a host of its own; repeated rows of one id count once for a line
and get equal verdicts; a null id counts as one document; a line exactly at a limit
stays; a very long text is read as a whole, and its lines are one array; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherscape.llm.common import WordHashes, stage, windows

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def repeated_words(h: np.ndarray, width: int) -> int:
    """Words in windows that occur at least twice in this text."""
    w = windows(h, width)
    if not len(w):
        return 0
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    start = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(docs: DataFrame, id: str, text: str, host: str, width: int = 5) -> DataFrame:
    """A row for each document: the counts of its text, and its distinct lines as (line, words)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for value in batch.column(2):
                t = value.as_py() or ""
                words = t.encode().split()
                same, seen, lines = 0, set(), {}
                for line in t.split("\n"):
                    if own := line.encode().split():
                        same += line in seen
                        seen.add(line)
                        key = xxhash.xxh3_64_intdigest(" ".join(line.lower().split()).encode()) - (1 << 63)
                        lines[key] = lines.get(key, 0) + len(own)
                out.append((
                    len(words), len(t) - sum(map(t.count, WHITE)), sum(map(t.count, SYMBOLS)), same,
                    repeated_words(hashes.of(words), width), [{"line": k, "words": v} for k, v in lines.items()],
                ))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=[id, "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, F.col(host).cast("string").alias("host"), text).mapInArrow(
        read,
        f"`{id}` {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>",
    )


def line_rules(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = 2,
    max_share: float = 0.02,
    min_left: float = 0.5,
    min_words: int = 10,
    max_repeated: float = 0.2,
) -> DataFrame:
    """(id, counts, removed_words, base_failed, kept) for each document."""
    rows = stage(measured(docs, id, text, host).withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = rows.select("row", F.col(id).alias("doc"), "host", F.explode("lines").alias("l")).select("row", "doc", "host", "l.line", "l.words")
    documents = F.count_distinct(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.col("doc").isNull())
    hosts = rows.select("host", F.col(id).alias("doc")).groupBy("host").agg(documents.alias("all"))
    frequent = lines.groupBy("host", "line").agg(documents.alias("n")).filter(F.col("n") > max_docs)  # few are left to join
    frequent = frequent.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > max_share * F.col("all"))
    frequent = frequent.select("h", F.col("line").alias("k"))
    removed = lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("k")), "left_semi")
    removed = removed.groupBy("row").agg(F.sum("words").alias("removed_words"))
    found = rows.drop("lines", "host").join(removed, "row", "left").fillna(0, ["removed_words"])
    n = F.col("n_words")
    found = found.withColumn("base_failed", (n < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeated) * n))
    left = n - F.col("removed_words")
    return found.withColumn("kept", ~F.col("base_failed") & (left >= n * min_left) & (left > 0)).drop("row")
