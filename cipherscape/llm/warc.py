"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

*Writing.*  Records of equal payload (by SHA-1 and length, at least ``least`` bytes)
are found with a partial aggregate; all but one become revisit records, which
carry the digest and length and no payload.  A Python data source writes each
record as a gzip member of its own, in archives of bounded size, in the folder
given by any URI that pyarrow knows (``s3a`` is read as ``s3``).  A write owns only the
files of its own name: it removes what its failed tasks left, and no archive of another write.

*Reading.*  Spark lists and reads the archives as binary files.  In each the reader
checks a record's member, version line, length and block digest; a member may hold
several records, and those of a damaged one that are whole are read.  After a failed
check it searches for the next place where a whole valid record starts, be it a
gzip member or a bare version line, and goes on from there; the bytes between
are logged as a gap with the reason.  Nothing is guessed from damaged bytes.

Edge cases: a null payload is empty, an empty payload is a record with no bytes;
a null url or key writes an empty field and reads back as null; repeated rows
each make a record, and all rows of the chosen key stay responses; a very long payload is
one record, in memory once, and a member of more than ``most`` bytes (1 GB unless said) is
a gap with the reason 'member too large'; an empty table makes no archive and reads as no
record; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from cipherscape.llm.common import remove, shared_dir, stage

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "file string, offset long, length long, kind string, reason string, key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def record(key: str, url: str, kind: str, payload: bytes, payload_bytes: int, sha1: str, refers_to: str | None, date: str) -> bytes:
    """A record as bytes, without compression; sha1 is the whole payload's, in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:record:{key}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields[4:4] = [("WARC-Refers-To", f"<urn:record:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes (key, url, kind, payload, payload_bytes, sha1, refers_to) rows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.date = options["path"], options.get("date", "2000-01-01T00:00:00Z")
        self.most = int(options.get("maxbytes", 32 << 20))
        self.own = f"part-{uuid.uuid4().hex}-"  # made once, on the driver: the names of this write's files begin with it

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                if out is None:
                    names.append(f"{self.own}{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                key, url, kind, payload, n, sha1, refers_to = (x.as_py() for x in row)
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = pack.compress(record(key or "", url or "", kind, payload or b"", n, sha1, refers_to, self.date)) + pack.flush()
                out.write(member)
                size += len(member)
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of this write that no commit names are left-overs of failed tasks; they go."""
        self._keep({n for m in messages if m is not None for n in m.files})

    def abort(self, messages: list[Written | None]) -> None:
        self._keep(set())

    def _keep(self, names: set[str]) -> None:
        from pyarrow import fs

        store, root = file_system(self.path)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(self.own) and info.base_name not in names:
                store.delete_file(info.path)


def file_system(path: str):  # noqa: ANN201
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


# -- reading ---------------------------------------------------------------------


class Damaged(Exception):
    pass


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):([^\x00-\x08\x0a-\x1f\x7f]*)")


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, length with the closing lines) of the record at ``at``."""
    if not _VERSION.match(data, at):
        raise Damaged("version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header")
    fields: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        found = _FIELD.fullmatch(line)
        if found is None:  # else junk before a record would swallow what lies between
            raise Damaged("header")
        name, value = found[1], found[2]
        fields[name.decode("ascii", "replace").lower()] = value.strip().decode(errors="replace")
    if not fields.get("content-length", "").isdecimal():
        raise Damaged("length")
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = data[start:stop]
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:]:
        raise Damaged("digest")
    return fields, block, stop + 4 - at


#: Bytes decompressed at a time; the most that a member may hold unless said otherwise, which is what one value of a column holds; and the longest header of a bare record.
CHUNK, MOST, HEADER = 1 << 16, (1 << 31) - 1, 1 << 20


def member_at(data: bytes, at: int, most: int = MOST) -> tuple[bytes, int]:
    """(content, length in the file) of the gzip member that starts at ``at``."""
    unpack, view, out, size, end = zlib.decompressobj(31), memoryview(data), [], 0, at
    try:
        while not unpack.eof and end < len(data):
            out.append(unpack.decompress(view[end : end + CHUNK], most + 1 - size))
            end += CHUNK
            size += len(out[-1])
            while unpack.unconsumed_tail and size <= most:
                out.append(unpack.decompress(unpack.unconsumed_tail, most + 1 - size))
                size += len(out[-1])
            if size > most:
                raise Damaged("member too large")
    except zlib.error as e:
        raise Damaged("member") from e
    if not unpack.eof:
        raise Damaged("member cut short")
    return b"".join(out), min(end, len(data)) - at - len(unpack.unused_data)


def bare_record_at(data: bytes, at: int, header: int = HEADER) -> tuple[dict[str, str], bytes, int]:
    """As parse, for the bare record that starts at ``at``; takes no more than its header says."""
    head = data.find(b"\r\n\r\n", at, at + header)
    size = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", data[at : head + 4]) if head >= 0 else None
    return parse(data[at : head + 8 + int(size[1])] if size else data[at : at + 16])


_START = re.compile(rb"\x1f\x8b\x08|" + _VERSION.pattern)


def inside(whole: bytes) -> Iterator[tuple[str, object]]:
    """('record', (fields, block)) and ('gap', reason) over the content of a member."""
    at, bad = 0, None
    while at < len(whole):
        try:
            fields, block, n = parse(whole, at)
        except Damaged as e:
            bad = bad or str(e)
            found = _VERSION.search(whole, at + 1)
            at = found.start() if found else len(whole)
            continue
        if bad is not None:
            yield "gap", bad
            bad = None
        yield "record", (fields, block)
        at += n
    if bad is not None:
        yield "gap", bad


def salvaged(data: bytes, most: int = MOST, header: int = HEADER) -> Iterator[tuple[int, int, str, object]]:
    """(offset, length, 'record', (fields, block)) and (offset, length, 'gap', reason) over a whole archive.

    Records and gaps of one gzip member all have the member's offset and length.  A
    member without any valid record is no start: the search goes on behind its first byte.  ``most`` bounds
    what a member may hold, ``header`` the header of a bare record.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                whole, n = member_at(data, at, most)
                found, head = inside(whole), []  # records come one after another and are not held
                for x in found:
                    head.append(x)
                    if x[0] == "record":
                        break
                else:
                    raise Damaged(head[0][1] if head else "version line")
                found = itertools.chain(head, found)
            else:
                fields, block, n = bare_record_at(data, at, header)
                found = [("record", (fields, block))]
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if bad is not None:
            yield bad, at - bad, "gap", reason
            bad = None
        for kind, what in found:
            yield at, n, kind, what
        at += n
    if bad is not None:
        yield bad, len(data) - bad, "gap", reason


def _key(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:record:(.*)>", value or "")
    return found[1] or None if found else value


def read_archives(spark: SparkSession, path: str, payloads: bool = True, most: int = MOST, header: int = HEADER) -> DataFrame:
    """Records and gaps of all archives below ``path`` (READ_SCHEMA); payloads may be left out.  ``most`` and ``header`` as in ``salvaged``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.binary() if x.endswith(" binary") else pa.string() for x in READ_SCHEMA.split(", ")]
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, size = [], 0
                for offset, n, kind, what in salvaged(value.as_py(), most, header):
                    if kind == "gap":
                        out.append((file, offset, n, kind, what, *[None] * 7))
                    else:
                        out.append((file, offset, n, kind, None, *_read(*what, payloads)))
                        size += len(what[1])
                    if size > 8 << 20:
                        yield _batch(out, names, kinds)
                        out, size = [], 0
                yield _batch(out, names, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(rows, READ_SCHEMA)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _read(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    if kind == "revisit":
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        length = int(said[1]) if said else None
        own = fields.get("warc-payload-digest", "")
        digest = base64.b32decode(own[5:]).hex() if own.startswith("sha1:") else None
    refers = _key(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return _key(fields.get("warc-record-id")), fields.get("warc-target-uri") or None, kind, refers, length, digest, payload if payloads and kind != "revisit" else None


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, least: int = 1000) -> None:
    """Write a record for each row; equal payloads of ``least`` bytes or more are kept once, for the largest key."""
    pages.sparkSession.dataSource.register(WarcDataSource)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    equal = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("sha1").alias("s"), F.col("payload_bytes").alias("b"))
    equal = equal.agg(F.max("k").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(equal, (F.col("sha1") == F.col("s")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    rows.select(
        F.col("k").cast("string").alias("key"), "url", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "sha1", F.when(again, F.col("first").cast("string")).alias("refers_to"),
    ).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and read them back; the archives go, what was read of them is written."""
    path = f"{shared_dir(pages.sparkSession)}/archives/{uuid.uuid4().hex}"
    write_archives(pages, path, key, url, payload, least)
    found = stage(read_archives(pages.sparkSession, path, payloads=False), "records")
    remove(pages.sparkSession, path)
    return found
