"""Data sources of source files: a directory tree and ZIP archives, as rows of bytes.

``spark.read.format("source_tree")`` and ``("source_zip")`` give (snapshot_id, path,
size, content).  Unlike Spark's binary files they keep names that start with '_'
or '.', and empty files, and skip symbolic links.
"""

from __future__ import annotations

import contextlib
import os
import re
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "snapshot_id string, path string, size bigint, content binary"
#: Default ceilings: bytes of an archive, of what it holds, and files in it.
MAX_ARCHIVE, MAX_EXTRACTED, MAX_FILES = 250 << 20, 500 << 20, 20_000
CHUNK = 512 << 10
PARTITION_BYTES = 16 << 20
#: Members of an archive that a task reads at most.
RUN = 1000


class ArchiveTooLarge(ValueError):
    code = "ARCHIVE_TOO_LARGE"


class UnsafeArchive(ValueError):
    code = "UNSAFE_ARCHIVE"


class MalformedArchive(ValueError):
    code = "MALFORMED_ARCHIVE"


class Part(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.snapshot = options["path"].removeprefix("file://"), options.get("snapshot", "s")

    def partitions(self) -> list[InputPartition]:
        """Files in partitions of about PARTITION_BYTES."""
        out, size = [Part([])], 0
        for folder, folders, names in os.walk(self.root):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(folder, name)
                status = os.lstat(path)
                if not stat.S_ISREG(status.st_mode):
                    continue
                if size >= PARTITION_BYTES:
                    out.append(Part([]))
                    size = 0
                out[-1].files.append(os.path.relpath(path, self.root))
                size += status.st_size + 4096
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.files:
            with open(os.path.join(self.root, path), "rb") as f:
                content = f.read()
            yield self.snapshot, path.replace(os.sep, "/"), len(content), content


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(dict(self.options))


def safe_member(info: zipfile.ZipInfo) -> str:
    """The member's path, or UnsafeArchive for one that could leave the archive."""
    name, kind = info.filename, stat.S_IFMT(info.external_attr >> 16)
    parts = [p for p in name.split("/") if p not in ("", ".")]
    if not parts or "\\" in name or "\0" in name or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in parts:
        raise UnsafeArchive(f"unsafe path {name!r}")
    if kind not in (0, stat.S_IFREG, stat.S_IFDIR, stat.S_IFLNK):
        raise UnsafeArchive(f"unsafe kind of member {name!r}")
    return "/".join(parts)


def safe_link(name: str, target: str) -> None:
    """UnsafeArchive for a link at ``name`` that leads out of the tree; links inside are passed over."""
    depth = name.count("/")
    for part in target.split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            break
    if depth < 0 or target.startswith("/") or re.match("[A-Za-z]:", target):
        raise UnsafeArchive(f"link {name!r} leads out of the archive")


@contextlib.contextmanager
def opened_zip(source: object) -> Iterator[zipfile.ZipFile]:
    """An archive, whose own faults come out as MalformedArchive."""
    try:
        with zipfile.ZipFile(source) as archive:
            yield archive
    except (zipfile.BadZipFile, EOFError, NotImplementedError, zlib.error, RuntimeError, struct.error, UnicodeDecodeError) as e:  # RuntimeError: a password is asked for
        raise MalformedArchive(str(e)) from e


def members(archive: zipfile.ZipFile, max_files: int = MAX_FILES, max_bytes: int = MAX_EXTRACTED, links: bool = True) -> list[tuple[str, zipfile.ZipInfo]]:
    """(path, member) of an archive's files by place, all checked before one is read: names, kinds, number, declared bytes, and where links lead.

    One top directory that all members share is left out.
    """
    checked = [(safe_member(i), i) for i in archive.infolist()]
    plain = [(n, i) for n, i in checked if not i.is_dir() and not stat.S_ISLNK(i.external_attr >> 16)]
    if sum(not i.is_dir() for _, i in checked) > max_files:
        raise ArchiveTooLarge("files")
    if sum(i.file_size for _, i in plain) > max_bytes:
        raise ArchiveTooLarge("extracted bytes")
    tops = {n.partition("/")[0] for n, _ in checked}
    shared = len(tops) == 1 and all("/" in n or i.is_dir() for n, i in checked)
    short = (lambda n: n.partition("/")[2]) if shared else (lambda n: n)
    for name, info in checked if links else []:
        if stat.S_ISLNK(info.external_attr >> 16):
            with archive.open(info) as f:
                safe_link(short(name), f.read(4096).decode("utf-8", "replace"))
    return sorted(((short(n), i) for n, i in plain), key=lambda m: m[1].header_offset)


def unzipped(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """A member's content, of the declared size and checksum."""
    content = bytearray()
    with archive.open(info) as f:
        while block := f.read(CHUNK):
            content += block
            if len(content) > info.file_size:
                raise MalformedArchive(f"{info.filename!r} is larger than declared")
    if len(content) != info.file_size:
        raise MalformedArchive(f"{info.filename!r} is smaller than declared")
    return bytes(content)


def packed(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    """A member's bytes as they lie in the archive."""
    if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise MalformedArchive(f"{info.filename!r} is encrypted or packed in an unknown way")
    with archive.open(info):  # checks the member's own header against the directory
        pass
    source = archive.fp
    source.seek(info.header_offset + 26)
    skipped = sum(struct.unpack("<HH", source.read(4)))
    source.seek(skipped, 1)
    return source.read(info.compress_size)


def unpacked(content: bytes, method: int, size: int, crc: int, name: str) -> bytes:
    """What ``packed`` gave, inflated no further than the declared size."""
    if method == zipfile.ZIP_DEFLATED:
        inflater = zlib.decompressobj(-zlib.MAX_WBITS)
        try:
            content = inflater.decompress(content, size + 1)
        except zlib.error as e:
            raise MalformedArchive(str(e)) from e
    if len(content) != size or zlib.crc32(content) != crc:
        raise MalformedArchive(f"{name!r} is not what its archive declares")
    return content


def opened(path: str) -> object:
    """A local path, or a URI of a file system that pyarrow reads, as a file with ``seek``."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inside)


def _archives(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of an archive, or of those in a folder."""
    if "://" not in path or path.startswith("file://"):
        path = path.removeprefix("file://")
        names = [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".zip"))
        return [(n, os.path.getsize(n)) for n in names]
    system, inside = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    info = system.get_file_info(inside)
    found = [info] if info.is_file else sorted((i for i in system.get_file_info(fs.FileSelector(inside)) if i.path.endswith(".zip")), key=lambda i: i.path)
    return [(path[: len(path) - len(inside)] + i.path, i.size) for i in found]


def zip_rows(path: str, snapshot: str, max_files: int = MAX_FILES, max_bytes: int = MAX_EXTRACTED, max_archive: int = MAX_ARCHIVE) -> Iterator[tuple]:
    """Rows of a ZIP archive; every member is checked before the first is read."""
    if os.path.getsize(path) > max_archive:
        raise ArchiveTooLarge("archive bytes")
    with opened_zip(path) as archive:
        for name, info in members(archive, max_files, max_bytes):
            content = unzipped(archive, info)
            yield snapshot, name, len(content), content


class Run(InputPartition):
    """Members ``first`` to ``last`` of an archive, by place."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


class ZipReader(DataSourceReader):
    """An archive's directory is checked once, when the read is planned, and its members are dealt out in runs of about PARTITION_BYTES.

    A task reads the directory again, which the ceiling on files bounds, and of the rest only its own run of
    bytes.  No member may exceed its declared size, so the declared total, checked before, bounds what all tasks extract.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        limits = {k: int(options[k]) for k in ("max_files", "max_bytes", "max_archive") if k in options}
        self.max_archive = limits.pop("max_archive", MAX_ARCHIVE)
        self.limits = limits

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size in _archives(self.options["path"]):
            if size > self.max_archive:
                raise ArchiveTooLarge("archive bytes")
            with opened(path) as source, opened_zip(source) as archive:
                found = members(archive, **self.limits)
            first, held = 0, 0
            for k, (_, info) in enumerate(found):
                held += max(info.file_size, info.compress_size) + 4096
                if held >= PARTITION_BYTES or k - first >= RUN - 1 or k == len(found) - 1:
                    out.append(Run(path, first, k + 1))
                    first, held = k + 1, 0
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.path:
            return
        name = partition.path.rpartition("/")[2].removesuffix(".zip")
        with opened(partition.path) as source, opened_zip(source) as archive:
            for path, info in members(archive, **self.limits, links=False)[partition.first : partition.last]:
                content = unzipped(archive, info)
                yield self.options.get("snapshot", name), path, len(content), content


class SourceZip(SourceTree):
    @classmethod
    def name(cls) -> str:
        return "source_zip"

    def reader(self, schema) -> ZipReader:  # noqa: ANN001
        return ZipReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(SourceZip)
