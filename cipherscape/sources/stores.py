"""Source trees and ZIP archives on whatever file system Spark reads, as DataFrames of (snapshot_id, path, size, content).

``tree`` of a local folder, or on another store that pyarrow reads, is listed and read by tasks: each level of folders is a table, whose
folders are dealt out to be listed, and the files found are dealt out to be read.  The driver sees two numbers a level, no name.
``listing`` is the same without contents.

On other stores ``tree`` lists a folder through Hadoop's file systems, on the driver, and reads it with Spark's own reader of binary files, which packs
files into partitions by bytes, leaves the content out where it isn't asked for and pushes filters on the length down.  That reader passes over
names that start with '_' or '.', such as ``__init__.py``; so the files are named through a view of the store in which every name has a prefix: a regular-expression mount of Hadoop's ViewFs, one setting for a tree.

``archives`` reads ZIP archives of any store.  One task checks an archive's directory and cuts its members
out, still compressed; these rows are dealt out by bytes, so many tasks inflate and parse one archive.  For archives larger than one binary value, use the
data source ``source_zip``, which reads ranges.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import os
import zipfile
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherscape.operators import persist
from cipherscape.sources import files

#: Files that a task reads or writes, at most about so many.
DEALT_FILES = 20_000
#: Rows and bytes that a task passes on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Compressed bytes of members that a task is to inflate.
DEALT_BYTES = 8 << 20


def listed(spark: SparkSession, root: str, max_files: int = files.MAX_FILES) -> list[tuple[str, int]]:
    """(path below ``root``, bytes) of every regular file, by path; links are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    system = top.getFileSystem(conf)
    found, folders = [], [(top, "")]
    while folders:
        folder, below = folders.pop()
        for status in system.listStatus(folder):
            name = below + status.getPath().getName()
            if status.isDirectory():
                folders.append((status.getPath(), f"{name}/"))
            elif status.isFile():
                found.append((name, status.getLen()))
                if len(found) > max_files:
                    raise files.ArchiveTooLarge("files")
    return sorted(found, key=lambda f: f[0].split("/"))


def _view(spark: SparkSession, root: str) -> str:
    """A mount in which ``a/b/name`` below the root is ``a/b/n-name``, all percent-encoded."""
    scheme, slashes, rest = root.rstrip("/").partition("://")
    target = f"{scheme}://{quote(rest)}" if slashes else f"file://{quote(scheme)}"
    mount = f"tree-{hashlib.sha256(target.encode()).hexdigest()[:20]}"
    setting = f"fs.viewfs.mounttable.{mount}.linkRegex.#.^/t(?<below>(?:/.*)?)/n-(?<name>[^/]+)$"
    spark.sparkContext._jsc.hadoopConfiguration().set(setting, target + "${below}/${name}")
    return f"viewfs://{mount}/t"


def _local(root: str) -> str | None:
    """The folder that a path or URI without a host means, None on another store."""
    if "://" not in root:
        return root.removeprefix("file:")
    return root.removeprefix("file://") if root.startswith("file:///") else None


def _target(root: str) -> tuple[fs.FileSystem, str]:
    local = _local(root)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def _qualified(spark: SparkSession, root: str) -> str:
    """A folder's URI, where a path without a scheme lies on the default file system."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString()


def _entries(root: str, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path below the root, bytes) of what a folder holds, without bytes for folders; links and devices are passed over."""
    local, below = _local(root), f"{folder}/" if folder else ""
    if local is not None:
        with os.scandir(f"{local}/{folder}") as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield below + entry.name, None
                elif entry.is_file(follow_symlinks=False):
                    yield below + entry.name, entry.stat(follow_symlinks=False).st_size
        return
    system, top = _target(root)
    for info in system.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"))):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield below + info.base_name, None if info.type == fs.FileType.Directory else info.size


def _listing(spark: SparkSession, root: str, max_files: int) -> tuple[DataFrame, int, int]:
    """(path, size) of every regular file, their number and bytes."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                held = _entries(root, folder)
                while rows := list(itertools.islice(held, BATCH_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["path", "size"])

    folders, levels, number, total = spark.createDataFrame([("",)], "path string"), [], 0, 0
    while True:
        levels.append(persist.written(folders.mapInArrow(entries, "path string, size long")))
        held, size, deeper = levels[-1].agg(F.count("size"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size").isNull())).first()
        number, total = number + held, total + size
        if number > max_files:
            raise files.ArchiveTooLarge("files")
        if not deeper:
            return reduce(DataFrame.unionByName, levels).filter("size is not null"), number, total
        folders = levels[-1].filter("size is null").select("path").repartition(min(deeper, 4 * spark.sparkContext.defaultParallelism), "path")


def listing(spark: SparkSession, root: str, snapshot: str = "s", max_files: int = files.MAX_FILES) -> DataFrame:
    """(snapshot_id, path, size) of every regular file below ``root``, listed by tasks; for local folders and stores that pyarrow reads."""
    return _listing(spark, _qualified(spark, root), max_files)[0].select(F.lit(snapshot).alias("snapshot_id"), "path", "size")


def _read(spark: SparkSession, root: str, snapshot: str, max_files: int) -> DataFrame:
    found, number, total = _listing(spark, root, max_files)
    tasks = max(spark.sparkContext.defaultParallelism, -(-number // DEALT_FILES), -(-total // files.PARTITION_BYTES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _target(root)

        def passed(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            paths, contents = zip(*held, strict=True)
            columns = [pa.array([snapshot] * len(held)), pa.array(paths), pa.array(list(map(len, contents)), pa.int64()), pa.array(contents, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["snapshot_id", "path", "size", "content"])

        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                with system.open_input_file(f"{top}/{path}") as f:
                    content = f.read()
                if held and (len(held) >= BATCH_ROWS or size + len(content) > BATCH_BYTES):
                    yield passed(held)
                    held, size = [], 0
                held.append((path, content))
                size += len(content)
            if held:
                yield passed(held)

    return found.select("path").repartition(tasks, "path").mapInArrow(read, files.SCHEMA)


def tree(spark: SparkSession, root: str, snapshot: str = "s", max_files: int = files.MAX_FILES) -> DataFrame:
    """Every regular file below ``root``, empty ones and names with '_' and '.' included."""
    whole = _qualified(spark, root)
    try:
        _target(whole)
    except (pa.ArrowInvalid, OSError):  # a store that only Hadoop's file systems know
        return _tree_by_hadoop(spark, root, snapshot, max_files)
    return _read(spark, whole, snapshot, max_files)


def _tree_by_hadoop(spark: SparkSession, root: str, snapshot: str, max_files: int) -> DataFrame:
    found, view = listed(spark, root, max_files), _view(spark, root)
    paths = []
    for name, size in found:
        below, _, leaf = quote(name).rpartition("/")
        if size:
            paths.append(f"{view}/{below}/n-{leaf}" if below else f"{view}/n-{leaf}")
    empty = spark.createDataFrame([(name,) for name, size in found if not size], "path string")
    rows = empty.select(F.lit(snapshot).alias("snapshot_id"), "path", F.lit(0).cast("long").alias("size"), F.lit(b"").alias("content"))
    if not paths:
        return rows
    shown = F.regexp_replace(F.substring("path", len(view) + 2, 1 << 20), "(^|/)n-([^/]*)$", "$1$2")
    whole = spark.read.format("binaryFile").load(paths)
    return whole.select(F.lit(snapshot).alias("snapshot_id"), F.url_decode(shown).alias("path"), F.col("length").alias("size"), "content").unionByName(rows)


def write_tree(rows: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below ``root``; the number of files.  A task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _target(root)
        for batch in batches:
            made = set()
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{path}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(rows: DataFrame, root: str) -> int:
    """Write (snapshot_id, path, content) rows as ``<snapshot_id>.zip`` below ``root``; the number of archives.  An archive's rows meet in one task."""

    def write(table: pa.Table) -> pa.Table:
        system, top = _target(root)
        entries = sorted(zip(*(table.column(c).to_pylist() for c in ("path", "content")), strict=True))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, content in entries:
                archive.writestr(zipfile.ZipInfo(path), content, zipfile.ZIP_DEFLATED)
        system.create_dir(top, recursive=True)
        with system.open_output_stream(f"{top}/{table.column('snapshot_id')[0]}.zip") as f:
            f.write(out.getvalue())
        return pa.table({"n": [1]})

    return rows.groupBy("snapshot_id").applyInArrow(write, "n long").count()


def archives(spark: SparkSession, path: str, max_files: int = files.MAX_FILES, max_bytes: int = files.MAX_EXTRACTED, max_archive: int = files.MAX_ARCHIVE) -> DataFrame:
    """The members of ZIP archives (a file, a folder of ``*.zip`` or a pattern); the archive's name is the snapshot."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    read = read.withColumn("content", F.when(F.col("length") <= max_archive, F.col("content")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                if not content.is_valid:
                    raise files.ArchiveTooLarge(f"archive bytes: {name}")
                snapshot = name.as_py().rpartition("/")[2].removesuffix(".zip")
                with files.opened_zip(io.BytesIO(content.as_py())) as archive:
                    members = files.members(archive, max_files, max_bytes)
                    for k in range(0, len(members), 64):
                        rows = [(snapshot, member, info.file_size, info.compress_type, info.CRC, files.packed(archive, info)) for member, info in members[k : k + 64]]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["snapshot_id", "path", "size", "method", "crc", "packed"])

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a member at a time, as it may be many times as large as packed
                snapshot, member, size, method, crc, packed = (c[k].as_py() for c in batch.columns)
                content = files.unpacked(packed, method, size, crc, member)
                yield pa.RecordBatch.from_arrays([pa.array([snapshot]), pa.array([member]), pa.array([size]), pa.array([content])], names=["snapshot_id", "path", "size", "content"])

    cuts = read.select("path", "content").mapInArrow(cut, "snapshot_id string, path string, size long, method long, crc long, packed binary")
    tasks = max(2 * spark.sparkContext.defaultParallelism, sum(s for _, s in _sizes(spark, path)) // DEALT_BYTES)
    return cuts.repartition(int(tasks), "snapshot_id", "path").mapInArrow(inflate, files.SCHEMA)


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length")
    return [tuple(r) for r in sizes.groupBy().agg(F.lit("").alias("path"), F.coalesce(F.sum("length"), F.lit(0))).collect()]
