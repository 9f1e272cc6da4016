"""The persisted relations of a scan, the store that they are committed to, and tables written once."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cipherscape.operators.derive import first_per_fingerprint

ORDER = ["path", "start_line", "start_column", "rule_id", "api", "operation", "end_line", "end_column"]
TABLES = ["findings", "evidence", "impact_nodes", "review_items", "audit_events"]


def row_id(*parts: str | Column) -> Column:
    """A repeatable id: SHA-256 of its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def relations(found: DataFrame, scan: str = "snapshot_id") -> dict[str, DataFrame]:
    """Derived findings as the tables of the schema; of one identity in a scan the first in order stays."""
    rows = first_per_fingerprint(found, ORDER, scan).withColumn("id", row_id(scan, "fingerprint"))
    confidence = F.when(F.col("confidence") == "UNKNOWN", "LOW").otherwise(F.col("confidence"))
    findings = rows.select(
        "id", F.col(scan).alias("scan_id"), "fingerprint", "algorithm", "primitive", "library", "api", "operation", F.col("path").alias("file_path"),
        "start_line", "end_line", "start_column", "end_column", "role", confidence.alias("confidence"), "priority", F.lit("ACTIVE").alias("status"),
    )
    evidence = rows.select(
        F.col("id").alias("finding_id"), F.col(scan).alias("repository_sha"), F.col("path").alias("file_path"), "start_line", "end_line", "source_excerpt",
        "rule_id", "parser_version", "ruleset_version",
    )
    nodes = rows.select(F.col("id").alias("finding_id"), F.explode(F.filter("impact_nodes", lambda n: n["node_type"] != "ALGORITHM")).alias("n"))
    nodes = nodes.select("finding_id", "n.node_type", "n.label", "n.relationship", "n.confidence")
    reviews = rows.select(row_id("id", F.lit("review")).alias("id"), F.col("id").alias("finding_id"), F.lit("OPEN").alias("status"), F.lit(None).cast("string").alias("assigned_to"), F.lit(None).cast("string").alias("note"))
    metadata = F.to_json(F.struct("fingerprint", "algorithm", "rule_id"))
    audit = rows.select(F.col(scan).alias("scan_id"), F.col("id").alias("finding_id"), F.lit("FINDING_CREATED").alias("event_type"), metadata.alias("metadata"))
    return {"findings": findings, "evidence": evidence, "impact_nodes": nodes, "review_items": reviews, "audit_events": audit}


# -- the store -----------------------------------------------------------------------


class Conflict(RuntimeError):
    """Someone else has written what a commit expected to find unchanged."""


@dataclass
class State:
    """What a store holds after commit ``number``: for each table its schema and, by run, (folder, number of the commit that wrote it)."""

    number: int = 0
    tables: dict[str, dict[str, tuple[str, int]]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)

    def after(self, number: int, change: dict) -> State:
        """The state after a commit, which adds runs, replaces them or takes them away."""
        tables = {name: dict(runs) for name, runs in self.tables.items()}
        for name, run, folder in change["runs"]:
            if folder is None:
                tables.get(name, {}).pop(run, None)
            else:
                tables.setdefault(name, {})[run] = (folder, number)
        return State(number, tables, self.schemas | change["schemas"])


class Store:
    """Tables of runs below ``root``, whose commits are numbered files.

    Rows are written to folders that nobody reads yet.  A commit is one small file that names them, created under the
    next number or not at all: whoever comes second reads the other's commit, checks its own expectations again and takes the number after.
    So all tables of a commit appear at once, a reader keeps the folders of the state that it began with, a writer that
    is cut off leaves nothing that is seen, and the numbers put all that happened in one order.

    Each FULL-th commit holds the whole state, so reading one takes few files.  On HDFS creation rests on a rename that fails
    where the target exists, on local folders on a link; an object store needs one of the two.
    """

    FULL = 50

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._known = State()

    # -- commits --

    def state(self) -> State:
        """The present state: what is known, and the commits since."""
        names = self._names()
        full = max((n for n in names if n % self.FULL == 0), default=0)
        for number in sorted(n for n in names if n > self._known.number and n >= full):
            text = json.loads(self._text(number))
            if "state" in text:
                whole = text["state"]
                self._known = State(number, {t: {r: tuple(f) for r, f in runs.items()} for t, runs in whole["tables"].items()}, whole["schemas"])
            else:
                self._known = self._known.after(number, text)
        return self._known

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, tuple[str, str]]:
        """Write rows where no reader looks; (folder, schema) by table, for ``commit``."""
        out = {}
        for name, df in tables.items():
            folder = f"attempt=a{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{name}/{folder}")
            out[name] = (folder, df.schema.json())
        return out

    def staged(self, name: str, written: tuple[str, str]) -> DataFrame:
        return self._rows(name, [written[0]], written[1]).drop("attempt")

    def commit(self, runs: list[tuple[str, str, tuple[str, str] | None]], expected: dict[tuple[str, str], int | None] | None = None) -> int:
        """Make runs (table, run, what ``stage`` gave; None takes the run away) visible, all at once; the commit's number.

        ``expected``: the number that (table, run) must still have, None for a run that must not be there; otherwise Conflict.
        """
        change = {"runs": [(t, r, w and w[0]) for t, r, w in runs], "schemas": {t: w[1] for t, _, w in runs if w}}
        while True:
            now = self.state()
            for (name, run), number in (expected or {}).items():
                if now.tables.get(name, {}).get(run, (None, None))[1] != number:
                    raise Conflict(f"{name}, {run}")
            after = now.after(now.number + 1, change)
            text = {"state": {"tables": after.tables, "schemas": after.schemas}} if after.number % self.FULL == 0 else change
            if self._create(after.number, json.dumps(text)):
                return after.number

    # -- rows --

    def read(self, name: str, schema: str | None = None, numbered: bool = False) -> DataFrame:
        """A table's rows as they are now; with ``numbered`` also ``run`` and the ``number`` of the commit that wrote them.  ``schema`` is for a table never written."""
        now = self.state()
        runs = now.tables.get(name, {})
        if not runs:
            if name not in now.schemas and schema is None:
                raise KeyError(name)
            kind = StructType.fromJson(json.loads(now.schemas[name])) if name in now.schemas else StructType.fromDDL(schema)
            rows = self.spark.createDataFrame([], kind)
            return rows.withColumns({"run": F.lit(""), "number": F.lit(0).cast("long")}) if numbered else rows
        rows = self._rows(name, [folder for folder, _ in runs.values()], now.schemas[name])
        if not numbered:
            return rows.drop("attempt")
        known = self.spark.createDataFrame([(f.partition("=")[2], r, n) for r, (f, n) in runs.items()], "attempt string, run string, number long")  # a row for each run
        return rows.join(known, "attempt").drop("attempt")

    def _rows(self, name: str, folders: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema))).option("basePath", f"{self.root}/{name}")
        return reader.parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    def sweep(self, hours: float = 24) -> int:
        """Delete folders that the present state doesn't name and that are ``hours`` old; the number deleted."""
        system, path = self._system()
        kept = {(name, f) for name, runs in self.state().tables.items() for f, _ in runs.values()}
        before, gone = time.time() - hours * 3600, 0
        for name in self.state().schemas:
            for status in system.listStatus(path(f"{self.root}/{name}")):
                if (name, status.getPath().getName()) not in kept and status.getModificationTime() / 1000 <= before:
                    gone += system.delete(status.getPath(), True)
        return gone

    # -- files --

    def _system(self) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self) -> list[int]:
        system, path = self._system()
        folder = path(f"{self.root}/_log")
        if not system.exists(folder):
            return []
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        return [int(n.removesuffix(".json")) for n in names if re.fullmatch(r"[0-9]+\.json", n)]

    def _file(self, number: int) -> str:
        return f"{self.root}/_log/{number:020}.json"

    def _text(self, number: int) -> str:
        system, path = self._system()
        stream = system.open(path(self._file(number)))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, number: int, text: str) -> bool:
        """Create a commit's file; False where it is there."""
        target, draft = self._file(number), f"{self.root}/_log/.{uuid.uuid4().hex}"
        if "://" not in self.root or self.root.startswith("file://"):
            target, draft = target.removeprefix("file://"), draft.removeprefix("file://")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        system, path = self._system()
        stream = system.create(path(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not system.exists(path(target)) and system.rename(path(draft), path(target)):
            return True
        system.delete(path(draft), False)
        return False


def write(tables: dict[str, DataFrame], root: str, run: str | None = None) -> str:
    """Write all tables of one run, visible at once; a run that is written again under its name replaces itself."""
    store, run = Store(next(iter(tables.values())).sparkSession, root), run or uuid.uuid4().hex
    store.commit([(name, run, written) for name, written in store.stage(tables).items()])
    return run


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all runs."""
    return Store(spark, root).read(name)


# -- tables written once -----------------------------------------------------------


_stored: dict[tuple[str, ...], tuple[str, str | None]] = {}


def stamp(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files of tables: another one after any change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        top = jvm.org.apache.hadoop.fs.Path(path)
        files = top.getFileSystem(conf).listFiles(top, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def written_once(
    spark: SparkSession, rows: Callable[[], DataFrame], *key: str, inputs: tuple[str, ...], by: list[str] | None = None, buckets: tuple[str, ...] = (), count: int | None = None
) -> DataFrame:
    """``rows`` as a table in the shared folder, written when it is first asked for in an application, and again once a file of ``inputs`` has changed.

    Reads that follow prune columns and push filters into its scan, and derive nothing again.  ``by``: columns that make folders.
    ``buckets``: columns whose rows lie together in one of ``count`` files, so joins and groups by them, or by them and
    more, need no exchange.
    """
    key = (spark.sparkContext.applicationId, *key, stamp(spark, *inputs))
    if key not in _stored:
        path, name = own_folder(spark), f"stored_{uuid.uuid4().hex}"
        if buckets:
            n = count or spark.sparkContext.defaultParallelism
            rows().repartition(n, *buckets).write.bucketBy(n, *buckets).option("path", path).saveAsTable(name)
        else:
            rows().write.partitionBy(*by or []).parquet(path)
        _stored[key] = (path, name if buckets else None)
    path, name = _stored[key]
    return spark.table(name) if name else spark.read.parquet(path)


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there, where several reads must see the same run."""
    path = own_folder(rows.sparkSession)
    rows.write.parquet(path)
    _stored[(rows.sparkSession.sparkContext.applicationId, path)] = (path, None)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def forget(spark: SparkSession) -> None:
    """Delete what ``written_once`` has written in this application."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        folder, name = _stored.pop(key)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master where it is unset, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cipherscape-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")
