"""The inventory as a store: scan a source, then read findings and move reviews on.

Methods return DataFrames; what they write goes to a store below ``root``, each commit
visible as a whole.  Reviews are a log of requests, folded when read.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cipherscape import errors
from cipherscape.functions import vocab
from cipherscape.operators import derive, discovery, lifecycle, parse, persist, rules
from cipherscape.plans import read

SCANS = (
    "id string, provider string, owner string, name string, commit_sha string, parser_version string, ruleset_version string, pqc_ruleset_version string, status string, "
    "source_state string, file_count long, analyzed_file_count long, skipped_file_count long, finding_count long, created_at double, started_at double, completed_at double, error_code string, error_message string"
)
JOBS = (
    "id string, scan_id string, status string, attempt_count int, max_attempts int, locked_at double, locked_by string, started_at double, completed_at double, last_error string, created_at double"
)
AUDIT = "scan_id string, finding_id string, event_type string, metadata string, created_at double"
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
REQUESTS = "review_id string, status string, assigned_to string, note string"
STALE_SECONDS = 900



def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Inventory:
    """``resolve`` turns a short commit reference into the full one; ``fetch`` gives the files of a commit.

    A scan, its job, its findings and its audit events move in one commit of the store.  A scan or job is a run of one row, replaced
    by each move, which expects the row that it read: of two workers that claim a job at once, one gets it.
    """

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[str, str, str], DataFrame], resolve: Callable[[str, str, str], str] | None = None):
        self.spark, self.root, self.fetch, self.resolve = spark, root.rstrip("/"), fetch, resolve
        self.store = persist.Store(spark, self.root)

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name)

    # -- writing -------------------------------------------------------------------

    def create(self, url: str, reference: str, attempts: int = lifecycle.MAX_ATTEMPTS) -> dict:
        """Queue the scan of a commit, or reuse the completed scan of equal identity."""
        try:
            owner, name = discovery.parse_repository(url)
        except ValueError:
            raise errors.InvalidRepositoryUrl(url) from None
        wanted = reference.strip().lower()
        if not re.fullmatch("[0-9a-f]{7,40}", wanted):
            raise errors.InvalidCommitSha(reference)
        commit = wanted if len(wanted) == 40 or self.resolve is None else self.resolve(owner, name, wanted)
        if not commit.startswith(wanted):
            raise errors.IngestionFailed("the resolved commit is another one")
        identity = ("github", owner, name, commit, vocab.PARSER_VERSION, vocab.RULESET_VERSION, vocab.PQC_VERSION)
        same = [F.col(c) == F.lit(v) for c, v in zip(lifecycle.IDENTITY, identity, strict=True)]
        old = self._numbered("scans", SCANS).filter(reduce(Column.__and__, same, F.col("status") == "COMPLETED")).orderBy("created_at", "id").first()
        if old is not None:
            self._move([("scans", old, {"source_state": "CACHED_REAL"})], [(old.id, "SCAN_CREATED", {"cached": True})])
            return {"scan_id": old.id, "cached": True, "http_status": 200}
        scan = self.spark.range(1).select(derive.hashed(*map(F.lit, identity)).alias("id")).first().id
        before = self._numbered("scans", SCANS).filter(F.col("id") == scan).first()  # a scan that failed starts anew under its id
        if before is not None and before.status not in TERMINAL:
            return {"scan_id": scan, "cached": False, "http_status": 202}
        now = time.time()
        row = Row(**dict.fromkeys(_names(SCANS)) | {"id": scan} | dict(zip(lifecycle.IDENTITY, identity, strict=True)), number=before.number if before else None)
        job = Row(**dict.fromkeys(_names(JOBS)) | {"id": uuid.uuid4().hex, "scan_id": scan, "attempt_count": 0, "max_attempts": attempts}, number=None)
        moves = [("scans", row, {"status": "QUEUED", "source_state": "UNAVAILABLE", "created_at": now}), ("jobs", job, {"status": "QUEUED", "created_at": now})]
        self._move(moves, [(scan, "SCAN_CREATED", {"cached": False})])
        return {"scan_id": scan, "cached": False, "http_status": 202}

    def submit(self, url: str, reference: str) -> dict:
        """``create``, and run the scan at once, with one attempt."""
        made = self.create(url, reference, attempts=1)
        if not made["cached"]:
            error = self._work(made["scan_id"], "submit")
            if error is not None:
                raise error
        return made

    def run_once(self, worker: str) -> bool:
        """Claim the oldest queued job and run it to its end; False where none waits.  A failure queues it again, or fails it after its attempts."""
        job = self.jobs().filter("status = 'QUEUED'").orderBy("created_at", "id").first()
        if job is None:
            return False
        self._work(job.scan_id, worker)
        return True

    def _work(self, scan: str, worker: str) -> BaseException | None:
        job = self._numbered("jobs", JOBS).filter((F.col("scan_id") == scan) & (F.col("status") == "QUEUED")).orderBy("created_at", "id").first()
        row = self._numbered("scans", SCANS).filter(F.col("id") == scan).first()
        if job is None or row is None:
            return None
        now = time.time()
        try:
            taken = [("jobs", job, {"status": "RUNNING", "attempt_count": job.attempt_count + 1, "locked_at": now, "locked_by": worker, "started_at": now})]
            job, row = self._move([*taken, ("scans", row, {"status": "RUNNING", "started_at": now})], [(scan, "SCAN_STARTED", {})])
        except persist.Conflict:  # another worker has it
            return None
        try:
            self.execute(row, job)
        except persist.Conflict as error:  # the job was taken from us meanwhile
            return error
        except Exception as error:
            code, message = errors.safe(error)
            done = {"locked_at": None, "locked_by": None, "last_error": message}
            if job.attempt_count < job.max_attempts:
                self._move([("jobs", job, done | {"status": "QUEUED", "started_at": None}), ("scans", row, {"status": "QUEUED", "started_at": None})], [])
            else:
                now = time.time()
                failed = {"status": "FAILED", "error_code": code, "error_message": message, "completed_at": now}
                self._move([("jobs", job, done | {"status": "FAILED", "completed_at": now}), ("scans", row, failed)], [(scan, "SCAN_FAILED", {"error_code": code, "attempts": job.attempt_count})])
            return error
        return None

    def execute(self, row: Row, job: Row | None = None) -> None:
        """Run a scan; one that has ended is left alone.  Its results and its end are one commit; an error leaves it as it is, for the worker to decide."""
        if row.status in TERMINAL:
            return
        files = self.fetch(row.owner, row.name, row.commit_sha).withColumn("snapshot_id", F.lit(row.id))
        parsed = parse.parse_files(discovery.supported(files), ("imports", "symbols", "calls", "names", "assignments", "annotations")).persist()
        try:
            found = derive.findings(rules.matches(parsed), parsed, F.lit(f"github/{row.owner}/{row.name}"))
            written = self.store.stage(persist.relations(found))
            total = discovery.summary(discovery.classify(files)).first()
        finally:
            parsed.unpersist()
        n = self.store.staged("findings", written["findings"]).count()
        counts = {"file_count": total.total_files if total else 0, "analyzed_file_count": total.analyzed_files if total else 0, "skipped_file_count": total.skipped_files if total else 0, "finding_count": n}
        now = time.time()
        moves = [("scans", row, {"status": "COMPLETED", "source_state": "LIVE", "completed_at": now, **counts})]
        if job is not None:
            moves.append(("jobs", job, {"status": "COMPLETED", "completed_at": now, "locked_at": None, "locked_by": None}))
        self._move(moves, [(row.id, "SCAN_COMPLETED", counts)], [(name, row.id, w) for name, w in written.items()])

    def reclaim(self, now: float | None = None) -> int:
        """Queue jobs again whose worker has held them too long; the number of them."""
        old = self._numbered("jobs", JOBS).filter((F.col("status") == "RUNNING") & (F.col("locked_at") < (now or time.time()) - STALE_SECONDS)).collect()
        for job in old:
            row = self._numbered("scans", SCANS).filter(F.col("id") == job.scan_id).first()
            self._move([("jobs", job, {"status": "QUEUED", "locked_at": None, "locked_by": None, "last_error": "the worker's lock ran out"}), ("scans", row, {"status": "QUEUED"})], [])
        return len(old)

    def scans(self) -> DataFrame:
        """Every scan as it stands."""
        return self.store.read("scans", SCANS)

    def jobs(self) -> DataFrame:
        return self.store.read("jobs", JOBS)

    def _numbered(self, name: str, schema: str) -> DataFrame:
        return self.store.read(name, schema, numbered=True)

    def _move(self, rows: list[tuple[str, Row, dict]], events: list[tuple[str, str, dict]], more: list[tuple[str, str, tuple[str, str]]] = ()) -> list[Row]:
        """Change rows of scans and jobs, add audit events and make ``more`` visible, in one commit; the rows as they are then."""
        schemas, runs, changed = {"scans": SCANS, "jobs": JOBS}, list(more), []
        expected = {(table, row.id): row.number for table, row, _ in rows}
        for table, row, change in rows:
            known = {k: v for k, v in row.asDict().items() if k in _names(schemas[table])} | change
            written = self.store.stage({table: self.spark.createDataFrame([tuple(known[c] for c in _names(schemas[table]))], schemas[table]).coalesce(1)})
            runs.append((table, row.id, written[table]))
            changed.append(known)
        if events:
            now = time.time()
            log = self.spark.createDataFrame([(scan, None, kind, json.dumps(data), now) for scan, kind, data in events], AUDIT).coalesce(1)
            runs.append(("audit_log", uuid.uuid4().hex, self.store.stage({"audit_log": log})["audit_log"]))
        number = self.store.commit(runs, expected)
        return [Row(**known, number=number) for known in changed]

    def audit(self) -> DataFrame:
        """Scan events with the ``number`` of their commit, which orders them."""
        return self.store.read("audit_log", AUDIT, numbered=True).drop("run")

    def update_review(self, review_id: str, status: str | None = None, assigned_to: str | None = None, note: str | None = None) -> DataFrame:
        """Change a review's fields; a null leaves a field alone, an illegal move is an error."""
        current = self.reviews().filter(F.col("id") == review_id).first()
        if current is None:
            raise errors.ReviewItemNotFound(review_id)
        if status is not None and status not in vocab.REVIEW_STATUSES:
            raise ValueError(status)
        if status not in (None, current.status) and (current.status, status) not in vocab.REVIEW_MOVES:
            raise errors.InvalidReviewTransition(f"{current.status} to {status}")
        asked = self.store.stage({"review_requests": self.spark.createDataFrame([(review_id, status, assigned_to, note)], REQUESTS).coalesce(1)})
        self.store.commit([("review_requests", uuid.uuid4().hex, asked["review_requests"])])  # its number orders requests, also when two come at once
        return self.reviews().filter(F.col("id") == review_id)

    # -- reading -------------------------------------------------------------------

    def reviews(self) -> DataFrame:
        """Review items with all requests folded in."""
        moved = lifecycle.replay_reviews(self.store.read("review_requests", REQUESTS, numbered=True).withColumn("seq", F.col("number"))).select(
            F.col("review_id").alias("id"), F.col("status").alias("_s"), F.col("assigned_to").alias("_a"), F.col("note").alias("_n")
        )
        items = self._table("review_items").join(moved, "id", "left")
        return items.select("id", "finding_id", F.coalesce("_s", "status").alias("status"), F.coalesce("_a", "assigned_to").alias("assigned_to"), F.coalesce("_n", "note").alias("note"))

    def scan(self, scan_id: str) -> DataFrame:
        found = self.scans().filter(F.col("id") == scan_id)
        if found.isEmpty():
            raise errors.ScanNotFound(scan_id)
        named = found.withColumn("repository_id", F.lit("r"))
        return read.scan_details(named, found.select(F.lit("r").alias("id"), "provider", "owner", "name"))

    def findings(self, scan_id: str, page: int = 1, size: int = read.PAGE_SIZE, **filters: str | None) -> read.Page:
        self.scan(scan_id)
        return read.findings_page(self._table("findings"), scan_id, page, size, self.reviews(), **filters)

    def finding(self, finding_id: str) -> DataFrame:
        one = self._table("findings").filter(F.col("id") == finding_id)
        if one.isEmpty():
            raise errors.FindingNotFound(finding_id)
        mine = F.col("finding_id") == finding_id
        scans = self.scans().withColumn("repository_id", F.col("id"))
        repositories = self.scans().select("id", "provider", "owner", "name")
        return read.details(one, self._table("evidence").filter(mine), self._table("impact_nodes").filter(mine), self.reviews().filter(mine), scans, repositories)

    def queue(self, page: int = 1, size: int = read.PAGE_SIZE, **filters: str | None) -> read.Page:
        return read.queue_page(self.reviews(), self._table("findings"), page, size, **filters)
