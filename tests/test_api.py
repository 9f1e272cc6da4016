import pytest
from pyspark.sql import functions as F

from cipherscape import errors
from cipherscape.plans.api import Inventory
from cipherscape.sources import templates

SHA = "0123456789abcdef0123456789abcdef01234567"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    calls = []

    def fetch(owner, name, commit):
        calls.append(commit)
        return templates.corpus(spark.range(len(templates.TEMPLATES)).withColumnRenamed("id", "k"), "k")

    inventory = Inventory(spark, f"file://{tmp_path_factory.mktemp('store')}", fetch, lambda owner, name, short: SHA)
    inventory.calls = calls
    inventory.first = inventory.submit("https://github.com/own/repo.git", SHA[:9])
    return inventory


def test_scan_and_reuse(store):
    assert store.first["http_status"] == 202
    again = store.submit("https://github.com/own/repo", SHA)
    assert again == {"scan_id": store.first["scan_id"], "cached": True, "http_status": 200} and store.calls == [SHA]
    scan = store.scan(again["scan_id"]).first()
    expected = {(k, e) for k, t in enumerate(templates.TEMPLATES) for e in t.expected}
    assert scan.statistics.file_count == len(templates.TEMPLATES) and scan.statistics.finding_count <= len(expected)
    assert (scan.repository.owner, scan.status) == ("own", "COMPLETED")


def test_pages_and_details(store):
    scan = store.first["scan_id"]
    page = store.findings(scan, page=1, size=5, algorithm="Ed25519")
    assert page.meta.first().total == 3 and [r.priority for r in page.items.collect()] == ["HIGH"] * 3  # two signatures share an identity
    one = store.findings(scan, size=1).items.first()
    detail = store.finding(one.id).first()
    assert detail.repository.owner == "own" and detail.commit_sha == SHA and detail.migration.rationale and one.review_status == "OPEN"
    assert [n.node_type for n in detail.impact.nodes][-1] == "FILE" and [n.node_type for n in detail.impact.nodes][0] == "API"
    assert detail.observed.algorithm == one.algorithm and detail.observed.source_excerpt and detail.review.status == "OPEN"
    with pytest.raises(errors.ScanNotFound):
        store.findings("none")
    with pytest.raises(errors.FindingNotFound) as e:
        store.finding("none")
    assert e.value.body()["error"]["code"] == "FINDING_NOT_FOUND" and e.value.status == 404


def test_reviews_move_on(store):
    review = store.queue(size=1).items.first().review_id
    with pytest.raises(errors.InvalidReviewTransition):
        store.update_review(review, status="REVIEWED")
    assert store.update_review(review, status="IN_REVIEW", assigned_to="me").first().assigned_to == "me"
    assert store.update_review(review, note="seen").first().status == "IN_REVIEW"
    assert store.queue(review_status="IN_REVIEW").items.select("review_id", "note").collect() == [(review, "seen")]
    with pytest.raises(errors.ReviewItemNotFound):
        store.update_review("none")
    with pytest.raises(ValueError):
        store.queue(priority="URGENT")


def test_scans_have_a_life(spark, tmp_path):
    attempts = []

    def fetch(owner, name, commit):
        attempts.append(name)
        if name == "down":
            raise errors.IngestionFailed("the host is away")
        if name == "odd" and len(attempts) < 3:
            raise RuntimeError("a secret path")
        return templates.corpus(spark.range(4).withColumnRenamed("id", "k"), "k")

    store = Inventory(spark, f"file://{tmp_path}/life", fetch)
    with pytest.raises(errors.IngestionFailed):
        store.submit("https://github.com/own/down", SHA)
    with pytest.raises(RuntimeError):
        store.submit("https://github.com/own/odd", SHA)
    found = {r.name: r for r in store.scans().collect()}
    assert (found["down"].status, found["down"].error_code, found["down"].error_message) == ("FAILED", "INGESTION_FAILED", "the host is away")
    assert (found["odd"].status, found["odd"].error_code, found["odd"].error_message) == ("FAILED", "SCAN_EXECUTION_FAILED", "Scan execution failed.")
    scan = store.submit("https://github.com/own/odd", SHA)["scan_id"]  # under the same id, and its findings once
    n = store.findings(scan).meta.first().total
    assert store.scan(scan).first().status == "COMPLETED" and n == store._table("findings").filter(F.col("scan_id") == scan).select("fingerprint").distinct().count() > 0
    row = store.scans().filter(F.col("id") == scan).first()
    store.execute(row)
    assert len(attempts) == 3  # an ended scan is left alone
    assert store.submit("https://github.com/own/odd", SHA)["cached"] and store.scan(scan).first().source_state == "CACHED_REAL"
    events = [r.event_type for r in spark.read.parquet(f"{store.root}/audit_log").filter(F.col("scan_id") == scan).orderBy("created_at").collect()]
    assert events == ["SCAN_CREATED", "SCAN_STARTED", "SCAN_FAILED", "SCAN_CREATED", "SCAN_STARTED", "SCAN_COMPLETED", "SCAN_CREATED"]


def test_bad_requests(store):
    with pytest.raises(errors.InvalidRepositoryUrl):
        store.submit("http://github.com/a/b", SHA)
    with pytest.raises(errors.InvalidCommitSha):
        store.submit("https://github.com/a/b", "xyz")
    with pytest.raises(errors.IngestionFailed):
        store.submit("https://github.com/a/b", "fffffff")
    assert store.spark.range(1).select(F.lit(1)).count() == 1


def test_a_worker_retries_then_fails(spark, tmp_path):
    attempts = []

    def fetch(owner, name, commit):
        attempts.append(name)
        if name == "down" or len(attempts) < 3:
            raise errors.IngestionFailed("the host is away")
        return templates.corpus(spark.range(3).withColumnRenamed("id", "k"), "k")

    store = Inventory(spark, f"file://{tmp_path}/jobs", fetch)
    assert not store.run_once("w")
    made = store.create("https://github.com/own/flaky", SHA)
    assert store.create("https://github.com/own/flaky", SHA) == made and store.jobs().count() == 1  # it is on its way
    for n in (1, 2):
        assert store.run_once("w")
        job, scan = store.jobs().first(), store.scans().first()
        assert (job.status, job.attempt_count, job.locked_by, job.started_at, job.last_error) == ("QUEUED", n, None, None, "the host is away")
        assert (scan.status, scan.started_at, scan.error_code) == ("QUEUED", None, None)
    assert store.run_once("w") and not store.run_once("w")
    job, scan = store.jobs().first(), store.scans().first()
    assert (job.status, job.attempt_count, scan.status, scan.source_state) == ("COMPLETED", 3, "COMPLETED", "LIVE") and scan.completed_at >= scan.started_at
    assert scan.finding_count == store._table("findings").count() == store._table("evidence").count() == store._table("review_items").count() > 0
    events = [r.event_type for r in store.audit().orderBy("number").collect()]
    assert events == ["SCAN_CREATED", *["SCAN_STARTED"] * 3, "SCAN_COMPLETED"]
    down = store.create("https://github.com/own/down", SHA)["scan_id"]
    for _ in range(3):
        store.run_once("w")
    scan = store.scans().filter(F.col("id") == down).first()
    assert not store.run_once("w") and (scan.status, scan.error_code) == ("FAILED", "INGESTION_FAILED")
    assert store.audit().filter("event_type = 'SCAN_FAILED'").first().metadata == '{"error_code": "INGESTION_FAILED", "attempts": 3}'
    assert store._table("findings").filter(F.col("scan_id") == down).count() == 0


def test_a_lost_worker_and_two_at_once(spark, tmp_path):
    other = []

    def fetch(owner, name, commit):
        if not other:  # while this worker runs, its lock runs out and another finishes the job
            other.append(1)
            late = Inventory(spark, store.root, fetch)
            assert late.reclaim(now=4e9) == 1 and late.run_once("second")
        return templates.corpus(spark.range(3).withColumnRenamed("id", "k"), "k")

    store = Inventory(spark, f"file://{tmp_path}/two", fetch)
    store.create("https://github.com/own/repo", SHA)
    assert store.run_once("first")
    job = store.jobs().first()
    assert (job.status, job.attempt_count) == ("COMPLETED", 2)
    events = [r.event_type for r in store.audit().orderBy("number").collect()]
    assert events == ["SCAN_CREATED", "SCAN_STARTED", "SCAN_STARTED", "SCAN_COMPLETED"]  # the first worker's results came too late
    assert store._table("findings").groupBy("id").count().filter("count > 1").count() == 0


def test_reasons_are_derived_once(spark, sf_dir):
    """No filter below the explode works out priorities a second time."""
    from cipherscape.plans import queries

    plan = queries.priority_reasons(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("quantum computer breaks") == 1


def test_findings_are_derived_of_those_that_stay(spark, sf_dir):
    """Of an identity's observations all but the first go before priorities and nodes are derived, so no sort holds those."""
    from cipherscape.plans import queries

    plan = queries._unique(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "quantum computer breaks" in plan.partition("Window [row_number()")[0]
    assert "quantum computer breaks" not in plan.partition("Window [row_number()")[2]
