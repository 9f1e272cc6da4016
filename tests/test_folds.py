"""Folds of event logs whose keys span partitions, deep pages, short references."""

import random

import pytest
from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators import discovery, lifecycle
from cipherscape.plans import read


def plain_job(wanted, most=3):
    status, attempts, rejected = "QUEUED", 0, 0
    for w in wanted:
        w = "QUEUED" if w == "FAILED" and attempts < most else w
        if (status, w) in vocab.JOB_MOVES:
            status, attempts = w, attempts + (w == "RUNNING")
        else:
            rejected += 1
    return status, attempts, rejected


def plain_review(asked):
    status, who, note, counts = "OPEN", None, None, [0, 0, 0]
    for s, a, n in asked:
        to = s or status
        if to != status and (status, to) not in vocab.REVIEW_MOVES:
            counts[0] += 1
            continue
        counts[1] += to != status and to == "IN_REVIEW"
        counts[2] += to != status and to == "REVIEWED"
        status, who, note = to, a or who, n or note
    return status, who, note, *counts


@pytest.fixture(scope="module")
def logs():
    """A key with half of all events, and many with a few."""
    r = random.Random(3)
    keys = [0] * 3000 + [r.randrange(1, 200) for _ in range(3000)]
    r.shuffle(keys)
    jobs = [(k, seq, r.choice(["RUNNING", "RUNNING", "QUEUED", "FAILED"] + (["COMPLETED", None] if k else []))) for seq, k in enumerate(keys)]
    reviews = [(k, seq, r.choice([None, *vocab.REVIEW_STATUSES]), r.choice([None, f"u{seq}"]), r.choice([None, None, f"n{seq}"])) for seq, k in enumerate(keys)]
    return jobs, reviews


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_folds_equal_plain_ones_whatever_the_partitions(spark, logs, partitions):
    jobs, reviews = logs
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.job_id: (r.status, r.attempt_count, r.rejected) for r in lifecycle.replay_jobs(spark.createDataFrame(jobs, "job_id long, seq long, wanted string")).collect()}
        assert got == {k: plain_job([w for key, _, w in jobs if key == k]) for k in {j[0] for j in jobs}}
        asked = spark.createDataFrame(reviews, "review_id long, seq long, status string, assigned_to string, note string")
        got = {r.review_id: (r.status, r.assigned_to, r.note, r.rejected, r.started, r.completed) for r in lifecycle.replay_reviews(asked).collect()}
        assert got == {k: plain_review([x[2:] for x in reviews if x[0] == k]) for k in {x[0] for x in reviews}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_a_hot_key_is_many_tasks(spark, logs):
    events = spark.createDataFrame(logs[0], "job_id long, seq long, wanted string").repartitionByRange(16, "job_id", "seq")
    assert events.filter("job_id = 0").select(F.spark_partition_id()).distinct().count() >= 7


def test_no_events(spark):
    assert lifecycle.replay_jobs(spark.createDataFrame([], "job_id long, seq long, wanted string")).collect() == []


def test_deep_pages_read_their_block_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(read, "BLOCK", 1000)
    rows = spark.range(30_000).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("scan_id"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.lit("HIGH").alias("priority"), F.lit("LOW").alias("confidence"),
        F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("file_path"), (F.col("id") % 9).alias("start_line"),
    )
    read.page_index(rows).write.partitionBy("block").parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for page in (1, 5, 6, 33, 50, 51):
        got, want = read.indexed_page(index, "s1", page, 200), read.paged(rows.filter("scan_id = 's1'"), read.findings_order(), page, 200)
        assert [r.fingerprint for r in got.items.collect()] == [r.fingerprint for r in want.items.collect()]
        assert got.meta.first() == want.meta.first()
        assert got.items.select(F.input_file_name()).distinct().count() <= 2
    plan = read.indexed_page(index, "s1", 50, 200).items._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "GreaterThanOrEqual(place,9801)" in plan
    with pytest.raises(ValueError):
        read.indexed_page(index, "s1", 0)


def test_short_references(spark):
    a, b = "ab" * 20, "ab" * 10 + "cd" * 10
    commits = spark.createDataFrame([("r", a), ("r", b), ("r", b.upper()), ("q", "ef" * 20), (None, a)], "repo string, sha string")
    asked = [("r", a), ("r", a.upper()), ("r", "f" * 40), ("r", a[:21]), ("r", a[:20]), ("r", f" {b[:22].upper()} "), ("q", a[:21]), ("q", "efefefe"), ("r", "abab"), ("r", "xyzxyzx"), ("r", None), (None, a[:21]), ("r", a[:21])]
    rows = discovery.resolved(spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "k int, repo string, ref string"), commits, "repo").orderBy("k").collect()
    assert [(r.sha, r.problem) for r in rows] == [
        (a, None), (a, None), ("f" * 40, None), (a, None), (None, "AMBIGUOUS"), (b, None), (None, "NOT_FOUND"), ("ef" * 20, None), (None, "INVALID"), (None, "INVALID"), (None, "INVALID"), (None, "NOT_FOUND"), (a, None),
    ]


def test_places_are_of_one_run(spark):
    """Rows that come in another order each time give other ranges; numbers of rows and counts of partitions must be of one run."""

    def shuffled(batches):
        for batch in batches:
            yield batch.take(random.sample(range(batch.num_rows), batch.num_rows))

    rows = spark.range(60_000).select((F.col("id") % 3).alias("scan"), F.xxhash64("id").alias("x"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = read.places(rows.mapInArrow(shuffled, rows.schema), "scan", [F.col("x")], "place").select("scan", "x", "text", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for scan in range(3):
        mine = sorted((r.x, r.place) for r in got if r.scan == scan)
        assert [p for _, p in mine] == list(range(1, 20_001))
