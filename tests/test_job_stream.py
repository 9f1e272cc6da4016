"""Jobs as a stateful stream against a plain walk over each job's events."""

from collections import defaultdict
from datetime import datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from cipherscape.functions import vocab
from cipherscape.operators import lifecycle
from cipherscape.streaming import jobs

START = datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp, seq long, wanted string"


def _plain(rows, now, stale, most=3):
    found, held = {}, defaultdict(list)
    for job, ts, seq, wanted in rows:
        if job is not None and ts is not None:
            held[job].append((ts, seq, wanted))
    for job, events in held.items():
        status, tries, bad, freed, lock = "QUEUED", 0, 0, 0, None
        for ts, _, wanted in sorted(events, key=lambda e: e[:2]) + [(now, None, "end")]:
            if lock and ts - lock > stale:
                status, freed, lock = "QUEUED", freed + 1, None
            if wanted == "end":
                break
            wanted = "QUEUED" if wanted == "FAILED" and tries < most else wanted
            if (status, wanted) not in vocab.JOB_MOVES:
                bad += 1
                continue
            status, lock = wanted, ts if wanted == "RUNNING" else None
            tries += wanted == "RUNNING"
        found[job] = (status, tries, bad, freed)
    return found


def _run(spark, folder, batches, stale, late="10 minutes"):
    """Each batch is a stream of its own that goes on from the checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.write_changes(jobs.job_changes(stream, stale, late), f"{folder}/out", f"{folder}/check").awaitTermination()
    rows = jobs.jobs_table(spark, f"{folder}/out").collect()
    return {r.job_id: (r.status, r.attempt_count, r.rejected, r.reclaimed) for r in rows}


def _rows(n, seed=1):
    draw = Random(seed)
    times = sorted(START + timedelta(seconds=draw.randrange(40_000)) for _ in range(n))
    names = ["RUNNING", "RUNNING", "COMPLETED", "FAILED", "QUEUED", "CANCELLED", "nonsense", None]
    return [("hot" if k % 3 == 0 else f"j{draw.randrange(30)}", ts, k, draw.choice(names)) for k, ts in enumerate(times)]


def test_restarts_and_the_order_of_arrival_change_nothing(spark, tmp_path):
    rows = _rows(240)
    end = ("tick", START + timedelta(days=1), 10_000, "x")
    want = _plain(rows, START + timedelta(days=1) - timedelta(hours=2), timedelta(minutes=15))
    parts = [Random(2).sample(p, len(p)) for p in (rows[:120], rows[120:])]
    got = _run(spark, f"{tmp_path}/a", [*parts, [end]], "15 minutes", "2 hours")
    got.pop("tick", None)
    assert got == want and sum(v[3] for v in want.values()) > 5
    one = _run(spark, f"{tmp_path}/b", [[*rows, end]], "15 minutes", "2 hours")
    one.pop("tick", None)
    assert one == want


def test_without_stale_locks_it_equals_the_batch_fold(spark, tmp_path):
    rows = _rows(150, 3)
    got = _run(spark, str(tmp_path), [[*rows, (None, None, 0, "RUNNING"), ("hot", None, 0, "RUNNING")], [(None, START + timedelta(days=9), 0, None)]], "99 days")
    table = spark.createDataFrame(rows, SCHEMA).select("job_id", F.struct("ts", "seq").alias("seq"), "wanted")
    want = {r.job_id: (r.status, r.attempt_count, r.rejected, 0) for r in lifecycle.replay_jobs(table).collect()}
    assert got == want


def test_a_lock_held_just_long_enough_stays(spark, tmp_path):
    rows = [("a", START, 1, "RUNNING"), ("a", START + timedelta(minutes=15), 2, "COMPLETED"), ("b", START, 3, "RUNNING"), ("b", START + timedelta(minutes=15, microseconds=1), 4, "COMPLETED")]
    got = _run(spark, str(tmp_path), [rows, [(None, START + timedelta(days=1), 0, None)]], "15 minutes")
    assert got == {"a": ("COMPLETED", 1, 0, 0), "b": ("QUEUED", 1, 1, 1)}
