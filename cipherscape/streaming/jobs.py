"""Jobs as a stateful stream: claims, endings and stale locks in event time.

Each job keeps its state and the events that the watermark hasn't passed yet.  When it
has passed them they are applied in order of (ts, seq), whatever order they came in, and
a lock that runs out is a timer of the job's own.  So the table doesn't depend on how
events were cut into batches, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cipherscape.functions import vocab
from cipherscape.operators.lifecycle import MAX_ATTEMPTS

_STATE = "status string, attempts long, rejected long, reclaimed long, locked long"
_CHANGES = "status string, attempt_count long, rejected long, reclaimed long, as_of timestamp"
_FREE = -1  # no lock
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    """``stale`` is in microseconds, as all times here but those of timers."""

    def __init__(self, key: str, stale: int, max_attempts: int):
        self.key, self.stale, self.max_attempts = key, stale, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)
        self.pending = handle.getListState("pending", "at long, seq long, wanted string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows if key[0] is not None else ():
            new = list(zip(part["at"].tolist(), part["seq"].tolist(), part["wanted"].fillna("").tolist(), strict=True))
            self.pending.appendList(new)
            self.handle.registerTimer(_due(min(at for at, _, _ in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        before = self.job.get() if self.job.exists() else ("QUEUED", 0, 0, 0, _FREE)
        waiting = sorted(self.pending.get()) if self.pending.exists() else []
        ripe = [e for e in waiting if e[0] <= now]
        state = before
        for at, _, wanted in ripe:
            state = self.moved(self.unlocked(state, at), at, wanted)
        state = self.unlocked(state, now)
        if ripe:
            if later := waiting[len(ripe) :]:
                self.pending.put(later)
                self.handle.registerTimer(_due(later[0][0]))
            else:
                self.pending.clear()
        if not ripe and state == before:
            return
        self.job.update(state)
        if state[4] != _FREE:
            self.handle.registerTimer(_due(state[4] + self.stale + 1))
        yield pd.DataFrame({self.key: [key[0]], **{n: [v] for n, v in zip(("status", "attempt_count", "rejected", "reclaimed"), state[:4], strict=True)}, "as_of": [pd.Timestamp(now, unit="us")]})

    def unlocked(self, state: tuple, now: int) -> tuple:
        """A lock older than ``stale`` is given up."""
        status, attempts, rejected, reclaimed, locked = state
        return ("QUEUED", attempts, rejected, reclaimed + 1, _FREE) if locked != _FREE and now - locked > self.stale else state

    def moved(self, state: tuple, at: int, wanted: str) -> tuple:
        """One event, by the table of moves; a failure with attempts left queues the job again."""
        status, attempts, rejected, reclaimed, locked = state
        if wanted == "FAILED" and attempts < self.max_attempts:
            wanted = "QUEUED"
        if (status, wanted) not in vocab.JOB_MOVES:
            return (status, attempts, rejected + 1, reclaimed, locked)
        return (wanted, attempts + 1, rejected, reclaimed, at) if wanted == "RUNNING" else (wanted, attempts, rejected, reclaimed, _FREE)


def _due(at: int) -> int:
    """The first millisecond at or after a time."""
    return -(-at // 1000)


def job_changes(events: DataFrame, stale: str = "15 minutes", late: str = "10 minutes", max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Stream of (job_id, status, attempt_count, rejected, reclaimed, as_of) from a stream of (job_id, ts, seq, wanted).

    A row says how a job stands once the watermark has passed ``as_of``.  A job is queued at first; its
    lock is given up when it is held for longer than ``stale``.  Moves that the table doesn't have count as rejected, null
    ones too.  Events without a job or a time move nothing but the watermark; events later than ``late`` are passed over, as with
    any watermark (``lifecycle.replay_jobs`` folds whole logs).
    """
    micros = int(pd.Timedelta(stale) / pd.Timedelta(1, "us"))
    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), ts.alias("ts"), F.unix_micros(ts).alias("at"), F.coalesce(F.col("seq").cast("long"), F.lit(-1)).alias("seq"), F.col("wanted").cast("string").alias("wanted"))
    rows = rows.withWatermark("ts", late).filter("ts is not null")  # a filter on the job would be pushed below the watermark
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs("job_id", micros, max_attempts), f"job_id string, {_CHANGES}", outputMode="Update", timeMode="EventTime")


def write_changes(changes: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Changes written below ``folder``, a batch a folder that is replaced when the batch runs again; returns the running query."""
    conf = changes.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, _ROCKS)  # the query copies the session's settings when it starts
    try:
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        writer = changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        conf.set(_STORE, before)


def jobs_table(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each job."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("job_id", "batch")]), "batch")
    return rows.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
