"""Scans, jobs and reviews as state: a snapshot and events give the next snapshot.

Spark has no row updates; each function takes DataFrames and returns new ones.
Moves are checked against transition tables by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherscape.functions import vocab

MAX_ATTEMPTS = 3
STALE = "INTERVAL 15 MINUTES"
IDENTITY = ["provider", "owner", "name", "commit_sha", "parser_version", "ruleset_version", "pqc_ruleset_version"]


def with_validity(moves: DataFrame, allowed: list[tuple[str, str]], same_is_valid: bool) -> DataFrame:
    """is_valid for rows of (current, wanted): a join with the transition table."""
    table = vocab.rows_of(moves.sparkSession, allowed, "current,wanted").withColumn("_ok", F.lit(True))
    found = moves.join(F.broadcast(table), ["current", "wanted"], "left")
    same = (F.col("current") == F.col("wanted")) & F.lit(same_is_valid)
    return found.withColumn("is_valid", F.coalesce(F.col("_ok"), F.lit(False)) | same).drop("_ok")


def claim(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    """The oldest queued job starts to run; the others stay as they are."""
    first = jobs.filter("status = 'QUEUED'").orderBy("created_at", "id").limit(1).select(F.col("id").alias("_first"))
    rows = jobs.join(F.broadcast(first), F.col("id") == F.col("_first"), "left")
    mine = F.col("_first").isNotNull()
    return rows.select(*[
        {
            "status": F.when(mine, "RUNNING").otherwise(F.col("status")), "attempt_count": F.col("attempt_count") + mine.cast("int"),
            "locked_at": F.when(mine, now).otherwise(F.col("locked_at")), "locked_by": F.when(mine, worker).otherwise(F.col("locked_by")),
            "started_at": F.when(mine, now).otherwise(F.col("started_at")),
        }.get(c, F.col(c)).alias(c)
        for c in jobs.columns
    ])


def finish(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Running jobs with an outcome (id, error): completed, queued again, or failed after max_attempts."""
    rows = jobs.join(outcomes.select(F.col("id").alias("_id"), F.col("error").alias("_error")), F.col("id") == F.col("_id"), "left")
    done = F.col("_id").isNotNull() & (F.col("status") == "RUNNING")
    failed = done & F.col("_error").isNotNull()
    retry = failed & (F.col("attempt_count") < F.col("max_attempts"))
    status = F.when(retry, "QUEUED").when(failed, "FAILED").when(done, "COMPLETED").otherwise(F.col("status"))
    new = {
        "status": status, "last_error": F.when(failed, F.col("_error")).otherwise(F.col("last_error")),
        "locked_at": F.when(~done, F.col("locked_at")), "locked_by": F.when(~done, F.col("locked_by")),
        "completed_at": F.when(done & ~retry, now).otherwise(F.col("completed_at")), "started_at": F.when(~retry, F.col("started_at")),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def settle(jobs: DataFrame, scans: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, scans, audit events) after running jobs ended with ``outcomes`` (id of the job, error_code, error): both move together.

    A failure with attempts left queues the job and its scan again; the last one fails both, with a code and message.
    """
    error = F.coalesce("error", F.when(F.col("error_code").isNotNull(), F.lit("")))
    after = finish(jobs, outcomes.select("id", error.alias("error")), now)
    ended = jobs.filter("status = 'RUNNING'").select("id", "scan_id", F.col("attempt_count").alias("_n"), F.col("max_attempts").alias("_most"))
    ended = ended.join(outcomes.select("id", "error_code", error.alias("_error")), "id")
    failed = F.col("_error").isNotNull()
    ended = ended.select("scan_id", "_n", "error_code", "_error", F.when(failed & (F.col("_n") < F.col("_most")), "QUEUED").when(failed, "FAILED").otherwise("COMPLETED").alias("_to"))
    rows = scans.join(ended, scans["id"] == ended["scan_id"], "left")
    last = F.coalesce(F.col("_to") == "FAILED", F.lit(False))
    new = {
        "status": F.coalesce("_to", scans["status"]), "started_at": F.when(F.col("_to").eqNullSafe("QUEUED"), None).otherwise(scans["started_at"]) if "started_at" in scans.columns else None,
        "error_code": F.when(last, ended["error_code"]).otherwise(scans["error_code"]), "error_message": F.when(last, F.col("_error")).otherwise(scans["error_message"]),
        "completed_at": F.when(F.col("_to").isin("FAILED", "COMPLETED"), now).otherwise(scans["completed_at"]) if "completed_at" in scans.columns else None,
    }
    moved = rows.select(*[(new[c] if new.get(c) is not None else scans[c]).alias(c) for c in scans.columns])
    events = ended.filter("_to <> 'QUEUED'").select("scan_id", F.concat(F.lit("SCAN_"), "_to").alias("event_type"), F.when(F.col("_to") == "FAILED", F.to_json(F.struct("error_code", F.col("_n").alias("attempts")))).alias("metadata"))
    return after, moved, events


def stale(now: Column) -> Column:
    return (F.col("status") == "RUNNING") & F.col("locked_at").isNotNull() & (F.col("locked_at") < now - F.expr(STALE))


def reclaim(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs whose lock is too old are queued again; attempts and start stay."""
    old = F.coalesce(stale(now), F.lit(False))
    new = {"status": F.when(old, "QUEUED").otherwise(F.col("status")), "locked_at": F.when(~old, F.col("locked_at")), "locked_by": F.when(~old, F.col("locked_by"))}
    new["last_error"] = F.when(old, "the worker's lock ran out").otherwise(F.col("last_error")) if "last_error" in jobs.columns else None
    return jobs.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def _folded(events: DataFrame, key: str, order: str, fields: list[str], starts: list[Column], step: Callable, place: Callable, joined: Callable) -> DataFrame:
    """(key, s): the state of each key after its events in order; ``starts`` has its first state at the front, then all others.

    Events are range partitioned by key and order, so a key with a third of all events is many tasks.  What lies in one
    partition of a key becomes a map: the state that each start leads to.  Of a partition's keys only
    the first can have begun before it; the others fold from their first state alone.  ``joined`` puts a state
    before a map's entry for it (the entry at ``place``), which is associative, so a key costs one small row a partition where it is combined.
    """
    placed = events.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_m", F.monotonically_increasing_id())
    runs = placed.groupBy(key, F.shiftright("_m", 33).alias("_p")).agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_steps"), (F.min("_m").bitwiseAND(F.lit((1 << 33) - 1)) == 0).alias("_head")
    )
    whole = F.transform(F.array(*starts), lambda s: F.aggregate("_steps", s, step))
    runs = runs.select(key, "_p", F.when(F.col("_head"), whole).otherwise(F.array(F.aggregate("_steps", starts[0], step))).alias("_map"))
    onward = lambda s, r: F.when(F.size(r["_map"]) == 1, r["_map"][0]).otherwise(joined(s, F.element_at(r["_map"], place(s))))
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_map"))).alias("_runs")).select(key, F.aggregate("_runs", starts[0], onward).alias("s"))


def replay_jobs(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(job_id, status, attempt_count, rejected) after events (job_id, seq, wanted) in order.

    A failure before max_attempts queues the job again; moves that the table does not have are rejected.
    """
    moves = [f"{a}>{b}" for a, b in vocab.JOB_MOVES]

    def state(status: str | Column, used: int | Column, attempts: int | Column, rejected: int | Column) -> Column:
        """``used``: attempts as far as they decide, ``max_attempts`` at most."""
        column = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
        return F.struct(column(status, "string").alias("status"), column(used, "int").alias("used"), column(attempts, "long").alias("attempts"), column(rejected, "long").alias("rejected"))

    def step(s: Column, event: Column) -> Column:
        wanted = F.when((event["wanted"] == "FAILED") & (s["used"] < max_attempts), "QUEUED").otherwise(event["wanted"])
        ok = F.coalesce(F.concat_ws(">", s["status"], wanted).isin(*moves), F.lit(False))
        started = (ok & (wanted == "RUNNING")).cast("int")
        return state(F.when(ok, wanted).otherwise(s["status"]), F.least(s["used"] + started, F.lit(max_attempts)), s["attempts"] + started, s["rejected"] + (~ok).cast("int"))

    def place(s: Column) -> Column:
        return ((F.array_position(F.array(*map(F.lit, vocab.JOB_STATUSES)), s["status"]) - 1) * (max_attempts + 1) + s["used"] + 1).cast("int")

    def joined(s: Column, t: Column) -> Column:
        return state(t["status"], t["used"], s["attempts"] + t["attempts"], s["rejected"] + t["rejected"])

    starts = [state(status, used, 0, 0) for status in vocab.JOB_STATUSES for used in range(max_attempts + 1)]  # the first: queued, none used
    folded = _folded(events, "job_id", "seq", ["wanted"], starts, step, place, joined)
    return folded.select("job_id", "s.status", F.col("s.attempts").alias("attempt_count"), "s.rejected")


def replay_reviews(requests: DataFrame) -> DataFrame:
    """(review_id, status, assigned_to, note, rejected, started, completed) after requests in order of seq.

    A null field leaves the value alone; a rejected request changes nothing; ``started`` and ``completed`` count how often
    IN_REVIEW and REVIEWED were entered, which is audited.
    """
    moves = [f"{a}>{b}" for a, b in vocab.REVIEW_MOVES]
    names = ("status", "assigned_to", "note", "rejected", "started", "completed")

    def state(*values: Column) -> Column:
        return F.struct(*[v.cast("string" if n in names[:3] else "long").alias(n) for n, v in zip(names, values, strict=True)])

    def step(s: Column, event: Column) -> Column:
        wanted = F.coalesce(event["status"], s["status"])
        same = wanted == s["status"]
        ok = same | F.concat_ws(">", s["status"], wanted).isin(*moves)
        kept = [F.when(ok, F.coalesce(event[n], s[n])).otherwise(s[n]) for n in names[1:3]]
        entered = [s[n] + (ok & ~same & (wanted == to)).cast("int") for n, to in (("started", "IN_REVIEW"), ("completed", "REVIEWED"))]
        return state(F.when(ok, wanted).otherwise(s["status"]), *kept, s["rejected"] + (~ok).cast("int"), *entered)

    def joined(s: Column, t: Column) -> Column:
        return state(t["status"], *[F.coalesce(t[n], s[n]) for n in names[1:3]], *[s[n] + t[n] for n in names[3:]])

    starts = [state(F.lit(status), F.lit(None), F.lit(None), *[F.lit(0)] * 3) for status in vocab.REVIEW_STATUSES]  # the first: open
    place = lambda s: F.array_position(F.array(*map(F.lit, vocab.REVIEW_STATUSES)), s["status"]).cast("int")
    return _folded(requests, "review_id", "seq", ["status", "assigned_to", "note"], starts, step, place, joined).select("review_id", "s.*")


def cache_hits(requests: DataFrame, scans: DataFrame, repositories: DataFrame) -> DataFrame:
    """Each request with the oldest completed scan of equal identity (case counts), or null."""
    known = scans.filter("status = 'COMPLETED'").join(repositories.select(F.col("id").alias("repository_id"), "provider", "owner", "name"), "repository_id")
    oldest = known.groupBy(*IDENTITY).agg(F.min_by("id", F.struct("created_at", "id")).alias("cached_scan_id"))
    return requests.join(oldest, IDENTITY, "left")


def create_scans(requests: DataFrame, scans: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans after the requests, accepted): a hit marks the old scan CACHED_REAL, a miss adds a queued one."""
    asked = cache_hits(requests, scans, repositories)
    hit = asked.filter("cached_scan_id is not null").select(F.col("cached_scan_id").alias("_hit")).distinct()
    kept = scans.join(hit, F.col("id") == F.col("_hit"), "left").withColumn("source_state", F.expr("if(_hit is null, source_state, 'CACHED_REAL')")).drop("_hit")
    new_id = F.sha2(F.concat_ws("\x1f", "request_id", *IDENTITY), 256)
    found = asked.withColumn("scan_id", F.coalesce("cached_scan_id", new_id)).withColumn("cached", F.col("cached_scan_id").isNotNull())
    repository = repositories.select(F.col("id").alias("repository_id"), "provider", "owner", "name")
    added = found.filter("not cached").join(repository, ["provider", "owner", "name"], "left")
    added = added.select(F.col("scan_id").alias("id"), "repository_id", F.lit("QUEUED").alias("status"), F.lit("UNAVAILABLE").alias("source_state"), *IDENTITY[3:])
    accepted = found.select("request_id", "scan_id", "cached", F.when(F.col("cached"), 200).otherwise(202).alias("http_status"))
    return kept.unionByName(added, allowMissingColumns=True), accepted


def get_or_create(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Repositories with those asked for that were not there, once each."""
    key = ["provider", "owner", "name"]
    missing = requests.select(*key).distinct().join(repositories.select(*key), key, "left_anti")
    added = missing.withColumn("id", F.sha2(F.concat_ws("\x1f", *key), 256)).withColumn("canonical_url", F.concat_ws("/", F.lit("https://github.com"), "owner", "name"))
    return repositories.unionByName(added, allowMissingColumns=True)


def missing_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings without evidence; there must be none."""
    return findings.join(evidence.select(F.col("finding_id").alias("_f")), F.col("id") == F.col("_f"), "left_anti")


def checked_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The findings, or an error at run time when one has no evidence."""
    rows = findings.join(evidence.select(F.col("finding_id").alias("_f")).distinct(), F.col("id") == F.col("_f"), "left")
    return rows.withColumn("id", F.when(F.col("_f").isNull(), F.raise_error(F.lit("missing_evidence")).cast("string")).otherwise(F.col("id"))).drop("_f")


def cascade(parents: DataFrame, children: DataFrame, key: str, on_delete: str = "CASCADE") -> DataFrame:
    """Children after some parents went: gone too, or with the key set to null."""
    there = parents.select(F.col("id").alias("_p"))
    if on_delete == "CASCADE":
        return children.join(there, F.col(key) == F.col("_p"), "left_semi")
    return children.join(there, F.col(key) == F.col("_p"), "left").withColumn(key, F.col("_p")).drop("_p")


def oldest_review(reviews: DataFrame) -> DataFrame:
    """The first review of each finding."""
    place = Window.partitionBy("finding_id").orderBy("created_at", "id")
    return reviews.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
