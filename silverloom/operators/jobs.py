"""The retry queue: claims, failures with back-off, replay of dead jobs, error classes and digests. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of messages of errors that may pass.
TRANSIENT = (
    "timeout", "timed out", "context deadline exceeded", "connection refused", "connection reset", "broken pipe", "network is unreachable", "no route to host",
    "i/o timeout", "unexpected eof", "temporary failure", "hub returned 408", "hub returned 429", "hub returned 5",
)
HOUR_MS = 3_600_000


def is_transient(message: Column) -> Column:
    """Empty (and null) messages count as transient."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (low == "") | low.rlike("|".join(t.replace(".", "\\.") for t in TRANSIENT))


def error_class(message: Column) -> Column:
    return F.when(F.coalesce(message, F.lit("")) == "", "empty").otherwise(F.substring(F.sha2(message, 256), 1, 8))


def state_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def dead_classes(jobs: DataFrame) -> DataFrame:
    return jobs.filter("state = 'dead'").groupBy(error_class(F.col("last_error")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


def reconcile_digest(jobs: DataFrame) -> DataFrame:
    """One row: the number of dead jobs and the SHA-256 of "dead=N;class=n;..." over the sorted classes."""
    classes = dead_classes(jobs)  # one row per error class
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("error_class", "n"))), lambda x: F.concat(F.lit(";"), x["error_class"], F.lit("="), x["n"].cast("string"))), "")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return classes.agg(total.alias("n_dead"), F.sha2(F.concat(F.lit("dead="), total.cast("string"), text), 256).alias("digest"))


def claim_due(jobs: DataFrame, now_ms: int, lease_ms: int, limit: int) -> DataFrame:
    """The first due jobs (pending and due, or running with an expired lease), claimed: running, lease_version + 1, lease until now + lease_ms."""
    due = (F.col("state") == "pending") & (F.col("next_attempt_at") <= now_ms) | (F.col("state") == "running") & (F.col("lease_until") <= now_ms)
    first = jobs.filter(due).orderBy("next_attempt_at", "updated_at", "job_id").limit(limit)
    return first.select("job_id", F.lit("running").alias("state"), (F.col("lease_version") + 1).alias("lease_version"), F.lit(now_ms + lease_ms).cast("long").alias("lease_until"))


def backoff_ms(attempt: Column, base_ms: int) -> Column:
    """base, 2 base, 4 base, ... up to an hour; the first attempt is not capped."""
    return F.when(attempt <= 1, F.lit(base_ms).cast("double")).otherwise(F.least(base_ms * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1), F.lit(float(HOUR_MS)))).cast("long")


def fail_jobs(jobs: DataFrame, failed: DataFrame, now_ms: int, base_ms: int) -> DataFrame:
    """Jobs after failures (job_id, lease_version): one attempt more; dead at max_retries, else pending after the back-off. Stale leases change nothing."""
    f = failed.select("job_id", F.col("lease_version").alias("__sl_lease")).distinct()
    hit = jobs.filter("state = 'running'").join(f, "job_id").filter(F.col("lease_version") == F.col("__sl_lease"))
    attempt = F.col("attempt_count") + 1
    dead = attempt >= F.col("max_retries")
    return hit.select("job_id", attempt.alias("attempt_count"), F.when(dead, "dead").otherwise("pending").alias("state"), F.when(dead, F.col("next_attempt_at")).otherwise(now_ms + backoff_ms(attempt, base_ms)).alias("next_attempt_at"))


def replay_candidates(jobs: DataFrame, now_ms: int, min_age_ms: int, max_replays: int, cursor: int, limit: int) -> DataFrame:
    """Dead jobs behind the cursor that are old enough and not yet replayed too often, by id."""
    ok = (F.col("state") == "dead") & (F.col("replay_count") < max_replays) & (F.col("dead_at") <= now_ms - min_age_ms) & (F.col("job_id") > cursor)
    return jobs.filter(ok).orderBy("job_id").limit(limit)


def auto_replay(jobs: DataFrame, now_ms: int, min_age_ms: int, max_replays: int, cursor: int, batch: int, pages: int = 10) -> DataFrame:
    """Of at most ``pages`` pages of candidates the first ``batch`` transient ones, pending again with replay_count + 1."""
    seen = replay_candidates(jobs, now_ms, min_age_ms, max_replays, cursor, batch * pages)
    return seen.filter(is_transient(F.col("last_error"))).orderBy("job_id").limit(batch).select("job_id", F.lit("pending").alias("state"), (F.col("replay_count") + 1).alias("replay_count"), "attempt_count")


def auto_replay_tick(jobs: DataFrame, now_ms: int, min_age_ms: int, max_replays: int, cursor: int, batch: int, rounds: int = 10) -> tuple[list[int], int]:
    """(ids of the jobs to be replayed, the cursor for the next tick).

    Pages of ``batch`` candidates are read from the cursor on, at most ``rounds`` of them; transient ones are replayed up to ``batch``, others passed over. At the end it goes on from the beginning, once
    nothing is left there it stops. The cursor stands before the first candidate that no longer had room.
    """
    picked: list[int] = []
    while len(picked) < batch and rounds > 0:
        page = replay_candidates(jobs.filter(~F.col("job_id").isin(picked)), now_ms, min_age_ms, max_replays, cursor, batch).select("job_id", is_transient(F.col("last_error")).alias("t")).orderBy("job_id").collect()  # a page
        if not page:
            if cursor == 0:
                break
            cursor = 0
            continue
        rounds -= 1
        for job, transient in page:
            if transient and len(picked) >= batch:
                break
            if transient:
                picked.append(job)
            cursor = job
    return picked, cursor


def manual_replay(jobs: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """Jobs put back by hand (job_id): pending at once, one replay more, the attempts as they were."""
    hit = jobs.join(ids.select("job_id").distinct(), "job_id", "left_semi")
    return hit.select("job_id", F.lit("pending").alias("state"), (F.col("replay_count") + 1).alias("replay_count"), "attempt_count", F.lit(now_ms).cast("long").alias("next_attempt_at"), F.lit(None).cast("long").alias("dead_at"))


def coalesced(requests: DataFrame, capacity: int) -> DataFrame:
    """(machine_id, path, content_hash, n_requests) that a worker holds after requests (seq, machine_id, path, content_hash): the last of each path; new paths beyond ``capacity`` are turned away."""
    ok = requests.filter((F.coalesce("path", F.lit("")) != "") & (F.coalesce("content_hash", F.lit("")) != ""))
    held = ok.groupBy("machine_id", "path").agg(F.min("seq").alias("first"), F.max_by("content_hash", "seq").alias("content_hash"), F.count(F.lit(1)).alias("n_requests"))
    return held.orderBy("first").limit(capacity).select("machine_id", "path", "content_hash", "n_requests")


class RelationCache:
    """Resolved relations by (root, path, hash) in the driver's memory; at most ``limit`` keys, of which the one put first goes first."""

    def __init__(self, limit: int):
        self.limit, self._held = max(0, limit), {}

    def get(self, root: str, path: str, content_hash: str) -> list | None:
        found = self._held.get((root, path, content_hash))
        return None if found is None else list(found)

    def put(self, root: str, path: str, content_hash: str, relations: list) -> None:
        if self.limit:
            self._held[root, path, content_hash] = list(relations)
            while len(self._held) > self.limit:
                del self._held[next(iter(self._held))]


def emitted_ticks(digests: DataFrame, every: int = 24) -> DataFrame:
    """Ticks (tick, digest) to report: the digest changed, or every 24th. Ticks are numbered without gaps; each is compared with the one before by a join."""
    before = digests.select((F.col("tick") + 1).alias("tick"), F.col("digest").alias("b"))
    return digests.join(before, "tick", "left").filter(F.col("b").isNull() | (F.col("b") != F.col("digest")) | (F.col("tick") % every == 0)).select("tick", "digest")


def upsert_jobs(jobs: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """Jobs (machine_id, project, path, content_hash, state, attempt_count, next_attempt_at) after new requests: a job starts anew only if its content changed."""
    n = new.select("machine_id", "project", "path", F.col("content_hash").alias("__sl_hash")).dropDuplicates(["machine_id", "project", "path"]).withColumn("__sl_new", F.lit(True))
    j = jobs.join(n, ["machine_id", "project", "path"], "full_outer")
    reset = F.col("__sl_new").isNotNull() & ~F.col("__sl_hash").eqNullSafe(F.col("content_hash")) | F.col("state").isNull()
    return j.select(
        "machine_id", "project", "path", F.when(reset, F.col("__sl_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(reset, "pending").otherwise(F.col("state")).alias("state"),
        F.when(reset, 0).otherwise(F.col("attempt_count")).alias("attempt_count"), F.when(reset, F.lit(now_ms).cast("long")).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"),
    )


def settle(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """(job_id, outcome) of reports (job_id, lease_version, outcome "done" or "release"); "stale" if the lease is not current."""
    r = reports.select("job_id", F.col("lease_version").alias("__sl_lease"), "outcome")
    current = (F.col("state") == "running") & (F.col("lease_version") == F.col("__sl_lease"))
    return r.join(jobs, "job_id", "left").select("job_id", F.when(F.coalesce(current, F.lit(False)), F.col("outcome")).otherwise("stale").alias("outcome"))


def drop_deleted(jobs: DataFrame, deletes: DataFrame) -> DataFrame:
    """Jobs but for those of deleted or renamed paths (machine_id, path)."""
    return jobs.join(deletes.select("machine_id", "path").distinct(), ["machine_id", "path"], "left_anti")
