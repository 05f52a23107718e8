"""Queries over jobs, statistics, outbox messages, extraction and streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.functions.embedding import get_embedder
from silverloom.functions.extraction import extract
from silverloom.functions.text import nfc
from silverloom.operators import graph, ingest, jobs, stats, store
from silverloom.operators.changefeed import FileTable, whole_seconds
from silverloom.plans.corpus import sent_twice
from silverloom.session import new_folder
from silverloom.sources.files import dequeue, outbox_events
from silverloom.streaming import events as stream

#: 1996-01-01 in milliseconds, the moment the job queries take for now; the messages of the jobs.
NOW_MS = 820_454_400_000
MESSAGES = ("", "dial tcp: connection refused", "hub returned 503", "parse error near token", "i/o timeout", "hub returned 404", "Unexpected EOF", "unknown type")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as jobs of the retry queue."""
    o = _t(spark, sf, "orders")
    key, at = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        key.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "dead").when(F.col("o_orderstatus") == "O", "pending").otherwise("running").alias("state"),
        (key % 5).cast("int").alias("attempt_count"), (key % 7).cast("int").alias("lease_version"), F.lit(4).alias("max_retries"), at.alias("next_attempt_at"), (at - key % 1000).alias("updated_at"),
        (at + 60_000).alias("lease_until"), at.alias("dead_at"), (key % 4).cast("int").alias("replay_count"),
        F.array(*map(F.lit, MESSAGES))[(key % len(MESSAGES)).cast("int")].alias("last_error"),
    )


def transient_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("job_id", jobs.is_transient(F.col("last_error")).alias("transient"))


def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.state_counts(_jobs(spark, sf))


def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.dead_classes(_jobs(spark, sf))


def reconcile_digest(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.reconcile_digest(_jobs(spark, sf))


def jobs_claim_due(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.claim_due(_jobs(spark, sf), NOW_MS, 30_000, 100)


def jobs_fail_backoff(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    failed = j.filter("state = 'running'").select("job_id", F.when(F.col("job_id") % 3 == 0, F.col("lease_version") - 1).otherwise(F.col("lease_version")).alias("lease_version"))
    return jobs.fail_jobs(j, failed, NOW_MS, 5_000)


def jobs_replay_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.replay_candidates(_jobs(spark, sf), NOW_MS, 86_400_000, 3, 100, 50).select("job_id", "replay_count")


def jobs_auto_replay(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.auto_replay(_jobs(spark, sf), NOW_MS, 86_400_000, 3, 100, 20)


def jobs_replay_tick(spark: SparkSession, sf: str) -> DataFrame:
    """One tick of the automatic replay from a cursor near the end, so that it goes on from the beginning: the jobs and the next cursor."""
    j = _jobs(spark, sf)
    last = j.filter("state = 'dead'").agg(F.max("job_id")).first()[0] or 0
    picked, cursor = jobs.auto_replay_tick(j, NOW_MS, 86_400_000, 3, last - 20, 20)
    return spark.createDataFrame([(i, cursor) for i in picked], "job_id long, next_cursor long")


def jobs_manual_replay(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    return jobs.manual_replay(j, j.filter("state = 'dead' AND last_error = 'unknown type'"), NOW_MS).select("job_id", "state", "replay_count", "attempt_count", "next_attempt_at")


def worker_coalesced(spark: SparkSession, sf: str) -> DataFrame:
    """What a worker with room for 500 paths holds after the requests of the change feed."""
    e = _t(spark, sf, "file_events").select(F.col("delivery_id").alias("seq"), "machine_id", "path", "content_hash")
    return jobs.coalesced(e, 500)


def event_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Events of messages, DELETEs sent without machine and project: they get those of their message."""
    q = _t(spark, sf, "queue_events").select("delivery_id", F.col("machine_id").alias("batch_machine"), F.col("project").alias("batch_project"))
    e = outbox_events(_t(spark, sf, "queue_events")).withColumns({c: F.when(F.col("type") == "DELETE", "").otherwise(F.col(c)) for c in ("machine_id", "project")})
    return ingest.with_fallback(e.join(q, "delivery_id"), F.col("batch_machine"), F.col("batch_project")).select("delivery_id", "position", "machine_id", "project")


def stats_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return stats.content_stats(_t(spark, sf, "files"))


def latency_percentiles_lastN(spark: SparkSession, sf: str) -> DataFrame:  # noqa: N802
    e = _t(spark, sf, "events")
    return stats.latency_percentiles(e.select(F.col("event_type").alias("route"), F.col("value").alias("ms"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 1000, ["click", "view", "signup"])


def vector_lag(spark: SparkSession, sf: str) -> DataFrame:
    return stats.vector_lag(_t(spark, sf, "embeddings"), _t(spark, sf, "entities").filter("removed_at IS NULL"))


def health_report(spark: SparkSession, sf: str) -> DataFrame:
    return store.health(_t(spark, sf, "embeddings"), _t(spark, sf, "entities").filter("removed_at IS NULL"))


def scoped_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files and distinct paths of one machine and project."""
    f = store.scoped(_t(spark, sf, "files"), "wren-1", "lattice-core")
    return f.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("file_path").alias("n_paths"))


def ordered_files(spark: SparkSession, sf: str) -> DataFrame:
    return store.ordered_scan(_t(spark, sf, "files"), ["wren-1", "lynx-2"]).select("machine_id", "project", "file_path", "file_id")


def hash_preload(spark: SparkSession, sf: str) -> DataFrame:
    return store.known_hashes(_t(spark, sf, "files"))


def fts_sync(spark: SparkSession, sf: str) -> DataFrame:
    """The token index of the rows before a day, after the files since then replaced theirs, per term."""
    f = _t(spark, sf, "files").select("machine_id", "file_path", "content", "updated_at", "file_id")
    last = lambda d: graph.last_by(d, ["machine_id", "file_path"], ["updated_at", "file_id"])
    old, new = last(f.filter("updated_at < '2025-10-01'")), last(f.filter("updated_at >= '2025-10-01'"))
    synced = store.sync_tokens(store.token_rows(old), new)
    return synced.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_tokens"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, a part of them sent again with new values: the new row replaces the old, then those of one label are deleted."""
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    again = e.filter("label >= 5").withColumns({"label": F.col("label") + 100, "embedding": F.reverse("embedding")})
    kept = store.overwrite(e, again, ["id"]).filter("label <> 2")
    return kept.select("id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


def query_cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select("doc_id", store.cache_key(F.lit("hash"), F.lit("v1"), F.col("source")).alias("cache_key"))


def cached_embedding_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of the sources as queries, half of them from the cache."""
    d = _t(spark, sf, "documents").filter("source IS NOT NULL").select("doc_id", "source")
    q = d.select(F.col("doc_id").alias("qid"), store.cache_key(F.lit("hash"), F.lit("v1"), F.col("source")).alias("cache_key"), F.col("source").alias("query"))
    first = q.filter("qid % 2 = 0").groupBy("cache_key").agg(F.min("query").alias("query"))
    found, _ = store.cached_embeddings(get_embedder().embedded(first, "cache_key", "query", "query"), q)
    return found.select("qid", F.size("embedding").alias("dim"))


def chunk_points(spark: SparkSession, sf: str) -> DataFrame:
    """Vector rows of all last contents of the change feed."""
    last = ingest.last_contents(_t(spark, sf, "file_events"), ["event_id", "machine_id", "project", "path", "content", "entities"])
    return store.chunk_points(last).select("id", "entity", "chunk_no", "start_line", "end_line")


def jobs_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of the stored Go files, after the change feed asked for its Go files."""
    f = graph.last_by(_t(spark, sf, "files").select("machine_id", "project", F.col("file_path").alias("path"), "content_hash", "updated_at", "file_id").filter("path LIKE '%.go' AND project IS NOT NULL"), ["machine_id", "project", "path"], ["updated_at", "file_id"])
    old = f.select("machine_id", "project", "path", "content_hash", F.lit("dead").alias("state"), F.lit(4).alias("attempt_count"), F.lit(1).cast("long").alias("next_attempt_at"))
    e = _t(spark, sf, "file_events").filter("path LIKE '%.go' AND content_hash IS NOT NULL AND content IS NOT NULL AND project IS NOT NULL")
    new = graph.last_by(e.select("machine_id", "project", "path", "content_hash", "delivery_id"), ["machine_id", "project", "path"], ["delivery_id"])
    return jobs.upsert_jobs(old, new, NOW_MS)


def jobs_settle(spark: SparkSession, sf: str) -> DataFrame:
    j = _jobs(spark, sf)
    reports = j.select("job_id", (F.col("lease_version") + F.when(F.col("job_id") % 4 == 0, 1).otherwise(0)).alias("lease_version"), F.when(F.col("job_id") % 2 == 0, "done").otherwise("release").alias("outcome"))
    return jobs.settle(j, reports)


def log_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Hours to report, where an hour's digest is its number of error events in steps of three."""
    hour = F.floor((F.unix_timestamp("ts") - 1_704_067_200) / 3600).alias("tick")
    ticks = _t(spark, sf, "events").groupBy(hour).agg((F.floor(F.count_if(F.col("event_type") == "error") / 3)).cast("string").alias("digest"))
    return jobs.emitted_ticks(ticks)


def outbox_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All events of all messages."""
    e = outbox_events(_t(spark, sf, "queue_events"))
    return e.select("delivery_id", "position", "type", "path", "timestamp", "content_hash", F.length("content").alias("n_chars"), F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"))


def outbox_dequeue(spark: SparkSession, sf: str) -> DataFrame:
    return dequeue(_t(spark, sf, "queue_events"), 100).select("id", "delivery_id")


def extract_relations(spark: SparkSession, sf: str) -> DataFrame:
    return extract(_t(spark, sf, "files"), "file_id")


def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return get_embedder().embedded(_t(spark, sf, "documents").filter(F.length("text") < 100_000), "doc_id", "text")


def _clean_stream(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    e = stream.event_stream(spark, f"{sf}/file_events.parquet")
    return e.withColumns({"event_type": F.upper(F.trim("event_type")), "path": nfc(F.col("path")), "sec": whole_seconds(F.col("timestamp_seconds"))}).select(*columns)


def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The change feed as files of a month of arrivals each, applied as a stream of micro-batches: the same table as in one batch."""
    spool = _spool(spark, sf, [c for c in _t(spark, sf, "file_events").columns if c != "entities"])
    table = FileTable(spark, new_folder(spark, "stream-table"))
    stream.fold_into_table(stream.event_stream(spark, spool, 3), table)
    return table.current().select("machine_id", "path", "event_id")


def stream_skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    """Unchanged events by keyed state, over the first deliveries in order."""
    up = F.col("event_type").isin("CREATE", "MODIFY") & F.col("content_hash").isNotNull()
    first = sent_twice(ingest.clean_events(_t(spark, sf, "file_events").drop("entities", "content")).filter(up).select("event_id", "machine_id", "path", "sec", "content_hash"))
    spool, out = new_folder(spark, "stream-in"), new_folder(spark, "stream-out")
    first.withColumn("quarter", F.floor(F.col("sec") / 7_776_000)).repartitionByRange(16, "quarter").sortWithinPartitions("sec").write.parquet(spool)  # files in the order of time
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(spool)
    stream.run_all(stream.skip_unchanged(source), lambda batch, _: batch.write.mode("append").parquet(out), "skip")
    return spark.read.schema("event_id long").parquet(out)


def _spool(spark: SparkSession, sf: str, columns: list[str]) -> str:
    """The change feed as files of a month of arrivals each."""
    spool = new_folder(spark, "stream-spool")
    feed = _t(spark, sf, "file_events").select(*columns, F.coalesce(F.date_format("received_at", "yyyy-MM"), F.lit("0000-00")).alias("month"))
    feed.repartition("month").write.partitionBy("month").parquet(spool)
    return spool


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events delivered again, by state that forgets an event a year after its arrival; several micro-batches."""
    out = new_folder(spark, "stream-dedup")
    source = stream.event_stream(spark, _spool(spark, sf, ["event_id", "received_at"]), 2).withColumn("received_at", F.col("received_at").cast("timestamp"))
    stream.run_all(stream.deduplicated(source, ["event_id"], "received_at", "366 days"), lambda batch, _: batch.write.mode("append").parquet(out), "dedup")
    return spark.read.parquet(out).select("event_id")


def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of arrivals of a machine that lie under an hour apart, over several micro-batches."""
    out = new_folder(spark, "stream-debounce")
    source = stream.event_stream(spark, _spool(spark, sf, ["machine_id", "received_at", "path"]), 4).withColumn("at", F.col("received_at").cast("timestamp"))
    stream.run_all(stream.debounced(source, "1 hour", "366 days"), lambda batch, _: batch.write.mode("overwrite").parquet(out), "debounce", "complete")
    return spark.read.parquet(out).select("machine_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_events")


def stream_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per machine and type, kept by the stream and written as a snapshot after each batch."""
    out = new_folder(spark, "stream-counts")
    counts = _clean_stream(spark, sf, ["machine_id", "event_type"]).groupBy("machine_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    checkpoint = new_folder(spark, "stream-counts-state")
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()
    return spark.read.schema("machine_id string, event_type string, n long").parquet(out)


_ALL = (
    transient_errors, state_counts, error_classes, reconcile_digest, jobs_claim_due, jobs_fail_backoff, jobs_replay_candidates, jobs_auto_replay, jobs_replay_tick, jobs_manual_replay, worker_coalesced, event_fallbacks, stats_scoped, latency_percentiles_lastN, vector_lag, health_report,
    scoped_counts, ordered_files, hash_preload, fts_sync, vector_upsert, query_cache_keys, cached_embedding_lookup, chunk_points, jobs_upsert, jobs_settle, log_dedup,
    outbox_scan, outbox_dequeue, extract_relations, embed_chunks, stream_fold, stream_skip_unchanged, stream_type_counts, stream_dedup, stream_debounce,
)
QUERIES = {f.__name__: f for f in _ALL}

_J = """
WITH j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'dead' WHEN 'O' THEN 'pending' ELSE 'running' END AS state, CAST(o_orderkey % 5 AS INTEGER) AS attempt_count, CAST(o_orderkey % 7 AS INTEGER) AS lease_version, 4 AS max_retries,
  epoch_ms(o_orderdate) AS due_at, epoch_ms(o_orderdate) - o_orderkey % 1000 AS updated_at, CAST(o_orderkey % 4 AS INTEGER) AS replay_count,
  ['', 'dial tcp: connection refused', 'hub returned 503', 'parse error near token', 'i/o timeout', 'hub returned 404', 'Unexpected EOF', 'unknown type'][o_orderkey % 8 + 1] AS last_error FROM orders),
t AS (SELECT *, last_error = '' OR regexp_matches(lower(last_error), 'timeout|timed out|context deadline exceeded|connection refused|connection reset|broken pipe|network is unreachable|no route to host|unexpected eof|temporary failure|hub returned 408|hub returned 429|hub returned 5') AS transient,
  CASE WHEN last_error = '' THEN 'empty' ELSE left(sha256(last_error), 8) END AS error_class FROM j),
cls AS (SELECT error_class, count(*) AS n FROM t WHERE state = 'dead' GROUP BY 1),
cand AS (SELECT * FROM t WHERE state = 'dead' AND replay_count < 3 AND due_at <= 820454400000 - 86400000 AND job_id > 100 ORDER BY job_id)
"""
from silverloom.plans.corpus import _BLANK, _EV, _LINES, _TWICE  # noqa: E402
from silverloom.plans.problems import ORACLE as _PROBLEMS  # noqa: E402

ORACLE = {
    "transient_errors": _J + "SELECT job_id, transient FROM t",
    "state_counts": _J + "SELECT state, count(*) AS n FROM j GROUP BY 1",
    "error_classes": _J + "SELECT error_class, n FROM cls",
    "reconcile_digest": _J + "SELECT CAST(sum(n) AS BIGINT) AS n_dead, sha256('dead=' || CAST(sum(n) AS BIGINT) || string_agg(';' || error_class || '=' || n, '' ORDER BY error_class)) AS digest FROM cls",
    "jobs_claim_due": _J + "SELECT job_id, 'running' AS state, lease_version + 1 AS lease_version, 820454400000 + 30000 AS lease_until FROM j WHERE (state = 'pending' AND due_at <= 820454400000) OR (state = 'running' AND due_at + 60000 <= 820454400000) ORDER BY due_at, updated_at, job_id LIMIT 100",
    "jobs_fail_backoff": _J + """SELECT job_id, attempt_count + 1 AS attempt_count, CASE WHEN attempt_count + 1 >= 4 THEN 'dead' ELSE 'pending' END AS state,
  CASE WHEN attempt_count + 1 >= 4 THEN due_at ELSE 820454400000 + CAST(least(5000 * pow(2, attempt_count), 3600000) AS BIGINT) END AS next_attempt_at FROM j WHERE state = 'running' AND job_id % 3 <> 0""",
    "jobs_replay_candidates": _J + "SELECT job_id, replay_count FROM cand ORDER BY job_id LIMIT 50",
    "jobs_auto_replay": _J + "SELECT job_id, 'pending' AS state, replay_count + 1 AS replay_count, attempt_count FROM (SELECT * FROM cand ORDER BY job_id LIMIT 200) WHERE transient ORDER BY job_id LIMIT 20",
    "stats_scoped": "SELECT machine_id, project, count(*) AS n_files, count(content) AS n_content, count(content_hash) AS n_hashes FROM files GROUP BY 1, 2",
    "latency_percentiles_lastN": """WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view', 'signup') THEN event_type ELSE '_other_' END AS route, value AS ms, row_number() OVER (PARTITION BY CASE WHEN event_type IN ('click', 'view', 'signup') THEN event_type ELSE '_other_' END ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT route, count(*) AS n, round(quantile_disc(ms, 0.5), 3) AS p50_ms, round(quantile_disc(ms, 0.95), 3) AS p95_ms, round(quantile_disc(ms, 0.99), 3) AS p99_ms FROM e WHERE rn <= 1000 GROUP BY 1""",
    "vector_lag": "SELECT a AS n_points, b AS n_entities, round(a / b, 6) AS vector_lag_ratio FROM (SELECT count(*) AS a FROM embeddings), (SELECT count(*) AS b FROM entities WHERE removed_at IS NULL)",
    "health_report": """SELECT a AS n_points, b AS n_entities, round(a / b, 6) AS vector_lag_ratio, CASE WHEN b = 0 THEN 'no entities' WHEN a = 0 THEN 'no vectors; vectors lag behind' WHEN a / b < 0.5 THEN 'vectors lag behind' ELSE '' END AS issues
FROM (SELECT count(*) AS a FROM embeddings), (SELECT count(*) AS b FROM entities WHERE removed_at IS NULL)""",
    "scoped_counts": "SELECT count(*) AS n_files, count(DISTINCT file_path) AS n_paths FROM files WHERE machine_id = 'wren-1' AND project = 'lattice-core'",
    "ordered_files": "SELECT machine_id, project, file_path, file_id FROM files WHERE machine_id NOT IN ('wren-1', 'lynx-2')",
    "hash_preload": "SELECT machine_id, file_path, content_hash FROM files WHERE content_hash IS NOT NULL",
    "fts_sync": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY machine_id, file_path, updated_at >= '2025-10-01' ORDER BY updated_at DESC, file_id DESC) AS rn FROM files),
b AS (SELECT *, row_number() OVER (PARTITION BY machine_id, file_path ORDER BY updated_at >= '2025-10-01' DESC) AS k FROM a WHERE rn = 1 AND updated_at IS NOT NULL),
c AS (SELECT * FROM b WHERE k = 1),
t AS (SELECT file_id, 0 AS field, unnest(regexp_extract_all(strip_accents(lower(file_path)), '[\\p{L}\\p{N}]+')) AS term FROM c UNION ALL SELECT file_id, 1, unnest(regexp_extract_all(strip_accents(lower(coalesce(content, ''))), '[\\p{L}\\p{N}]+')) FROM c)
SELECT field, term, count(DISTINCT file_id) AS n_files, count(*) AS n_tokens FROM t GROUP BY 1, 2""",
    "vector_upsert": "SELECT vec_id AS id, CASE WHEN label >= 5 THEN label + 100 ELSE label END AS label, round(CASE WHEN label >= 5 THEN embedding[-1] ELSE embedding[1] END::DOUBLE, 6) AS first, round(CASE WHEN label >= 5 THEN embedding[1] ELSE embedding[-1] END::DOUBLE, 6) AS last FROM embeddings WHERE label <> 2",
    "query_cache_keys": "SELECT doc_id, sha256(concat_ws(':', 'hash', 'v1', 'query', lower(trim(source)))) AS cache_key FROM documents",
    "cached_embedding_lookup": "SELECT doc_id AS qid, CAST(64 AS INTEGER) AS dim FROM documents WHERE source IS NOT NULL",
    "jobs_upsert": """WITH f AS (SELECT machine_id, project, file_path AS path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, project, file_path ORDER BY updated_at DESC NULLS LAST, file_id DESC) AS rn FROM files WHERE file_path LIKE '%.go' AND project IS NOT NULL) WHERE rn = 1),
n AS (SELECT machine_id, project, path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, project, path ORDER BY delivery_id DESC) AS rn FROM file_events WHERE path LIKE '%.go' AND content_hash IS NOT NULL AND content IS NOT NULL AND project IS NOT NULL) WHERE rn = 1),
j AS (SELECT coalesce(f.machine_id, n.machine_id) AS machine_id, coalesce(f.project, n.project) AS project, coalesce(f.path, n.path) AS path, f.content_hash AS old_hash, n.content_hash AS new_hash, f.path IS NULL OR (n.path IS NOT NULL AND n.content_hash IS DISTINCT FROM f.content_hash) AS reset
  FROM f FULL JOIN n ON f.machine_id = n.machine_id AND f.project = n.project AND f.path = n.path)
SELECT machine_id, project, path, CASE WHEN reset THEN new_hash ELSE old_hash END AS content_hash, CASE WHEN reset THEN 'pending' ELSE 'dead' END AS state, CASE WHEN reset THEN 0 ELSE 4 END AS attempt_count, CASE WHEN reset THEN 820454400000 ELSE 1 END AS next_attempt_at FROM j""",
    "jobs_settle": _J + "SELECT job_id, CASE WHEN state = 'running' AND job_id % 4 <> 0 THEN CASE WHEN job_id % 2 = 0 THEN 'done' ELSE 'release' END ELSE 'stale' END AS outcome FROM j",
    "log_dedup": """WITH t AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS tick, CAST(count(*) FILTER (WHERE event_type = 'error') // 3 AS VARCHAR) AS digest FROM events GROUP BY 1)
SELECT t.tick, t.digest FROM t LEFT JOIN t b ON b.tick = t.tick - 1 WHERE b.digest IS NULL OR b.digest <> t.digest OR t.tick % 24 = 0""",
    "jobs_replay_tick": _J + """, c AS (SELECT job_id, transient FROM cand), all_c AS (SELECT job_id, transient FROM t WHERE state = 'dead' AND replay_count < 3 AND due_at <= 820454400000 - 86400000),
z AS (SELECT max(job_id) - 20 AS cur FROM t WHERE state = 'dead'), ord AS (SELECT job_id, transient, row_number() OVER (ORDER BY job_id <= cur, job_id) AS o FROM all_c, z),
w AS (SELECT *, sum(transient::INT) OVER (ORDER BY o) AS n FROM ord), stop AS (SELECT min(o) AS o FROM w WHERE n > 20),
p AS (SELECT job_id FROM w WHERE transient AND n <= 20), nc AS (SELECT job_id AS next_cursor FROM w WHERE o = (SELECT o - 1 FROM stop))
SELECT job_id, next_cursor FROM p, nc""",
    "jobs_manual_replay": _J + "SELECT job_id, 'pending' AS state, replay_count + 1 AS replay_count, attempt_count, 820454400000 AS next_attempt_at FROM j WHERE state = 'dead' AND last_error = 'unknown type'",
    "worker_coalesced": """SELECT machine_id, path, arg_max(content_hash, delivery_id) AS content_hash, count(*) AS n_requests FROM file_events WHERE path <> '' AND content_hash <> '' GROUP BY 1, 2 ORDER BY min(delivery_id) LIMIT 500""",
    "event_fallbacks": """WITH e AS (SELECT delivery_id, machine_id AS bm, project AS bp, json_transform(payload, '[{"type":"VARCHAR","machine_id":"VARCHAR","project":"VARCHAR"}]') AS ev FROM queue_events),
x AS (SELECT delivery_id, bm, bp, generate_subscripts(ev, 1) - 1 AS position, unnest(ev) AS e FROM e)
SELECT delivery_id, CAST(position AS INTEGER) AS position, coalesce(CASE WHEN e.type = 'DELETE' THEN NULL ELSE nullif(e.machine_id, '') END, bm) AS machine_id, coalesce(CASE WHEN e.type = 'DELETE' THEN NULL ELSE nullif(e.project, '') END, bp) AS project FROM x""",
    "stream_dedup": "SELECT DISTINCT event_id FROM file_events",
    "stream_debounce": """WITH e AS (SELECT machine_id, received_at AS t, CASE WHEN received_at < lag(received_at) OVER (PARTITION BY machine_id ORDER BY received_at) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM file_events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY machine_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT machine_id, min(t) AS start, max(t) + INTERVAL 1 HOUR AS "end", count(*) AS n_events FROM s GROUP BY machine_id, n""",
    "outbox_scan": """WITH e AS (SELECT delivery_id, json_transform(payload, '[{"type":"VARCHAR","path":"VARCHAR","timestamp":"BIGINT","content_hash":"VARCHAR","content":"VARCHAR","entities":["JSON"]}]') AS ev FROM queue_events),
x AS (SELECT delivery_id, generate_subscripts(ev, 1) - 1 AS position, unnest(ev) AS e FROM e)
SELECT delivery_id, CAST(position AS INTEGER) AS position, e.type AS type, e.path AS path, e.timestamp AS timestamp, e.content_hash AS content_hash, CAST(length(e.content) AS INTEGER) AS n_chars, CAST(coalesce(len(e.entities), 0) AS INTEGER) AS n_entities FROM x""",
    "outbox_dequeue": "SELECT id, delivery_id FROM queue_events WHERE json_valid(payload) ORDER BY id, delivery_id LIMIT 100",
    "stream_fold": _PROBLEMS["p5_found"],
    "stream_skip_unchanged": _EV + _TWICE,
    "stream_type_counts": "SELECT machine_id, upper(trim(event_type)) AS event_type, count(*) AS n FROM file_events GROUP BY 1, 2",
}
_ID = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(machine_id || ':' || coalesce(project, '') || ':' || path || ':' || entity || ':' || chunk_no))"
ORACLE["chunk_points"] = _EV + f""",
las AS (SELECT * FROM (SELECT ev.*, raw.entities, row_number() OVER (PARTITION BY ev.machine_id, ev.path ORDER BY ev.sec DESC NULLS LAST, ev.event_id DESC) AS k
  FROM ev JOIN raw ON raw.event_id = ev.event_id AND raw.rn = 1 WHERE ev.event_type IN ('CREATE', 'MODIFY') AND ev.content IS NOT NULL) WHERE k = 1 AND length(content) < 100000),
ln0 AS (SELECT *, {_LINES.format("content")} AS l0 FROM las),
ln AS (SELECT *, CASE WHEN len(l0) > 1 AND l0[-1] = '' THEN l0[:-2] ELSE l0 END AS lines FROM ln0),
e AS (SELECT event_id, lines, i - 1 AS chunk_no, entities[i].name AS name, entities[i].start_line AS a, entities[i].end_line AS b FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM ln)),
sym AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, name, a, b ORDER BY chunk_no) AS rn FROM e
  WHERE a >= 1 AND b >= a AND a <= len(lines) AND regexp_replace(array_to_string(lines[a:b], chr(10)), '{_BLANK}+', '', 'g') <> '') WHERE rn = 1),
win AS (SELECT event_id, content, st, row_number() OVER (PARTITION BY event_id ORDER BY st) - 1 AS chunk_no, least(st + 2400, length(content)) AS en
  FROM (SELECT event_id, content, unnest(list_filter(range(0, CAST(length(content) AS BIGINT), 600), lambda p: p = 0 OR p - 600 + 2400 < length(content))) AS st FROM las WHERE content <> '' AND event_id NOT IN (SELECT event_id FROM sym))),
c AS (SELECT event_id, chunk_no, coalesce(name, '') AS entity, a AS start_line, b AS end_line FROM sym
  UNION ALL SELECT event_id, chunk_no, '', len(string_split(left(content, st), chr(10))), len(string_split(left(content, en), chr(10))) FROM win),
d AS (SELECT * FROM (SELECT c.*, machine_id, project, path, row_number() OVER (PARTITION BY c.event_id ORDER BY chunk_no) AS r FROM c JOIN las ON las.event_id = c.event_id) WHERE r <= 64),
h AS (SELECT *, {_ID} AS h FROM d)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
  entity, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM h"""
