"""Queries over the delivered, referenced and changed records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.operators.changefeed import FileTable
from silverloom.operators.orphans import half_year, parent_log, reference_log, run_ledger
from silverloom.operators.redelivery import split_deliveries
from silverloom.session import new_folder


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_deliveries(_t(spark, sf, "queue_events")).repeats("delivery_id")


def p1_delivered_once(spark: SparkSession, sf: str) -> DataFrame:
    first = split_deliveries(_t(spark, sf, "queue_events")).first("delivery_id", "batch_id", "machine_id", "id", "payload")
    return first.select("delivery_id", "batch_id", "machine_id", "id", F.md5("payload").alias("payload_md5"))


def _ledger(spark: SparkSession, sf: str):
    parents = parent_log(_t(spark, sf, "files"), _t(spark, sf, "entities"), _t(spark, sf, "shared_symbols"))
    return run_ledger(reference_log(_t(spark, sf, "relations")).unionByName(parents), half_year(F.col("at")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf)[1].filter("orphan").select(F.col("ref").alias("relation_id"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """References, orphans when seen and orphans still pending at the end, per referenced table and month."""
    ledger, _ = _ledger(spark, sf)
    if not ledger.snapshots:
        return spark.createDataFrame([], "tbl string, period string, n_references long, n_orphans long, n_pending long")
    return ledger.snapshots[-1].select("tbl", "period", "n_references", "n_orphans", "n_pending")


def p2_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The counts after every batch of the ledger, not only after the last."""
    ledger, _ = _ledger(spark, sf)
    out = spark.createDataFrame([], "snapshot string, tbl string, period string, n_references long, n_orphans long, n_pending long")
    for s in ledger.snapshots:
        out = out.unionByName(s)
    return out


def _file_table(spark: SparkSession, sf: str) -> FileTable:
    """The change feed, applied in batches as it was received: a batch a quarter, each merged with the table of those before."""
    table, feed = FileTable(spark, new_folder(spark, "file-table")), _t(spark, sf, "file_events")
    quarter = F.coalesce(F.year("received_at") * 10 + F.quarter("received_at"), F.lit(0))
    for (q,) in sorted(tuple(r) for r in feed.select(quarter).distinct().collect()):  # a row per quarter
        table.apply(feed, quarter == q)
        table.vacuum(1)
    return table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _file_table(spark, sf).current().select("machine_id", "path", "event_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_delivered_once, p2_found, p2_counts, p2_snapshots, p5_found)}

_P1 = """
WITH parsed AS (
  SELECT delivery_id, batch_id, machine_id, id, payload,
         json_transform(payload, '[{"type":"VARCHAR","path":"VARCHAR","timestamp":"BIGINT","content_hash":"VARCHAR"}]') AS ev
  FROM queue_events),
keyed AS (
  SELECT delivery_id, batch_id, machine_id, id, payload,
         list_transform(ev, lambda x: {'t': x.type, 'p': nfc_normalize(x.path), 's': x.timestamp, 'h': lower(x.content_hash)}) AS msg
  FROM parsed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY machine_id, id, msg ORDER BY delivery_id) AS rn FROM keyed)
"""

_P2 = """
WITH refs AS (
  SELECT relation_id, observed_at, nfc_normalize(trim(target_ref)) AS key,
         CASE target_type WHEN 'file' THEN 'files' WHEN 'symbol' THEN 'shared_symbols' WHEN 'function' THEN 'entities'
              WHEN 'class' THEN 'entities' WHEN 'type' THEN 'entities' WHEN 'interface' THEN 'entities' END AS tbl
  FROM relations WHERE trim(target_ref) <> ''),
parents AS (
  SELECT DISTINCT 'files' AS tbl, nfc_normalize(machine_id || ':' || file_path) AS key, NULL::TIMESTAMP AS a, NULL::TIMESTAMP AS b FROM files
  UNION ALL SELECT DISTINCT 'entities', nfc_normalize(node_id), first_seen_at, removed_at FROM entities WHERE first_seen_at IS NOT NULL
  UNION ALL SELECT DISTINCT 'shared_symbols', nfc_normalize(symbol_ref), added_at, retired_at FROM shared_symbols WHERE added_at IS NOT NULL),
judged AS (
  SELECT r.relation_id, r.tbl, r.observed_at,
         coalesce(bool_or(p.tbl = 'files' OR (p.a <= r.observed_at AND (p.b IS NULL OR r.observed_at < p.b))), false) AS there,
         coalesce(bool_or(p.tbl = 'files' OR (p.key IS NOT NULL AND p.b IS NULL)), false) AS there_now
  FROM refs r LEFT JOIN parents p ON p.tbl = r.tbl AND p.key = r.key
  WHERE r.tbl IS NOT NULL GROUP BY r.relation_id, r.tbl, r.observed_at)
"""

_EPOCH = "CASE WHEN {0} IS NULL THEN 0 ELSE year({0}) * 10 + CASE WHEN month({0}) > 6 THEN 2 ELSE 1 END END"
_P2_LIVES = f"""
lives AS (SELECT tbl, key, CASE WHEN tbl = 'files' THEN 0 ELSE {_EPOCH.format("a")} END AS ea, CASE WHEN b IS NOT NULL THEN {_EPOCH.format("b")} END AS eb FROM parents WHERE tbl = 'files' OR b IS NULL OR b > a),
r AS (SELECT j.relation_id, j.tbl, refs.key, j.observed_at, {_EPOCH.format("j.observed_at")} AS e, j.there FROM judged j JOIN refs USING (relation_id)),
epochs AS (SELECT e FROM r UNION SELECT ea FROM lives UNION SELECT eb FROM lives WHERE eb IS NOT NULL),
now AS (SELECT x.e AS snapshot, r.relation_id, any_value(r.tbl) AS tbl, any_value(r.observed_at) AS observed_at, bool_and(r.there) AS there, coalesce(bool_or(l.ea <= x.e AND (l.eb IS NULL OR l.eb > x.e)), false) AS there_now
  FROM epochs x JOIN r ON r.e <= x.e LEFT JOIN lives l ON l.tbl = r.tbl AND l.key = r.key GROUP BY 1, 2)
"""

ORACLE = {
    "p2_snapshots": _P2.rstrip() + "," + _P2_LIVES + """SELECT CAST(snapshot AS VARCHAR) AS snapshot, tbl, strftime(observed_at, '%Y-%m') AS period, count(*) AS n_references,
         count(*) FILTER (WHERE NOT there) AS n_orphans, count(*) FILTER (WHERE NOT there_now) AS n_pending FROM now GROUP BY 1, 2, 3""",
    "p1_found": _P1 + "SELECT delivery_id FROM ranked WHERE rn > 1",
    "p1_delivered_once": _P1 + "SELECT delivery_id, batch_id, machine_id, id, md5(payload) AS payload_md5 FROM ranked WHERE rn = 1",
    "p2_found": _P2 + "SELECT relation_id FROM judged WHERE NOT there",
    "p2_counts": _P2
    + """SELECT tbl, strftime(observed_at, '%Y-%m') AS period, count(*) AS n_references,
         count(*) FILTER (WHERE NOT there) AS n_orphans, count(*) FILTER (WHERE NOT there_now) AS n_pending FROM judged GROUP BY 1, 2""",
    "p5_found": """
WITH ev AS (
  SELECT DISTINCT machine_id, event_id, upper(trim(event_type)) AS kind, nfc_normalize(path) AS path, nfc_normalize(old_path) AS old_path,
         CASE WHEN timestamp_seconds >= 100000000000 THEN timestamp_seconds // 1000 ELSE timestamp_seconds END AS sec, content IS NOT NULL AS full_row
  FROM file_events),
ops AS (
  SELECT machine_id, path, sec, event_id, true AS live FROM ev WHERE kind IN ('CREATE', 'MODIFY') AND full_row
  UNION ALL SELECT machine_id, path, sec, event_id, false FROM ev WHERE kind IN ('DELETE', 'RENAME')
  UNION ALL SELECT machine_id, old_path, sec, event_id, false FROM ev WHERE kind = 'RENAME' AND old_path IS NOT NULL AND old_path <> path),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY machine_id, path ORDER BY sec DESC, event_id DESC) AS rn FROM ops)
SELECT machine_id, path, event_id FROM ranked WHERE rn = 1 AND live""",
}
