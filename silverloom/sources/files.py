"""Folders of source files as events, outbox messages as events, ranked lists, keyed snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.operators.ingest import ignored
from silverloom.sources.schema import EVENT_LIST, RANKED

MAX_BYTES = 512_000


def scan_folder(spark: SparkSession, root: str, project: str, machine_id: str, now_seconds: int) -> DataFrame:
    """A CREATE event for every file under ``root`` that is small enough, not ignored and valid UTF-8 (else without content)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file:").rstrip("/")
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.expr(f"substr(regexp_replace(path, '^file:/*', '/'), {len(base) + 2})")
    content = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.filter((F.col("length") < MAX_BYTES) & ~ignored(relative)).select(
        F.lit("CREATE").alias("type"), path.alias("path"), F.lit(project).alias("project"), F.lit(machine_id).alias("machine_id"), F.lit(now_seconds).cast("long").alias("timestamp"),
        F.sha2("content", 256).alias("content_hash"), content.alias("content"),
    )


def parse_payload(payload: Column) -> Column:
    """The events of an outbox message; null if it is no JSON."""
    return F.from_json(payload, EVENT_LIST)


def outbox_events(queue: DataFrame) -> DataFrame:
    """(delivery_id, position, event fields) of all messages that can be read."""
    rows = queue.select("delivery_id", F.posexplode(parse_payload(F.col("payload"))).alias("position", "e"))
    return rows.select("delivery_id", "position", "e.*")


def dequeue(queue: DataFrame, limit: int) -> DataFrame:
    """The first messages by number that can be read."""
    return queue.filter(parse_payload(F.col("payload")).isNotNull()).orderBy("id", "delivery_id").limit(limit)


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, score, file_path, entity) of a JSON file {qid: [...]}, bare or under "results"."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"results {RANKED}")["results"]
    lists = F.coalesce(wrapped, F.from_json("value", RANKED))
    return text.select(F.explode(lists).alias("qid", "hits")).select("qid", F.posexplode("hits").alias("pos", "h")).select("qid", (F.col("pos") + 1).alias("rank"), "h.*")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked lists as JSON lines (qid, hits)."""
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "file_path", "entity"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"), x["file_path"].alias("file_path"), x["entity"].alias("entity")))
    ranked.groupBy("qid").agg(hits.alias("hits")).write.mode("overwrite").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, query, expected_paths_substring) of a JSON file of queries."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "queries array<struct<id:string,category:string,query:string,expected_paths_substring:array<string>>>").alias("d"))
    return doc.select(F.inline("d.queries"))


def report_json(rows: DataFrame) -> str:
    """A small report as compact JSON."""
    return json.dumps([json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()], separators=(",", ":"), ensure_ascii=False)
