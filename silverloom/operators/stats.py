"""Corpus counts by scope, latency percentiles over the last samples, vector lag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def content_stats(files: DataFrame) -> DataFrame:
    """Counts per (machine_id, project): files, rows with content, known hashes."""
    return files.groupBy("machine_id", "project").agg(F.count(F.lit(1)).alias("n_files"), F.count("content").alias("n_content"), F.count("content_hash").alias("n_hashes"))


def latency_percentiles(samples: DataFrame, last: int = 1000, known: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles per route over its last samples (route, ms, at, id); unknown routes count as "_other_".

    The last samples of a route are found by its newest moments per task first: a hot route never meets in one task as a whole.
    """
    route = F.col("route") if known is None else F.when(F.col("route").isin(known), F.col("route"))
    s = samples.select(F.coalesce(route, F.lit("_other_")).alias("route"), "ms", "at", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    local = F.row_number().over(Window.partitionBy("route", "salt").orderBy(F.desc("at"), F.desc("id")))
    some = s.withColumn("r", local).filter(F.col("r") <= last)
    rank = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("at"), F.desc("id")))
    recent = some.withColumn("r", rank).filter(F.col("r") <= last)
    p = lambda q: F.round(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)"), 3)
    return recent.groupBy("route").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), p(0.99).alias("p99_ms"))


def vector_lag(points: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: points, entities, and points per entity (0 without entities)."""
    n_points, n_entities = points.count(), entities.count()
    ratio = round(n_points / n_entities, 6) if n_entities else 0.0
    return points.sparkSession.createDataFrame([(n_points, n_entities, ratio)], "n_points long, n_entities long, vector_lag_ratio double")
