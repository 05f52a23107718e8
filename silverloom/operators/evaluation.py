"""Comparing ranked lists (capture, qid, rank, file_path, entity, score): reproducibility, gates, hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lists(ranked: DataFrame, k: int, item) -> DataFrame:
    return ranked.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set(item).alias("items"))


def jaccard(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """(qid, jaccard) of the sets of (file_path, entity); queries empty in both are left out."""
    item = F.concat_ws("\u0001", "file_path", F.coalesce("entity", F.lit("")))
    x, y = _lists(a, k, item).withColumnRenamed("items", "x"), _lists(b, k, item).withColumnRenamed("items", "y")
    none = F.array().cast("array<string>")
    j = x.join(y, "qid", "full_outer").select("qid", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    return j.filter(F.size(F.array_union("x", "y")) > 0).select("qid", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


def gate_a(base: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, ok): the first three files are the same, or one of the new three is new or has a higher score (of repeats the last counts)."""
    def top(d: DataFrame, name: str) -> DataFrame:
        last = d.filter("rank <= 3").groupBy("qid", "file_path").agg(F.max_by("score", "rank").alias("score"))
        return last.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("file_path", "score"))).alias(name))

    j = top(base, "b").join(top(new, "n"), "qid")
    same = F.array_sort(F.map_keys("b")) == F.array_sort(F.map_keys("n"))
    better = F.exists(F.map_keys("n"), lambda f: F.coalesce(F.col("n")[f] > F.col("b")[f], F.lit(True)))
    return j.select("qid", (same | better).alias("ok"))


def gate_b(base: DataFrame, new: DataFrame, k: int = 10, most: int = 2) -> DataFrame:
    """(qid, n_lost, ok): files of the first ten that are gone."""
    j = _lists(base, k, "file_path").withColumnRenamed("items", "b").join(_lists(new, k, "file_path").withColumnRenamed("items", "n"), "qid")
    lost = F.size(F.array_except("b", "n"))
    return j.select("qid", lost.alias("n_lost"), (lost <= most).alias("ok"))


def gate(base: DataFrame, new: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: share of passed A, number of failed B, verdict (0 passed, 1 failed, 2 no common query)."""
    both = gate_a(base, new).withColumnRenamed("ok", "a").join(gate_b(base, new).select("qid", F.col("ok").alias("b")), "qid", "full_outer")
    row = both.agg(F.avg(F.col("a").cast("double")).alias("pass_a"), F.count("a").alias("n"), F.count_if(~F.col("b")).alias("fail_b"))
    return row.select(F.round("pass_a", 6).alias("pass_a"), "fail_b", F.when(F.col("n") == 0, 2).when((F.col("pass_a") >= least) & (F.col("fail_b") == 0), 0).otherwise(1).alias("verdict"))


def hit_rates(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: hit@1, hit@3, hit@10 and mean reciprocal rank over all queries of ``relevant`` (qid, file_path)."""
    found = ranked.join(relevant.select("qid", "file_path").distinct(), ["qid", "file_path"]).groupBy("qid").agg(F.min("rank").alias("first"))
    per = relevant.select("qid").distinct().join(found, "qid", "left")
    at = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6)
    return per.agg(F.count(F.lit(1)).alias("n_queries"), at(1).alias("hit_1"), at(3).alias("hit_3"), at(10).alias("hit_10"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
