"""Reciprocal-rank fusion of semantic and lexical hits, snippet rule, matched entities and overlap boosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverloom.functions.identifiers import entity_overlap, path_overlap, query_tokens

RRF_K, SEMANTIC, LEXICAL, PATH_BOOST, ENTITY_BOOST, SNIPPET = 20, 1.0, 0.7, 0.30, 0.50, 250
KEYS = ["qid", "machine_id", "project", "file_path"]


def fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """(KEYS, score, snippet, matched_entities, first_seen) from hits (KEYS, rank, snippet, entity); lexical hits have no entity.

    Every chunk of a file adds 1 / (20 + rank); the snippet is that of the best semantic chunk, or the best lexical one if that is empty.
    """
    unit = 1.0 / (RRF_K + F.col("rank"))
    hits = semantic.select(*KEYS, "rank", "snippet", "entity", (unit * SEMANTIC).alias("part"), F.lit(0).alias("kind")).unionByName(
        lexical.select(*KEYS, "rank", "snippet", F.lit(None).cast("string").alias("entity"), (unit * LEXICAL).alias("part"), F.lit(1).alias("kind"))
    )
    best = lambda kind: F.nullif(F.min_by(F.when(F.col("kind") == kind, F.col("snippet")), F.when(F.col("kind") == kind, F.col("rank"))), F.lit(""))
    return hits.groupBy(*KEYS).agg(
        F.sum("part").alias("score"),
        F.substring(F.coalesce(best(0), best(1), F.lit("")), 1, SNIPPET).alias("snippet"),
        F.array_sort(F.collect_set(F.nullif("entity", F.lit("")))).alias("matched_entities"),
        F.min(F.struct("kind", "rank")).alias("first_seen"),
    )


def boosted(fused: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best per query after the overlap boosts; order: score, path, first seen."""
    unit = 1.0 / (RRF_K + 1)
    tokens = queries.select("qid", query_tokens(F.col("query")).alias("tokens"))
    n = F.size("tokens")
    boost = F.when(n > 0, unit * (PATH_BOOST * path_overlap(F.col("file_path"), F.col("tokens")) + ENTITY_BOOST * entity_overlap(F.col("matched_entities"), F.col("tokens"))) / n).otherwise(0.0)
    scored = fused.join(tokens, "qid").withColumn("score", F.col("score") + boost).drop("tokens")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "file_path", "first_seen", "machine_id", "project"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def results(top: DataFrame) -> DataFrame:
    """Hits in the shape a search gives them out (``SEARCH_RESULT``), with qid and rank to tell them apart; none of its fields is null."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return top.select("qid", "rank", text("file_path"), text("machine_id"), text("project"), text("snippet"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matched_entities", F.array().cast("array<string>")).alias("matched_entities"))
