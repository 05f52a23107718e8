"""Full-text search: tokens, phrases, BM25 with statistics of the whole corpus.

A query is cut into at most 16 terms of word characters, dots, slashes and hyphens; each term is a phrase of index tokens, phrases
are OR-ed and a repeated term counts twice. Documents are tokenised once. Their occurrences are either stored in hash buckets of the token, so that a search shuffles only
what it finds, or exploded for one search, where tokens that occur in no query are dropped as they come out of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverloom.functions.text import index_tokens
from silverloom.session import bucketed, small, staged

K1, B, MAX_TERMS, IDF_FLOOR = 1.2, 0.75, 16, 1e-6


def query_phrases(queries: DataFrame) -> DataFrame:
    """(qid, phrase_no, term, tokens) of queries (qid, query): one row per term of a query that has index tokens."""
    terms = F.slice(F.regexp_extract_all(F.lower("query"), F.lit(r"([\p{L}\p{M}\p{N}_./-]+)"), F.lit(1)), 1, MAX_TERMS)
    return (
        queries.select("qid", F.posexplode(terms).alias("phrase_no", "term"))
        .withColumn("tokens", index_tokens(F.col("term")))
        .filter(F.size("tokens") > 0)
    )


def tokenised(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, path and content tokens, and the number of both together."""
    return files.select(*keys, index_tokens(F.col("file_path")).alias("path_tokens"), index_tokens(F.coalesce("content", F.lit(""))).alias("body_tokens")).withColumn(
        "doc_len", F.size("path_tokens") + F.size("body_tokens")
    )


def corpus_stats(tokens: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length, over all tenants."""
    n, mean = tokens.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    return n, float(mean or 0.0)


@dataclass
class Index:
    """The occurrences of all tokens (keys, doc_len, field, pos, token), and the number and mean length of all documents."""

    occurrences: DataFrame
    n_docs: int
    avg_len: float


def index_files(files: DataFrame, keys: list[str], stored: bool = True) -> Index:
    """The index of files (keys, file_path, content); ``stored``: kept in buckets for many searches, else made for one."""
    tokens = staged(tokenised(files, keys), "tokens")
    fields = F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("path_tokens").alias("t")), F.struct(F.lit(1).alias("field"), F.col("body_tokens").alias("t"))))
    rows = tokens.select(*keys, "doc_len", fields.alias("f")).select(*keys, "doc_len", "f.field", F.posexplode("f.t").alias("pos", "token"))
    if stored:
        rows = bucketed(rows, "occurrences", "token", int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return Index(rows, *corpus_stats(tokens))


def phrase_hits(index: Index, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_len, qid, phrase_no, tf) of ``phrases``: at most 16 terms per query."""
    asked = phrases.select("qid", "phrase_no", F.array_join("tokens", " ").alias("phrase"))  # many queries may ask for one phrase: it is looked up once
    words = phrases.select(F.array_join("tokens", " ").alias("phrase"), "tokens").distinct().select("phrase", F.size("tokens").alias("k"), F.posexplode("tokens").alias("offset", "token"))
    found = (
        index.occurrences.join(small(words), "token")
        .withColumn("start", F.when(F.col("k") > 1, F.col("pos") - F.col("offset")))  # a phrase of one token is whole wherever it stands
    )
    whole = found.groupBy(*keys, "doc_len", "phrase", "k", "field", "start").agg(F.count(F.lit(1)).alias("n")).filter("k = 1 OR n = k")
    tf = whole.groupBy(*keys, "doc_len", "phrase").agg(F.sum(F.when(F.col("k") > 1, F.lit(1)).otherwise(F.col("n"))).alias("tf"))
    return tf.join(small(asked), "phrase").select(*keys, "doc_len", "qid", "phrase_no", "tf")


def bm25(index: Index, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, keys, score) of all documents with a hit; statistics are those of all documents of the index."""
    phrases = staged(phrases, "phrases")
    hits = staged(phrase_hits(index, phrases, keys), "hits")
    df = hits.groupBy("qid", "phrase_no").agg(F.count(F.lit(1)).alias("n_hit"))
    idf = F.ln((index.n_docs - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.lit(index.avg_len)))
    return hits.join(small(df.select("qid", "phrase_no", weight.alias("idf"))), ["qid", "phrase_no"]).groupBy("qid", *keys).agg(F.sum(part).alias("score"))


def hit_rows(ranked: DataFrame, files: DataFrame, keys: list[str], snippet: int = 500) -> DataFrame:
    """Ranked hits (qid, keys, rank) as a search gives them out: the first characters of the content, and a score that is always 1, as only the rank counts."""
    return ranked.select("qid", "rank", *keys).join(files.select(*keys, F.substring(F.coalesce("content", F.lit("")), 1, snippet).alias("snippet")), keys).withColumn("score", F.lit(1.0))


def top_k(scored: DataFrame, k: int, keys: list[str], decimals: int = 9) -> DataFrame:
    """The k best per query; ties by the keys."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", decimals)), *keys))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
