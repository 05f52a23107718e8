"""Nearest neighbours by cosine: exact in blocks, and an inverted-file index with measured recall.

The exact search reads the points once for as many queries as fit into ``QUERY_BYTES`` (several times beyond). Each task multiplies its batches with blocks of queries, keeps the k best rows of
each query, and only these are shuffled. The index assigns every row to its nearest centroid (fitted on a bounded
sample, about the root of the number of rows) and compares a query with the rows of its nearest centroids, so many as the neighbours within the sample need for
a recall of ``RECALL``. Rows and queries meet by centroid, one matrix product for a part of a centroid's rows; large centroids are cut into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverloom.session import staged

BLOCK, FIT_SAMPLE, QUERY_BYTES = 2048, 20_000, 64 << 20
RECALL, MAX_CELLS, PART_ROWS = 0.95, 4096, 20_000


def cosine(a, b):
    """Cosine of two array columns, in Catalyst; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _first(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, ties by id."""
    order = np.lexsort((ids, -scores, rows))
    rows = rows[order]
    new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(new, np.diff(np.r_[new, len(rows)]))
    keep = order[rank < k]
    return rows[rank < k], ids[keep], scores[keep]


def _block_top(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best points of each query, by blocks of queries."""
    out = []
    for at in range(0, len(queries), BLOCK):
        s = np.round(queries[at : at + BLOCK] @ points.T, 9)
        least = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else -np.inf
        rows, cols = np.nonzero(s >= least)
        rows, found, scores = _first(rows, ids[cols], s[rows, cols], k)
        out.append((rows + at, found, scores))
    return tuple(np.concatenate(x) for x in zip(*out))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_top_k(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, vec_id, score, rank). Points: vec_id, embedding. Queries: qid, embedding. A query finds itself if it is a point."""
    spark = points.sparkSession
    clean = points.filter("embedding IS NOT NULL").select("vec_id", "embedding")
    asked = queries.filter("embedding IS NOT NULL").select("qid", "embedding")
    n, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    passes = max(1, -(-n * (dim or 1) * 8 // QUERY_BYTES))
    out = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, vec_id {dict(points.dtypes)['vec_id']}, score double")
    schema = out.schema
    for b in range(passes if n else 0):
        rows = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == b).collect()  # QUERY_BYTES, about
        if not rows:
            continue
        qids = np.array([r[0] for r in rows])
        m = np.array([r[1] for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, qids=qids) -> Iterator[pa.RecordBatch]:
            kept = None
            for batch in batches:
                if batch.num_rows:
                    now = _block_top(shared.value, _matrix(batch.column("embedding")), np.asarray(batch.column("vec_id")), k)
                    kept = now if kept is None else _first(*(np.concatenate(x) for x in zip(kept, now)), k)
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(qids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["qid", "vec_id", "score"])

        out = out.unionByName(clean.mapInArrow(run, schema))
    return _ranked(out, k)


def _sample(points: DataFrame, sample: int) -> np.ndarray:
    """At most ``sample`` unit vectors, drawn by a hash of vec_id."""
    rows = points.filter("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").collect()
    m = np.array([r[0] for r in rows], np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(m) else m.reshape(0, 1)


def fit_centroids(m: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = m[rng.choice(len(m), min(n, len(m)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(m @ c.T, axis=1)
        total, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, m)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def probes_for(m: np.ndarray, centroids: np.ndarray, k: int, recall: float = RECALL, queries: int = 400) -> int:
    """How many of its nearest centroids a query must look into to find that share of its k nearest rows, by the first rows of a sample against all of it."""
    q = m[:queries]
    _, found, _ = _block_top(q, m, np.arange(len(m)), min(k, len(m)))
    cell = np.argmax(m @ centroids.T, axis=1)[found].reshape(len(q), -1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(place, cell, axis=1) + 1
    return int(np.quantile(needed, recall, method="higher"))


def with_cells(rows: DataFrame, centroids: np.ndarray, n: int, key: str) -> DataFrame:
    """A row (key, embedding, cell) for each of the n nearest centroids of a row."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column("embedding")) @ shared.value.T), axis=1)[:, :n]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(at), batch.column("embedding").take(at), pa.array(near.ravel().astype(np.int32))], names=[key, "embedding", "cell"])

    return rows.filter("embedding IS NOT NULL").select(key, "embedding").mapInArrow(run, rows.select(key, "embedding").schema.add("cell", "integer"))


def index_top_k(points: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """As ``exact_top_k``, by way of the index."""
    spark = points.sparkSession
    empty = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, vec_id {dict(points.dtypes)['vec_id']}, score double")
    m = _sample(points, FIT_SAMPLE)
    if not len(m):
        return _ranked(empty, k)
    centroids = fit_centroids(m, cells or max(1, min(MAX_CELLS, int(points.count() ** 0.5))))
    probes = min(len(centroids), probes or probes_for(m, centroids, k))
    left = staged(with_cells(points, centroids, 1, "vec_id"), "cells")
    right = staged(with_cells(queries, centroids, probes, "qid"), "probes")
    parts = lambda d, name: d.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias(name))
    sizes = F.broadcast(parts(left, "n_left").join(parts(right, "n_right"), "cell"))  # a row per centroid
    spread = lambda d, key, mine, other: d.join(sizes, "cell").withColumns({mine: F.pmod(F.xxhash64(key), F.col(f"n_{mine}")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))}).drop("n_left", "n_right")
    keys = ["cell", "left", "right"]

    def compare(p: pa.Table, q: pa.Table) -> pa.Table:
        if not p.num_rows or not q.num_rows:
            return pa.table({"qid": q.column("qid").slice(0, 0), "vec_id": p.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})
        rows, ids, scores = _block_top(_matrix(q.column("embedding").combine_chunks()), _matrix(p.column("embedding").combine_chunks()), p.column("vec_id").to_numpy(), k)
        return pa.table({"qid": q.column("qid").to_numpy()[rows], "vec_id": ids, "score": scores})

    pairs = spread(left, "vec_id", "left", "right").groupBy(*keys).cogroup(spread(right, "qid", "right", "left").groupBy(*keys)).applyInArrow(compare, empty.schema)
    return _ranked(pairs, k)
