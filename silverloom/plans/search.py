"""Queries of the read path: lexical and vector search, fusion, overlap functions, evaluation; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.functions.identifiers import STOP_WORDS, entity_overlap, identifier_tokens, path_overlap, query_tokens, strip_home
from silverloom.operators import evaluation, fusion, lexical, vector
from silverloom.session import staged

KEYS = ["machine_id", "project", "file_path"]
#: The searches the queries run: identifiers, words, a path, a repeated and an empty term.
SEARCHES = [(1, "flush manifest ledger"), (2, "HashSnapshot compactBatch"), (3, "internal/luban outbox.go tombstone"), (4, "render render cursor -- digest"), (5, "what is the lease of a parser")]
SEARCH_SQL = ", ".join(f"({i}, '{q}')" for i, q in SEARCHES)
STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _searches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCHES, "qid int, query string")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The content table: one row per file_id, project never null."""
    return _t(spark, sf, "files").select("file_id", "machine_id", F.coalesce("project", F.lit("")).alias("project"), "file_path", "content")


def _bm25(spark: SparkSession, sf: str, stored: bool = False) -> DataFrame:
    keys = ["file_id", *KEYS]
    return lexical.bm25(lexical.index_files(_files(spark, sf), keys, stored), lexical.query_phrases(_searches(spark)), keys)


def lexical_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.query_phrases(_searches(spark)).select("qid", "phrase_no", "term", F.array_join("tokens", " ").alias("tokens"))


def lexical_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens of every term of the corpus."""
    t = lexical.tokenised(_files(spark, sf), ["file_id"])
    words = t.select("file_id", F.explode(F.concat("path_tokens", "body_tokens")).alias("term"))
    return words.groupBy("term", "file_id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"))


def lexical_bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = lexical.top_k(_bm25(spark, sf), 10, [*KEYS, "file_id"], 6)
    return top.select("qid", "rank", "file_id", F.round("score", 6).alias("score"))


def lexical_indexed_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The same by way of the stored index."""
    top = lexical.top_k(_bm25(spark, sf, True), 10, [*KEYS, "file_id"], 6)
    return top.select("qid", "rank", "file_id", F.round("score", 6).alias("score"))


def lexical_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as they are given out, with snippet and the constant score."""
    top = lexical.top_k(_bm25(spark, sf), 10, [*KEYS, "file_id"], 6)
    return lexical.hit_rows(top, _files(spark, sf), ["file_id"]).select("qid", "rank", "file_id", "score", F.md5("snippet").alias("snippet_md5"))


def lexical_scoped_global_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Scores under the statistics of all tenants, then only one project's files."""
    scoped = _bm25(spark, sf).filter("project = 'lattice-core'")
    return lexical.top_k(scoped, 10, [*KEYS, "file_id"], 6).select("qid", "rank", "file_id", F.round("score", 6).alias("score"))


def lexical_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of terms that are phrases of several tokens."""
    q = spark.createDataFrame([(1, "rank_list node_map"), (2, "edge_set.claim lib/luban")], "qid int, query string")
    hits = lexical.phrase_hits(lexical.index_files(_files(spark, sf), ["file_id"], False), lexical.query_phrases(q), ["file_id"])
    return hits.select("file_id", "qid", "phrase_no", "tf")


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_cosine_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = vector.exact_top_k(_t(spark, sf, "embeddings"), _query_vectors(spark, sf), 10)
    return top.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_scoped_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = vector.exact_top_k(_t(spark, sf, "embeddings").filter("label = 3"), _query_vectors(spark, sf), 10)
    return top.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_index_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = vector.index_top_k(_t(spark, sf, "embeddings"), _query_vectors(spark, sf), 10)
    return top.select("qid", "vec_id", "rank", F.round("score", 6).alias("score"))


def vector_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the exact ten nearest that the index finds, per query."""
    exact = vector_cosine_top10(spark, sf).select("qid", "vec_id")
    found = vector_index_top10(spark, sf).select("qid", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["qid", "vec_id"], "left").groupBy("qid").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("m"), F.col("doc_id") % 3).alias("machine_id"), F.coalesce("lang", F.lit("")).alias("project"), F.concat(F.lit("/src/"), F.col("source"), F.lit("/doc_"), "doc_id", F.lit(".txt")).alias("file_path"), "text")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The texts to the query vectors: the first 120 characters of the vector's document."""
    v = _query_vectors(spark, sf).select("qid", F.floor(F.col("qid") / 2).alias("doc_id"))
    return v.join(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "left").select("qid", F.coalesce(F.substring("text", 1, 120), F.lit("")).alias("query"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest chunks of the query vectors (vector v is chunk v % 2 of document v // 2) fused with the BM25 hits of the query texts over the same documents."""
    d = _documents(spark, sf)
    e = _t(spark, sf, "embeddings").select("vec_id", "label")
    semantic = (
        vector_cosine_top10(spark, sf).join(e, "vec_id").withColumn("doc_id", F.floor(F.col("vec_id") / 2)).join(d, "doc_id")
        .select("qid", *KEYS, "rank", F.substring("text", 1, 500).alias("snippet"), F.concat(F.lit("RankLabel"), "label").alias("entity"))
    )
    files = d.withColumnRenamed("text", "content")
    index = lexical.index_files(files, ["doc_id"])
    scored = lexical.bm25(index, lexical.query_phrases(_queries(spark, sf)), ["doc_id"]).join(d.drop("text"), "doc_id")
    top = staged(lexical.top_k(scored, 10, [*KEYS, "doc_id"], 6), "lexical-top")
    lex = lexical.hit_rows(top, files, ["doc_id"]).join(d.drop("text"), "doc_id").select("qid", *KEYS, "rank", "snippet")
    return fusion.fuse(semantic, lex)


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select(*fusion.KEYS, F.round("score", 9).alias("score"))


def snippet_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select(*fusion.KEYS, F.md5("snippet").alias("snippet_md5"))


def matched_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select(*fusion.KEYS, F.array_join("matched_entities", ",").alias("entities"))


def hybrid_boosted_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search, the flagship: vectors and full text fused, boosted by path and entity overlap."""
    top = fusion.boosted(_fused(spark, sf), _queries(spark, sf))
    return top.select("qid", "rank", "file_path", F.round("score", 6).alias("score"))


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship's hits with all fields of a search result."""
    r = fusion.results(fusion.boosted(_fused(spark, sf), _queries(spark, sf)))
    return r.select("qid", "rank", "file_path", "machine_id", "project", F.md5("snippet").alias("snippet_md5"), F.round("score", 6).alias("score"), F.array_join("matched_entities", ",").alias("entities"))


def ident_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "entities").select("entity_id", F.array_join(F.array_sort(identifier_tokens(F.col("name"))), " ").alias("tokens"))


def home_prefix_strip(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).select("file_id", strip_home(F.col("file_path")).alias("stripped"))


def path_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = _searches(spark).select("qid", query_tokens(F.col("query")).alias("tokens"))
    f = _files(spark, sf)
    parts = [f.select("file_id", F.lit(qid).alias("qid"), path_overlap(F.col("file_path"), F.array(*[F.lit(t) for t in tokens]).cast("array<string>")).alias("n")) for qid, tokens in q.collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def entity_overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array(*map(F.lit, ["flush", "manifest", "ledger", "hash"]))
    e = _t(spark, sf, "entities").groupBy("machine_id", "file_path").agg(F.collect_set("name").alias("names"))
    return e.select("machine_id", "file_path", entity_overlap(F.col("names"), tokens).alias("n"))


def _captures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists for every query: all vectors, and those of the first labels."""
    e = _t(spark, sf, "embeddings")
    label = e.select("vec_id", "label")
    shape = lambda d: d.join(label, "vec_id").select("qid", "rank", F.concat(F.lit("f"), F.floor(F.col("vec_id") / 2)).alias("file_path"), F.concat(F.lit("e"), "label").alias("entity"), F.round("score", 6).alias("score"))
    q = _query_vectors(spark, sf)
    return shape(vector.exact_top_k(e, q, 10)), shape(vector.exact_top_k(e.filter("label < 5"), q, 10))


def eval_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.jaccard(*_captures(spark, sf))


def eval_gate_a(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.gate_a(*_captures(spark, sf))


def eval_gate_b(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.gate_b(*_captures(spark, sf))


def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.gate(*_captures(spark, sf))


def eval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    relevant = _query_vectors(spark, sf).select("qid", F.concat(F.lit("f"), F.floor(F.col("qid") / 2)).alias("file_path"))
    return evaluation.hit_rates(_captures(spark, sf)[1], relevant)


_ALL = (
    lexical_query_terms, lexical_index_stats, lexical_bm25_top10, lexical_indexed_top10, lexical_hits, lexical_scoped_global_stats, lexical_phrase, vector_cosine_top10, vector_scoped_top10, vector_index_top10, vector_index_recall,
    rrf_fuse, snippet_rule, matched_entities, hybrid_boosted_top10, search_results, ident_tokens, home_prefix_strip, path_overlap_counts, entity_overlap_counts, eval_jaccard, eval_gate_a, eval_gate_b, eval_gate, eval_hit_mrr,
)
QUERIES = {f.__name__: f for f in _ALL}

_TOK = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
_LEX = f"""
WITH searches(qid, query) AS (VALUES {SEARCH_SQL}),
docs AS (SELECT file_id, machine_id, coalesce(project, '') AS project, file_path, {_TOK.format("file_path")} AS pt, {_TOK.format("coalesce(content, '')")} AS bt FROM files),
lens AS (SELECT *, len(pt) + len(bt) AS doc_len FROM docs),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
terms AS (SELECT qid, generate_subscripts(t, 1) - 1 AS phrase_no, unnest(t) AS term FROM (SELECT qid, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{M}}\\p{{N}}_./-]+')[1:16] AS t FROM searches)),
phrases AS (SELECT qid, phrase_no, term, {_TOK.format("term")} AS tokens FROM terms),
ptok AS (SELECT qid, phrase_no, len(tokens) AS k, generate_subscripts(tokens, 1) - 1 AS off, unnest(tokens) AS token FROM phrases WHERE len(tokens) > 0),
toks AS (SELECT file_id, 0 AS field, generate_subscripts(pt, 1) AS pos, unnest(pt) AS token FROM lens UNION ALL SELECT file_id, 1, generate_subscripts(bt, 1), unnest(bt) FROM lens),
starts AS (SELECT file_id, field, qid, phrase_no, pos - off AS start, count(*) AS n, any_value(k) AS k FROM toks JOIN ptok USING (token) GROUP BY ALL),
tf AS (SELECT file_id, qid, phrase_no, count(*) AS tf FROM starts WHERE n = k GROUP BY ALL),
df AS (SELECT qid, phrase_no, count(*) AS n_hit FROM tf GROUP BY ALL),
idf AS (SELECT qid, phrase_no, CASE WHEN ln((n_docs - n_hit + 0.5) / (n_hit + 0.5)) > 0 THEN ln((n_docs - n_hit + 0.5) / (n_hit + 0.5)) ELSE 1e-6 END AS idf, avg_len FROM df, stats),
scores AS (SELECT qid, file_id, machine_id, project, file_path, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score FROM tf JOIN idf USING (qid, phrase_no) JOIN lens USING (file_id) GROUP BY ALL)
"""
_RANKED = "SELECT qid, CAST(rn AS INTEGER) AS rank, file_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, machine_id, project, file_path, file_id) AS rn FROM scores {}) WHERE rn <= 10"

_VEC = """
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT qid, vec_id, label, list_cosine_similarity(qe, embedding::DOUBLE[]) AS score FROM q, embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs),
scoped AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs WHERE label = 3),
even AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM pairs WHERE label < 5)
"""
_FUSE = _VEC + """,
d AS (SELECT doc_id, 'm' || (doc_id % 3) AS machine_id, coalesce(lang, '') AS project, '/src/' || source || '/doc_' || doc_id || '.txt' AS file_path, text FROM documents),
sem AS (SELECT qid, machine_id, project, file_path, rank, left(text, 500) AS snippet, 'RankLabel' || label AS entity FROM ranked JOIN d ON d.doc_id = vec_id // 2 WHERE rank <= 10),
lex AS (SELECT qid, machine_id, project, file_path, min(rank) AS rank, any_value(left(text, 500)) AS snippet FROM scoped JOIN d ON d.doc_id = vec_id // 2 WHERE rank <= 10 GROUP BY ALL),
hits AS (SELECT qid, machine_id, project, file_path, rank, snippet, entity, 1.0 / (20 + rank) AS part, 0 AS kind FROM sem UNION ALL SELECT qid, machine_id, project, file_path, rank, snippet, NULL, 0.7 / (20 + rank), 1 FROM lex),
fused AS (SELECT qid, machine_id, project, file_path, sum(part) AS score,
  left(coalesce(nullif(arg_min(snippet, rank) FILTER (WHERE kind = 0), ''), nullif(arg_min(snippet, rank) FILTER (WHERE kind = 1), ''), ''), 250) AS snippet,
  list_sort(list_distinct(list(entity) FILTER (WHERE entity <> ''))) AS ents, min(kind * 1000 + rank) AS first_seen FROM hits GROUP BY ALL)
"""
_TEXT_LEX = (
    _LEX.replace(f"WITH searches(qid, query) AS (VALUES {SEARCH_SQL})", "searches AS (SELECT vec_id AS qid, coalesce(left(text, 120), '') AS query FROM embeddings LEFT JOIN documents ON doc_id = vec_id // 2 WHERE vec_id % 50 = 0)")
    .replace("SELECT file_id, machine_id, coalesce(project, '') AS project", "SELECT doc_id AS file_id, machine_id, project").replace("coalesce(content, '')", "coalesce(text, '')").replace("FROM files)", "FROM d)")
)
_TEXT_FUSE = (
    _FUSE[: _FUSE.index("lex AS (")] + _TEXT_LEX.strip() + """,
lex AS (SELECT qid, machine_id, project, file_path, rn AS rank, left(text, 500) AS snippet FROM
  (SELECT qid, file_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, machine_id, project, file_path, file_id) AS rn FROM scores) JOIN d ON d.doc_id = file_id WHERE rn <= 10),
""" + _FUSE[_FUSE.index("hits AS (") :]
)


def _ident(x: str) -> str:
    """DuckDB has no look-around: the boundaries are set one after the other, overlapping ones twice."""
    for pattern in (r"([a-z])([A-Z])", r"([A-Z][A-Z])([A-Z][a-z])", r"([a-zA-Z])([0-9])", r"([0-9])([a-zA-Z])"):
        x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
        if pattern != r"([a-z])([A-Z])":
            x = f"regexp_replace({x}, '{pattern}', '\\1 \\2', 'g')"
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3))"


_HOME = r"regexp_replace(replace({}, '\', '/'), '^(?:[A-Za-z]:)?/(?:Users|home)/[^/]+/|^/root/|^[A-Za-z]:/', '/')"
_LAST4 = f"array_to_string(list_filter(string_split({_HOME.format('file_path')}, '/'), lambda p: p <> '')[-4:], '/')"

_CAP = _VEC + """,
a AS (SELECT qid, rank, 'f' || (vec_id // 2) AS file_path, 'e' || label AS entity, round(score, 6) AS score FROM ranked WHERE rank <= 10),
b AS (SELECT qid, rank, 'f' || (vec_id // 2) AS file_path, 'e' || label AS entity, round(score, 6) AS score FROM even WHERE rank <= 10)
"""
_GATE_A = _CAP + """,
ta AS (SELECT qid, file_path, arg_max(score, rank) AS score FROM a WHERE rank <= 3 GROUP BY ALL),
tb AS (SELECT qid, file_path, arg_max(score, rank) AS score FROM b WHERE rank <= 3 GROUP BY ALL),
ga AS (SELECT qid, bool_and(ta.qid IS NOT NULL AND tb.qid IS NOT NULL) OR bool_or(tb.qid IS NOT NULL AND (ta.qid IS NULL OR tb.score > ta.score)) AS ok
  FROM ta FULL JOIN tb USING (qid, file_path) GROUP BY qid HAVING count(ta.qid) > 0 AND count(tb.qid) > 0),
gb AS (SELECT la.qid, len(list_filter(la.s, lambda f: NOT list_contains(lb.s, f))) AS n_lost
  FROM (SELECT qid, list_distinct(list(file_path)) AS s FROM a GROUP BY qid) la JOIN (SELECT qid, list_distinct(list(file_path)) AS s FROM b GROUP BY qid) lb USING (qid))
"""

ORACLE = {
    "lexical_query_terms": _LEX + "SELECT qid, CAST(phrase_no AS INTEGER) AS phrase_no, term, array_to_string(tokens, ' ') AS tokens FROM phrases WHERE len(tokens) > 0",
    "lexical_index_stats": _LEX + "SELECT token AS term, count(DISTINCT file_id) AS n_docs, count(*) AS n_tokens FROM toks GROUP BY 1",
    "lexical_bm25_top10": _LEX + _RANKED.format(""),
    "lexical_indexed_top10": _LEX + _RANKED.format(""),
    "lexical_hits": _LEX + "SELECT qid, CAST(rn AS INTEGER) AS rank, file_id, CAST(1.0 AS DOUBLE) AS score, md5(left(coalesce(content, ''), 500)) AS snippet_md5 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, machine_id, project, file_path, file_id) AS rn FROM scores) JOIN (SELECT file_id, content FROM files) USING (file_id) WHERE rn <= 10",
    "lexical_scoped_global_stats": _LEX + _RANKED.format("WHERE project = 'lattice-core'"),
    "lexical_phrase": _LEX.replace(SEARCH_SQL, "(1, 'rank_list node_map'), (2, 'edge_set.claim lib/luban')") + "SELECT file_id, qid, CAST(phrase_no AS INTEGER) AS phrase_no, tf FROM tf",
    "vector_cosine_top10": _VEC + "SELECT qid, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "vector_scoped_top10": _VEC + "SELECT qid, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM scoped WHERE rank <= 10",
    "rrf_fuse": _TEXT_FUSE + "SELECT qid, machine_id, project, file_path, round(score, 9) AS score FROM fused",
    "snippet_rule": _TEXT_FUSE + "SELECT qid, machine_id, project, file_path, md5(snippet) AS snippet_md5 FROM fused",
    "matched_entities": _TEXT_FUSE + "SELECT qid, machine_id, project, file_path, coalesce(array_to_string(ents, ','), '') AS entities FROM fused",
    "hybrid_boosted_top10": _TEXT_FUSE + f""",
qs AS (SELECT qid, list_filter({_ident("query")}, lambda t: NOT list_contains({STOP_SQL}, t)) AS tokens FROM searches),
boosted AS (SELECT f.qid, machine_id, project, file_path, first_seen, snippet, ents, score + CASE WHEN len(tokens) > 0 THEN (1.0 / 21) * (0.30 * len(list_filter(tokens, lambda t: len(list_filter({_ident(_LAST4)}, lambda p: starts_with(p, t))) > 0))
   + 0.50 * len(list_filter(tokens, lambda t: list_contains({_ident("array_to_string(coalesce(ents, []), '/')")}, t)))) / len(tokens) ELSE 0 END AS score FROM fused f JOIN qs USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, file_path, first_seen, machine_id, project) AS rn FROM boosted)
SELECT qid, CAST(rn AS INTEGER) AS rank, file_path, round(score, 6) AS score FROM r WHERE rn <= 10""",
    "ident_tokens": f"SELECT entity_id, array_to_string(list_sort({_ident('name')}), ' ') AS tokens FROM entities",
    "home_prefix_strip": f"SELECT file_id, {_HOME.format('file_path')} AS stripped FROM files",
    "path_overlap_counts": f"""
WITH searches(qid, query) AS (VALUES {SEARCH_SQL}),
qs AS (SELECT qid, list_filter({_ident("query")}, lambda t: NOT list_contains({STOP_SQL}, t)) AS tokens FROM searches),
f AS (SELECT file_id, {_ident(_LAST4)} AS pt FROM files),
x AS (SELECT file_id, qid, len(list_filter(tokens, lambda t: len(list_filter(pt, lambda p: starts_with(p, t))) > 0)) AS n FROM f, qs)
SELECT file_id, qid, CAST(n AS INTEGER) AS n FROM x WHERE n > 0""",
    "entity_overlap_counts": f"""
WITH e AS (SELECT machine_id, file_path, array_to_string(list_distinct(list(name)), '/') AS names FROM entities GROUP BY ALL)
SELECT machine_id, file_path, CAST(len(list_filter(['flush','manifest','ledger','hash'], lambda t: list_contains({_ident("names")}, t))) AS INTEGER) AS n FROM e""",
    "eval_jaccard": _CAP + """, s AS (SELECT qid, list_distinct(list(file_path || chr(1) || entity)) AS x FROM a GROUP BY qid), t AS (SELECT qid, list_distinct(list(file_path || chr(1) || entity)) AS y FROM b GROUP BY qid)
SELECT qid, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM s JOIN t USING (qid)""",
    "eval_gate_a": _GATE_A + "SELECT qid, ok FROM ga",
    "eval_gate_b": _GATE_A + "SELECT qid, CAST(n_lost AS INTEGER) AS n_lost, n_lost <= 2 AS ok FROM gb",
    "eval_gate": _GATE_A + """SELECT round(pa, 6) AS pass_a, fb AS fail_b, CASE WHEN n = 0 THEN 2 WHEN pa >= 0.8 AND fb = 0 THEN 0 ELSE 1 END AS verdict
FROM (SELECT avg(ok::INT) AS pa, count(*) AS n FROM ga), (SELECT count(*) FILTER (WHERE n_lost > 2) AS fb FROM gb)""",
    "eval_hit_mrr": _CAP + """, rel AS (SELECT qid, 'f' || (qid // 2) AS file_path FROM q), hit AS (SELECT rel.qid, min(b.rank) AS first FROM rel LEFT JOIN b ON b.qid = rel.qid AND b.file_path = rel.file_path GROUP BY rel.qid)
SELECT count(*) AS n_queries, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS hit_1, round(avg(coalesce((first <= 3)::INT, 0)), 6) AS hit_3, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS hit_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM hit""",
}
ORACLE["search_results"] = ORACLE["hybrid_boosted_top10"][: ORACLE["hybrid_boosted_top10"].rindex("SELECT qid, CAST(rn")] + """SELECT qid, CAST(rn AS INTEGER) AS rank, file_path, machine_id, project, md5(snippet) AS snippet_md5,
  round(score, 6) AS score, coalesce(array_to_string(ents, ','), '') AS entities FROM r WHERE rn <= 10"""
