"""Queries over chunks, ids, ingest, the graph and trees; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.functions.identifiers import node_id, point_id
from silverloom.functions.text import nfc
from silverloom.operators import chunking, graph, ingest, store, tree
from silverloom.session import staged

#: The entity whose surroundings the dependency queries ask for, and the days after which files count as replaced and relations as seen again.
ROOT, SINCE, RENEWED = "split", "2025-10-01", "2026-01-01"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.windows(_t(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), ["doc_id"]).select("doc_id", "chunk_no", "start", "end")


def window_line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.windows(_t(spark, sf, "files"), ["file_id"]).select("file_id", "chunk_no", "start_line", "end_line")


def symbol_slice(spark: SparkSession, sf: str) -> DataFrame:
    chunks = chunking.symbol_chunks(_t(spark, sf, "file_events"), ["delivery_id"])
    return chunks.select("delivery_id", "entity_index", "name", F.md5("text").alias("text_md5"))


def chunk_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks per row under a cap of five."""
    chunks = chunking.file_chunks(_t(spark, sf, "file_events"), ["delivery_id"], cap=5)
    return chunks.groupBy("delivery_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("snippet")).alias("snippet_chars"))


def point_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "entities").filter("project IS NOT NULL")
    return e.select("entity_id", point_id(F.col("machine_id"), F.col("project"), F.col("file_path"), F.col("name"), F.coalesce("start_line", F.lit(0))).alias("point_id"))


def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "entities").select("entity_id", node_id(F.col("machine_id"), F.col("file_path"), F.col("name")).alias("id"))


def nfc_path(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "files").select("file_id", nfc(F.col("file_path")).alias("path"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "files").filter("content IS NOT NULL").select("file_id", F.sha2("content", 256).alias("sha256"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Clean events; of the content only whether there is any, as nothing here asks for more and it would be shuffled."""
    return ingest.clean_events(_t(spark, sf, "file_events").drop("entities").withColumn("content", F.when(F.col("content").isNotNull(), F.lit(""))))


def hash_short_circuit(spark: SparkSession, sf: str) -> DataFrame:
    stored = ingest.newest(_t(spark, sf, "files").drop("content"))
    return ingest.hash_short_circuit(_events(spark, sf), stored)


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.newest(_t(spark, sf, "files").drop("content")).select("machine_id", "file_path", "file_id", "content_hash")


def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The content table of before a day, upserted with the rows since; a missing hash keeps the old one."""
    f = _t(spark, sf, "files").drop("content")
    old, new = ingest.newest(f.filter(F.col("updated_at") < SINCE)), ingest.newest(f.filter(F.col("updated_at") >= SINCE))
    return ingest.upsert(old.select("machine_id", "file_path", "file_id", "content_hash"), new.select("machine_id", "file_path", "file_id", "content_hash"), ["machine_id", "file_path"], ["content_hash"])


def delete_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.delete_fanout(_events(spark, sf))


def deletes_first(spark: SparkSession, sf: str) -> DataFrame:
    stored = ingest.newest(_t(spark, sf, "files").drop("content"))
    return ingest.deletes_first(stored, _events(spark, sf))


def event_type_fold(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.fold_types(_events(spark, sf))


def batch_chunking(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.batches(_events(spark, sf).drop("content"))


def sent_twice(events: DataFrame) -> DataFrame:
    """Each event and, ten minutes later, the same content saved once more under another number."""
    return events.unionByName(events.withColumns({"event_id": -F.col("event_id") - 1, "sec": F.col("sec") + 600}))


def unchanged_events(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.unchanged_run(sent_twice(_events(spark, sf).drop("content")))


def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "files").filter(ingest.ignored(F.regexp_replace("file_path", "^/(home/build|srv/code|data/repos|workspace)/", ""))).select("file_id")


def ignored_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Paths ignored by .gitignore and .dockerignore lines and by globs beside the names that are never watched."""
    relative = F.regexp_replace("file_path", "^/(home/build|srv/code|data/repos|workspace)/[^/]+/", "")
    return _t(spark, sf, "files").filter(ingest.ignored_by(relative, ["# generated", "*_f.js", "!cursor*", "/internal/", "pkg/**/*.ts"], ["services/*/*.py", "!services/luban_*/*"], ["*_trace_?.go"])).select("file_id")


def longest_prefix_project(spark: SparkSession, sf: str) -> DataFrame:
    f = _t(spark, sf, "files")
    roots = f.filter("project IS NOT NULL").select(F.regexp_extract("file_path", r"^(.*?/[^/]*-[^/]*)/", 1).alias("root"), "project").filter("root <> ''").groupBy("root").agg(F.min("project").alias("project"))
    return ingest.longest_prefix(f.select(F.col("file_path").alias("path")), roots)


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = graph.live_entities(_t(spark, sf, "entities"))
    edges = staged(graph.merged_edges(_t(spark, sf, "relations"), e), "edges")  # the look-ups read the stored tables several times
    return staged(graph.graph_nodes(e, edges), "nodes"), edges


def graph_edges_merge(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.merged_edges(_t(spark, sf, "relations"), graph.live_entities(_t(spark, sf, "entities")))
    return edges.select(*graph.EDGE, "to_kind", "line", "confidence", "layer", "status", "symbol_id")


def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[0].select("id", "kind", "name")


def _replaced(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "files").filter(F.col("updated_at") >= SINCE).select("machine_id", "file_path")


def graph_replace_file(spark: SparkSession, sf: str) -> DataFrame:
    """The edges left when the files updated since a day are detached."""
    return graph.detach_files(_graph(spark, sf)[1], _replaced(spark, sf)).select(*graph.EDGE)


def graph_prune_orphans(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf)
    return graph.orphan_symbols(nodes, graph.detach_files(edges, _replaced(spark, sf))).select("id", "kind").distinct()


def _deps(spark: SparkSession, sf: str, direction: str) -> tuple[DataFrame, DataFrame]:
    return graph.dependencies(*_graph(spark, sf), ROOT, direction)


def deps_upstream(spark: SparkSession, sf: str) -> DataFrame:
    return _deps(spark, sf, "upstream")[1].select("phase", *graph.EDGE)


def deps_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return _deps(spark, sf, "downstream")[1].select("phase", *graph.EDGE)


def deps_imports_2hop(spark: SparkSession, sf: str) -> DataFrame:
    return _deps(spark, sf, "both")[1].filter("phase = 3").select(*graph.EDGE)


def deps_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _deps(spark, sf, "both")[0]


def deps_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The edges kept under the caps of 50 nodes and 100 edges."""
    return graph.capped(*_deps(spark, sf, "both"))[1].select("phase", *graph.EDGE)


def edge_groups(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_groups(_deps(spark, sf, "both")[1]).select("edge_group", "phase", *graph.EDGE)


def _project_deps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf)
    projects = graph.node_projects(graph.live_entities(_t(spark, sf, "entities")), edges)
    return graph.dependencies(nodes, edges, ROOT, "both", project="lattice-core", projects=projects)


def deps_project(spark: SparkSession, sf: str) -> DataFrame:
    """The surroundings within one project: the root and both ends of an edge must be of it."""
    return _project_deps(spark, sf)[1].select("phase", *graph.EDGE)


def deps_look_up(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a look-up: counts before and after the caps, whether they cut, edges per group."""
    return graph.look_up_summary(*_deps(spark, sf, "both"))


def deps_bad_direction(spark: SparkSession, sf: str) -> DataFrame:
    """A direction that does not exist gives the roots only."""
    return _deps(spark, sf, "sideways")[0]


def corpus_ingest_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph after the files replaced since a day came in again as one batch, with the relations seen in them since ``RENEWED``."""
    e = staged(graph.live_entities(_t(spark, sf, "entities")), "entities")
    before = staged(graph.merged_edges(_t(spark, sf, "relations"), e), "edges")
    files = _t(spark, sf, "files").filter((F.col("updated_at") >= SINCE) & F.col("content").isNotNull()).groupBy("machine_id", "file_path").agg(F.max("file_id").alias("event_id"))
    r = _t(spark, sf, "relations").filter(F.col("observed_at") >= RENEWED).join(files, ["machine_id", "file_path"], "left_semi")
    relation = F.struct(F.col("relation_type").alias("type"), "source", "target", "target_type", "line", "confidence", "layer", "status", "symbol_id")
    found = r.groupBy("machine_id", "file_path").agg(F.collect_list(relation).alias("relations"))  # those of one file
    symbols = e.groupBy("machine_id", "file_path").agg(F.collect_list(F.struct("name", F.col("entity_type").alias("type"), F.lit(0).alias("line"), "start_line", "end_line")).alias("entities"))
    events = (
        files.join(_t(spark, sf, "files").select(F.col("file_id").alias("event_id"), "project", "content"), "event_id").join(found, ["machine_id", "file_path"], "left").join(symbols, ["machine_id", "file_path"], "left")
        .select("event_id", F.lit("MODIFY").alias("event_type"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("old_path"), "project", "machine_id", F.lit(0).cast("long").alias("sec"), F.sha2("content", 256).alias("content_hash"), "content", "entities", "relations")
    )
    none = lambda schema: spark.createDataFrame([], schema)
    corpus = store.Corpus(
        none("machine_id string, project string, file_path string, content string, content_hash string"), none("machine_id string, file_path string, field int, term string, n long"),
        none("id string, machine_id string, project string, file_path string, entity string, chunk_no int, start_line int, end_line int, snippet string, text string"),
        e.select("machine_id", "project", "file_path", "name", "entity_type", "start_line", "end_line"), before,
    )
    return corpus.ingest(staged(events, "events")).edges.select(*graph.EDGE, "to_kind")


def reindex_points(spark: SparkSession, sf: str) -> DataFrame:
    """Vector rows of the whole content table when it is indexed anew."""
    events = store.reindex_events(_t(spark, sf, "files"), ["wren-1"])
    return store.chunk_points(events).select("machine_id", "file_path", "chunk_no", "start_line", "end_line")


def deps_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_summary(graph.merged_edges(_t(spark, sf, "relations"), graph.live_entities(_t(spark, sf, "entities"))))


def file_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Entity pairs of the file pairs that IMPORTS_RESOLVED names, counted per pair."""
    r = _t(spark, sf, "relations").filter("relation_type = 'IMPORTS_RESOLVED'")
    pairs = r.filter(F.expr("startswith(trim(target_ref), concat(machine_id, ':'))")).select(
        "machine_id", F.col("file_path").alias("from_path"), F.expr("substr(trim(target_ref), length(machine_id) + 2)").alias("to_path")
    )
    found = graph.file_dependencies(graph.live_entities(_t(spark, sf, "entities")), pairs)
    return found.groupBy("machine_id", "from_path", "to_path").agg(F.count(F.lit(1)).alias("n_edges"))


def project_files(spark: SparkSession, sf: str) -> DataFrame:
    """File paths of a project, one row per entity."""
    return graph.live_entities(_t(spark, sf, "entities")).filter("project = 'lattice-core'").select("machine_id", "file_path", "name")


def project_tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_paths(_t(spark, sf, "files").select("machine_id", "project", "file_path"))


def project_tree_render(spark: SparkSession, sf: str) -> DataFrame:
    return tree.render_trees(tree.tree_paths(_t(spark, sf, "files").select("machine_id", "project", "file_path")))


def project_tree_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Stored trees, or a note, for the projects that messages name."""
    asked = _t(spark, sf, "queue_events").filter("project IS NOT NULL").select("machine_id", "project").distinct()
    return tree.project_tree(asked, project_tree_render(spark, sf)).select("machine_id", "project", F.md5("tree").alias("tree_md5"))


def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Content of requested files (those of the change feed), or a note that there is none."""
    asked = _t(spark, sf, "file_events").select("machine_id", F.col("path").alias("file_path")).distinct()
    stored = _t(spark, sf, "files").groupBy("machine_id", "file_path").agg(F.max_by("content", F.struct("updated_at", "file_id")).alias("content"))
    return asked.join(stored, ["machine_id", "file_path"], "left").select("machine_id", "file_path", F.md5(F.coalesce("content", F.concat(F.lit("[file not found: "), "file_path", F.lit("]")))).alias("md5"))


_ALL = (
    chunk_windows, window_line_numbers, symbol_slice, chunk_cap, point_uuid5, node_ids, nfc_path, content_hash, hash_short_circuit, upsert_latest, keyed_upsert, delete_fanout, deletes_first, event_type_fold,
    batch_chunking, unchanged_events, ignored_paths, ignored_by_rules, longest_prefix_project, graph_edges_merge, graph_nodes, graph_replace_file, graph_prune_orphans, deps_upstream, deps_downstream, deps_imports_2hop, deps_nodes,
    deps_capped, edge_groups, deps_summary, deps_project, deps_look_up, deps_bad_direction, corpus_ingest_edges, reindex_points, project_tree_answers, file_dependencies, project_files, project_tree_paths, project_tree_render, read_files,
)
QUERIES = {f.__name__: f for f in _ALL}

_WINDOWS = """
WITH src AS ({}),
w AS (SELECT id, content, unnest(list_filter(range(0, CAST(length(content) AS BIGINT), 600), lambda p: p = 0 OR p - 600 + 2400 < length(content))) AS st FROM src WHERE length(content) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY st) - 1 AS chunk_no, least(st + 2400, length(content)) AS en FROM w)
"""
_EV = """
WITH raw AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY delivery_id) AS rn FROM file_events),
ev AS (SELECT event_id, machine_id, project, upper(trim(event_type)) AS event_type, nfc_normalize(path) AS path, nfc_normalize(old_path) AS old_path, content_hash, content,
  CASE WHEN timestamp_seconds >= 100000000000 THEN timestamp_seconds // 1000 ELSE timestamp_seconds END AS sec FROM raw WHERE rn = 1),
st AS (SELECT machine_id, nfc_normalize(file_path) AS file_path, arg_max(file_id, (updated_at, file_id)) AS file_id, arg_max(content_hash, (updated_at, file_id)) FILTER (WHERE content_hash IS NOT NULL) AS content_hash FROM files GROUP BY 1, 2),
gone AS (SELECT machine_id, path, sec, event_id FROM ev WHERE event_type IN ('DELETE', 'RENAME') AND path IS NOT NULL
  UNION ALL SELECT machine_id, old_path, sec, event_id FROM ev WHERE event_type IN ('DELETE', 'RENAME') AND old_path IS NOT NULL AND old_path IS DISTINCT FROM path)
"""
_TWICE = """, twice AS (SELECT event_id, machine_id, path, event_type, sec, content_hash FROM ev UNION ALL SELECT -event_id - 1, machine_id, path, event_type, sec + 600, content_hash FROM ev)
SELECT event_id FROM (SELECT *, lag(content_hash) OVER (PARTITION BY machine_id, path ORDER BY sec, event_id) AS b FROM twice WHERE event_type IN ('CREATE', 'MODIFY') AND content_hash IS NOT NULL) WHERE content_hash = b"""
_LINES = "regexp_split_to_array({}, '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
_BLANK = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_SYM = f"""
WITH src AS (SELECT delivery_id, content, entities, {_LINES.format("content")} AS l0 FROM file_events WHERE content IS NOT NULL),
src2 AS (SELECT delivery_id, content, entities, CASE WHEN l0[-1] = '' THEN l0[:-2] ELSE l0 END AS ln FROM src),
e AS (SELECT delivery_id, ln, i - 1 AS entity_index, entities[i].name AS name, entities[i].start_line AS s, entities[i].end_line AS t FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS i FROM src2)),
x AS (SELECT delivery_id, entity_index, name, s, t, left(regexp_replace(regexp_replace(array_to_string(ln[s:t], chr(10)), '^{_BLANK}+', ''), '{_BLANK}+$', ''), 32000) AS text FROM e WHERE s >= 1 AND t >= s AND s <= len(ln)),
sym AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id, name, s, t ORDER BY entity_index) AS rn FROM x WHERE text <> '') WHERE rn = 1)
"""
_GRAPH = """
WITH ent AS (SELECT machine_id, file_path, name, arg_max(project, (first_seen_at, entity_id)) AS project FROM entities WHERE removed_at IS NULL GROUP BY 1, 2, 3),
r AS (SELECT *, nullif(source, '') AS src, nullif(symbol_id, '') AS sym FROM relations WHERE relation_type IN ('CALLS_SYNTAX', 'CALLS_RESOLVED', 'REFERENCES', 'CONTAINS', 'IMPORTS', 'IMPORTS_RESOLVED')),
ok AS (SELECT * FROM r WHERE relation_type IN ('IMPORTS', 'IMPORTS_RESOLVED')
  OR (relation_type = 'CALLS_SYNTAX' AND EXISTS (SELECT 1 FROM ent e WHERE e.machine_id = r.machine_id AND e.file_path = r.file_path AND e.name = r.src))
  OR (relation_type IN ('CALLS_RESOLVED', 'REFERENCES') AND sym IS NOT NULL AND EXISTS (SELECT 1 FROM ent e WHERE e.machine_id = r.machine_id AND e.file_path = r.file_path AND e.name = r.src))
  OR (relation_type = 'CONTAINS' AND EXISTS (SELECT 1 FROM ent e WHERE e.machine_id = r.machine_id AND e.file_path = r.file_path AND e.name = r.target))),
shaped AS (SELECT CASE WHEN relation_type IN ('CALLS_SYNTAX', 'CALLS_RESOLVED', 'REFERENCES') THEN machine_id || ':' || file_path || '#' || src ELSE machine_id || ':' || file_path END AS from_id, relation_type AS relation,
  CASE WHEN relation_type = 'CONTAINS' THEN machine_id || ':' || file_path || '#' || target WHEN relation_type IN ('CALLS_RESOLVED', 'REFERENCES') THEN machine_id || ':' || sym ELSE machine_id || ':' || target END AS to_id,
  machine_id, project, file_path, CASE WHEN relation_type = 'CONTAINS' THEN 'Entity' WHEN relation_type LIKE 'IMPORTS%' THEN 'Module' WHEN relation_type = 'CALLS_SYNTAX' THEN 'UnresolvedSymbol' ELSE 'ResolvedSymbol' END AS to_kind,
  coalesce(line, 0) AS line, coalesce(nullif(confidence, ''), 'syntax') AS confidence, coalesce(nullif(layer, ''), 'syntax') AS layer, coalesce(nullif(status, ''), 'observed') AS status, coalesce(sym, '') AS symbol_id, observed_at, relation_id FROM ok),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_id, relation, to_id ORDER BY observed_at DESC NULLS LAST, relation_id DESC) AS rn FROM shaped) WHERE rn = 1),
nodes AS (SELECT machine_id || ':' || file_path || '#' || name AS id, machine_id, 'Entity' AS kind, name, file_path FROM ent
  UNION ALL SELECT DISTINCT machine_id || ':' || file_path, machine_id, 'File', NULL, file_path FROM (SELECT machine_id, file_path FROM ent UNION SELECT machine_id, file_path FROM edges)
  UNION ALL SELECT DISTINCT to_id, machine_id, to_kind, substr(to_id, length(machine_id) + 2), NULL FROM edges WHERE to_kind <> 'Entity'),
gone AS (SELECT DISTINCT machine_id, file_path FROM files WHERE updated_at >= '2025-10-01'),
kept AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.machine_id = e.machine_id AND g.file_path = e.file_path)
  AND NOT (to_kind = 'Entity' AND EXISTS (SELECT 1 FROM gone g WHERE g.machine_id = e.machine_id AND g.file_path = string_split(substr(to_id, length(e.machine_id) + 2), '#')[1]))),
roots AS (SELECT id FROM nodes WHERE kind = 'Entity' AND name = 'split'),
found AS (SELECT 1 AS phase, e.* FROM edges e WHERE to_id IN (SELECT id FROM roots) UNION ALL SELECT 2, e.* FROM edges e WHERE from_id IN (SELECT id FROM roots)
  UNION ALL SELECT 3, e.* FROM edges e WHERE relation LIKE 'IMPORTS%' AND from_id IN (SELECT from_id FROM edges WHERE relation = 'CONTAINS' AND to_id IN (SELECT id FROM roots))),
seen AS (SELECT id, min(phase) AS phase FROM (SELECT id, 0 AS phase FROM roots UNION ALL SELECT CASE WHEN phase = 1 THEN from_id ELSE to_id END, phase FROM found) GROUP BY id),
top_nodes AS (SELECT id FROM seen ORDER BY phase, id LIMIT 50)
"""
_GROUPS = """CASE relation WHEN 'IMPORTS' THEN ['imports'] WHEN 'IMPORTS_RESOLVED' THEN ['imports', 'imports_resolved'] WHEN 'CALLS_SYNTAX' THEN ['calls', 'calls_syntax'] WHEN 'CALLS_RESOLVED' THEN ['calls', 'calls_resolved']
 WHEN 'REFERENCES' THEN ['references'] WHEN 'CONTAINS' THEN ['contains'] WHEN 'DEPENDS_ON' THEN ['dependencies'] ELSE ['other'] END"""
_UUID = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(machine_id || ':' || project || ':' || file_path || ':' || coalesce(name, '') || ':' || coalesce(start_line, 0)))"
_IGN = "['" + "','".join(ingest.IGNORED) + "']"

ORACLE = {
    "chunk_windows": _WINDOWS.format("SELECT doc_id AS id, text AS content FROM documents") + 'SELECT id AS doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS "end" FROM n',
    "window_line_numbers": _WINDOWS.format("SELECT file_id AS id, content FROM files WHERE content IS NOT NULL")
    + "SELECT id AS file_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(string_split(left(content, st), chr(10))) AS INTEGER) AS start_line, CAST(len(string_split(left(content, en), chr(10))) AS INTEGER) AS end_line FROM n",
    "symbol_slice": _SYM + "SELECT delivery_id, CAST(entity_index AS INTEGER) AS entity_index, name, md5(text) AS text_md5 FROM sym",
    "chunk_cap": _SYM + """,
plain AS (SELECT delivery_id, content FROM src2 WHERE content <> '' AND delivery_id NOT IN (SELECT delivery_id FROM sym)),
win AS (SELECT delivery_id, st AS o, substr(content, st + 1, 2400) AS text FROM (SELECT *, unnest(list_filter(range(0, CAST(length(content) AS BIGINT), 600), lambda p: p = 0 OR p - 600 + 2400 < length(content))) AS st FROM plain)),
c AS (SELECT delivery_id, entity_index AS o, text FROM sym UNION ALL SELECT * FROM win),
k AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY o) AS rn FROM c)
SELECT delivery_id, count(*) AS n_chunks, CAST(sum(length(left(text, 500))) AS BIGINT) AS snippet_chars FROM k WHERE rn <= 5 GROUP BY 1""",
    "point_uuid5": f"""WITH h AS (SELECT entity_id, {_UUID} AS h FROM entities WHERE project IS NOT NULL)
SELECT entity_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "node_ids": "SELECT entity_id, machine_id || ':' || file_path || '#' || name AS id FROM entities",
    "nfc_path": "SELECT file_id, nfc_normalize(file_path) AS path FROM files",
    "content_hash": "SELECT file_id, sha256(content) AS sha256 FROM files WHERE content IS NOT NULL",
    "hash_short_circuit": _EV + "SELECT event_id, coalesce(ev.content_hash = st.content_hash, false) AS unchanged FROM ev LEFT JOIN st ON st.machine_id = ev.machine_id AND st.file_path = ev.path WHERE event_type IN ('CREATE', 'MODIFY') AND content IS NOT NULL",
    "upsert_latest": _EV + "SELECT machine_id, file_path, file_id, content_hash FROM st",
    "keyed_upsert": _EV + """,
a AS (SELECT machine_id, nfc_normalize(file_path) AS file_path, updated_at >= '2025-10-01' AS fresh, arg_max(file_id, (updated_at, file_id)) AS file_id, arg_max(content_hash, (updated_at, file_id)) FILTER (WHERE content_hash IS NOT NULL) AS content_hash FROM files GROUP BY 1, 2, 3)
SELECT machine_id, file_path, arg_max(file_id, fresh) AS file_id, arg_max(content_hash, fresh) FILTER (WHERE content_hash IS NOT NULL) AS content_hash FROM a GROUP BY 1, 2""",
    "delete_fanout": _EV + "SELECT machine_id, path, sec, event_id FROM gone",
    "deletes_first": _EV + """,
put AS (SELECT machine_id, path AS file_path, arg_max({'h': content_hash}, (sec, event_id)).h AS content_hash FROM ev WHERE event_type IN ('CREATE', 'MODIFY') AND content IS NOT NULL GROUP BY 1, 2),
kept AS (SELECT machine_id, file_path, content_hash FROM st WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.machine_id = st.machine_id AND g.path = st.file_path))
SELECT coalesce(p.machine_id, k.machine_id) AS machine_id, coalesce(p.file_path, k.file_path) AS file_path, coalesce(p.content_hash, k.content_hash) AS content_hash FROM put p FULL JOIN kept k ON p.machine_id = k.machine_id AND p.file_path = k.file_path""",
    "event_type_fold": _EV + """SELECT machine_id, path, CASE WHEN arg_max(event_type, (sec, event_id)) <> 'MODIFY' THEN arg_max(event_type, (sec, event_id)) WHEN bool_or(event_type <> 'MODIFY') THEN 'CREATE' ELSE 'MODIFY' END AS folded_type,
  arg_max(event_id, (sec, event_id)) AS last_event_id FROM ev GROUP BY 1, 2""",
    "batch_chunking": _EV + "SELECT project, event_id, (row_number() OVER (PARTITION BY project ORDER BY sec, event_id) - 1) // 50 AS batch_no FROM ev",
    "unchanged_events": _EV + _TWICE,
    "ignored_paths": f"""WITH p AS (SELECT file_id, list_filter(string_split(regexp_replace(file_path, '^/(home/build|srv/code|data/repos|workspace)/', ''), '/'), lambda x: x <> '') AS parts FROM files)
SELECT file_id FROM p WHERE list_has_any(parts, {_IGN}) OR regexp_matches(parts[-1], '(\\.log|\\.tmp|\\.swp|\\.swo|\\.DS_Store)$')""",
    "ignored_by_rules": f"""WITH p AS (SELECT file_id, regexp_replace(file_path, '^/(home/build|srv/code|data/repos|workspace)/[^/]+/', '') AS rel FROM files),
q AS (SELECT file_id, rel, list_filter(string_split(rel, '/'), lambda x: x <> '') AS parts FROM p)
SELECT file_id FROM q WHERE list_has_any(parts, {_IGN}) OR regexp_matches(parts[-1], '(\\.log|\\.tmp|\\.swp|\\.swo|\\.DS_Store)$')
  OR CASE WHEN regexp_matches(rel, '^pkg/(.*/)?[^/]*\\.ts(/.*)?$') THEN true WHEN rel LIKE 'internal/%' THEN true WHEN len(list_filter(parts, lambda x: starts_with(x, 'cursor'))) > 0 THEN false ELSE len(list_filter(parts, lambda x: x LIKE '%\\_f.js' ESCAPE '\\')) > 0 END
  OR (regexp_matches(rel, '^services/[^/]*/[^/]*\\.py(/.*)?$') AND NOT regexp_matches(rel, '^services/luban_[^/]*/[^/]*'))
  OR regexp_matches(parts[-1], '^[^/]*_trace_[^/]\\.go$')""",
    "longest_prefix_project": """WITH roots AS (SELECT root, min(project) AS project FROM (SELECT regexp_extract(file_path, '^(.*?/[^/]*-[^/]*)/', 1) AS root, project FROM files WHERE project IS NOT NULL) WHERE root <> '' GROUP BY 1),
p AS (SELECT DISTINCT file_path AS path FROM files WHERE file_path IS NOT NULL),
a AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS root FROM p),
h AS (SELECT path, arg_max(project, length(root)) AS project FROM a JOIN roots USING (root) GROUP BY 1)
SELECT p.path, coalesce(h.project, coalesce(string_split(p.path, '/')[-2], '')) AS project FROM p LEFT JOIN h ON h.path = p.path""",
    "graph_edges_merge": _GRAPH + "SELECT from_id, relation, to_id, to_kind, line, confidence, layer, status, symbol_id FROM edges",
    "graph_nodes": _GRAPH + "SELECT id, kind, name FROM nodes",
    "graph_replace_file": _GRAPH + "SELECT from_id, relation, to_id FROM kept",
    "graph_prune_orphans": _GRAPH + "SELECT DISTINCT id, kind FROM nodes WHERE kind IN ('Module', 'UnresolvedSymbol', 'ResolvedSymbol') AND id NOT IN (SELECT to_id FROM kept UNION SELECT from_id FROM kept)",
    "deps_upstream": _GRAPH + "SELECT phase, from_id, relation, to_id FROM found WHERE phase = 1",
    "deps_downstream": _GRAPH + "SELECT phase, from_id, relation, to_id FROM found WHERE phase > 1",
    "deps_imports_2hop": _GRAPH + "SELECT from_id, relation, to_id FROM found WHERE phase = 3",
    "deps_nodes": _GRAPH + "SELECT id, phase FROM seen",
    "deps_capped": _GRAPH + "SELECT phase, from_id, relation, to_id FROM found WHERE from_id IN (SELECT id FROM top_nodes) AND to_id IN (SELECT id FROM top_nodes) ORDER BY phase, from_id, relation, to_id LIMIT 100",
    "edge_groups": _GRAPH + f"SELECT unnest({_GROUPS}) AS edge_group, phase, from_id, relation, to_id FROM found",
    "deps_project": _GRAPH + """,
np AS (SELECT machine_id || ':' || file_path || '#' || name AS id, project FROM ent
  UNION ALL SELECT id, arg_max({'p': project}, (coalesce(observed_at, TIMESTAMP '0001-01-01'), relation_id)).p FROM (SELECT from_id AS id, project, observed_at, relation_id FROM edges WHERE relation IN ('CONTAINS', 'IMPORTS', 'IMPORTS_RESOLVED') UNION ALL SELECT to_id, project, observed_at, relation_id FROM edges WHERE to_kind <> 'Entity') GROUP BY id),
inside AS (SELECT DISTINCT id FROM np WHERE project = 'lattice-core'),
pe AS (SELECT * FROM edges WHERE from_id IN (SELECT id FROM inside) AND to_id IN (SELECT id FROM inside)),
pr AS (SELECT id FROM roots WHERE id IN (SELECT id FROM inside))
SELECT 1 AS phase, from_id, relation, to_id FROM pe WHERE to_id IN (SELECT id FROM pr) UNION ALL SELECT 2, from_id, relation, to_id FROM pe WHERE from_id IN (SELECT id FROM pr)
UNION ALL SELECT 3, from_id, relation, to_id FROM pe WHERE relation LIKE 'IMPORTS%' AND from_id IN (SELECT from_id FROM pe WHERE relation = 'CONTAINS' AND to_id IN (SELECT id FROM pr))""",
    "deps_look_up": _GRAPH + f""",
inn AS (SELECT * FROM found WHERE from_id IN (SELECT id FROM top_nodes) AND to_id IN (SELECT id FROM top_nodes)),
kept_e AS (SELECT unnest({_GROUPS}) AS g FROM (SELECT * FROM inn ORDER BY phase, from_id, relation, to_id LIMIT 100))
SELECT least(50, (SELECT count(*) FROM seen)) AS node_count, least(100, (SELECT count(*) FROM inn)) AS edge_count, (SELECT count(*) FROM seen) AS full_node_count, (SELECT count(*) FROM found) AS full_edge_count,
  (SELECT count(*) FROM seen) > 50 AS nodes_truncated, (SELECT count(*) FROM inn) > 100 AS edges_truncated, """ + ", ".join(f"count(*) FILTER (WHERE g = '{g}') AS {g}" for g in sorted({g for gs in graph.GROUPS.values() for g in gs})) + " FROM kept_e",
    "deps_bad_direction": _GRAPH + "SELECT id, 0 AS phase FROM roots",
    "corpus_ingest_edges": _GRAPH + """,
touched AS (SELECT DISTINCT machine_id, file_path FROM files WHERE updated_at >= '2025-10-01' AND content IS NOT NULL),
stay AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM touched g WHERE g.machine_id = e.machine_id AND g.file_path = e.file_path)
  AND NOT (to_kind = 'Entity' AND EXISTS (SELECT 1 FROM touched g WHERE g.machine_id = e.machine_id AND g.file_path = string_split(substr(to_id, length(e.machine_id) + 2), '#')[1])))
SELECT from_id, relation, to_id, to_kind FROM stay UNION
SELECT from_id, relation, to_id, to_kind FROM shaped s WHERE observed_at >= '2026-01-01' AND EXISTS (SELECT 1 FROM touched g WHERE g.machine_id = s.machine_id AND g.file_path = s.file_path)""",
    "reindex_points": _WINDOWS.format("SELECT file_id AS id, machine_id, file_path, content FROM files WHERE content <> '' AND length(content) < 100000 AND machine_id <> 'wren-1'").replace("SELECT id, content, unnest", "SELECT *, unnest")
    + "SELECT machine_id, file_path, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(len(string_split(left(content, st), chr(10))) AS INTEGER) AS start_line, CAST(len(string_split(left(content, en), chr(10))) AS INTEGER) AS end_line FROM n WHERE chunk_no < 64",
    "deps_summary": _GRAPH + f"SELECT edge_group, count(*) AS n_edges FROM (SELECT unnest({_GROUPS}) AS edge_group FROM edges) GROUP BY 1",
    "file_dependencies": _GRAPH + """, pairs AS (SELECT DISTINCT machine_id, file_path AS from_path, substr(trim(target_ref), length(machine_id) + 2) AS to_path FROM relations WHERE relation_type = 'IMPORTS_RESOLVED' AND starts_with(trim(target_ref), machine_id || ':'))
SELECT p.machine_id, from_path, to_path, count(*) AS n_edges FROM pairs p JOIN ent a ON a.machine_id = p.machine_id AND a.file_path = from_path JOIN ent b ON b.machine_id = p.machine_id AND b.file_path = to_path GROUP BY 1, 2, 3""",
    "project_files": _GRAPH + "SELECT machine_id, file_path, name FROM ent WHERE project = 'lattice-core'",
    "project_tree_paths": """WITH p AS (SELECT machine_id, project, list_filter(string_split(file_path, '/'), lambda x: x <> '') AS parts FROM files WHERE project IS NOT NULL),
b AS (SELECT machine_id, project, CASE WHEN list_position(parts, project) > 0 THEN parts[list_position(parts, project) + 1:] ELSE parts[-1:] END AS p FROM p),
n AS (SELECT machine_id, project, p, unnest(range(1, len(p) + 1)) AS k FROM b)
SELECT machine_id, project, array_to_string(p[1:k], '/') AS path, bool_or(k < len(p)) AS is_dir FROM n GROUP BY 1, 2, 3""",
    "read_files": """WITH asked AS (SELECT DISTINCT machine_id, path AS file_path FROM file_events), st AS (SELECT machine_id, file_path, content FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, file_path ORDER BY updated_at DESC, file_id DESC) AS rn FROM files) WHERE rn = 1)
SELECT a.machine_id, a.file_path, md5(coalesce(content, '[file not found: ' || a.file_path || ']')) AS md5 FROM asked a LEFT JOIN st ON st.machine_id = a.machine_id AND st.file_path = a.file_path""",
}
ORACLE["project_tree_render"] = f"""
WITH n AS (SELECT machine_id, project, path, is_dir, string_split(path, '/') AS parts FROM ({ORACLE["project_tree_paths"]})),
k AS (SELECT *, len(parts) AS depth, array_to_string(parts[1:len(parts) - 1], '/') AS parent,
  coalesce(array_to_string(list_transform(parts[1:len(parts) - 1], lambda p: '1' || p || chr(1)), ''), '') || CASE WHEN is_dir THEN '1' ELSE '0' END || parts[-1] || CASE WHEN is_dir THEN chr(1) ELSE '' END AS key FROM n),
l AS (SELECT *, key = max(key) OVER (PARTITION BY machine_id, project, parent) AS is_last, row_number() OVER (PARTITION BY machine_id, project ORDER BY key) AS r FROM k),
u AS (SELECT machine_id, project, path, unnest(range(1, depth)) AS d, parts FROM l WHERE r <= 300),
a AS (SELECT u.machine_id, u.project, u.path, string_agg(CASE WHEN x.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY u.d) AS indent
  FROM u JOIN l x ON x.machine_id = u.machine_id AND x.project = u.project AND x.path = array_to_string(u.parts[1:u.d], '/') GROUP BY 1, 2, 3)
SELECT l.machine_id, l.project, l.project || '/' || chr(10) || string_agg(coalesce(indent, '') || CASE WHEN is_last THEN '└── ' ELSE '├── ' END || parts[-1] || CASE WHEN is_dir THEN '/' ELSE '' END, chr(10) ORDER BY key) FILTER (WHERE r <= 300)
  || CASE WHEN count(*) > 300 THEN chr(10) || '[truncated]' ELSE '' END AS tree
FROM l LEFT JOIN a ON a.machine_id = l.machine_id AND a.project = l.project AND a.path = l.path GROUP BY l.machine_id, l.project"""
ORACLE["project_tree_answers"] = f"""
WITH asked AS (SELECT DISTINCT machine_id, project FROM queue_events WHERE project IS NOT NULL), stored AS ({ORACLE["project_tree_render"]})
SELECT a.machine_id, a.project, md5(coalesce(tree, '[project not found: ' || a.project || ']')) AS tree_md5 FROM asked a LEFT JOIN stored s ON s.machine_id = a.machine_id AND s.project = a.project"""
