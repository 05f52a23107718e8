"""The property graph as two tables, nodes and edges: upsert of typed relations, replacement, pruning, and bounded dependency look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverloom.functions.identifiers import node_id

#: Relation types that a look-up follows.
TRAVERSED = ("DEPENDS_ON", "CALLS_SYNTAX", "CALLS_RESOLVED", "CONTAINS", "IMPORTS", "IMPORTS_RESOLVED", "REFERENCES")
MAX_NODES, MAX_EDGES = 50, 100
#: The groups an edge belongs to.
GROUPS = {
    "IMPORTS": ["imports"], "IMPORTS_RESOLVED": ["imports", "imports_resolved"], "CALLS_SYNTAX": ["calls", "calls_syntax"], "CALLS": ["calls"],
    "CALLS_RESOLVED": ["calls", "calls_resolved"], "REFERENCES": ["references"], "CONTAINS": ["contains"], "DEPENDS_ON": ["dependencies"],
}
EDGE = ["from_id", "relation", "to_id"]


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)


def live_entities(entities: DataFrame) -> DataFrame:
    """One row per existing entity: the newest of its rows by (first_seen_at, entity_id)."""
    newest = F.max(F.struct("first_seen_at", "entity_id", "project", "entity_type", "start_line", "end_line")).alias("m")
    return entities.filter("removed_at IS NULL").groupBy("machine_id", "file_path", "name").agg(newest).select("machine_id", "file_path", "name", "m.project", "m.entity_type", "m.start_line", "m.end_line")


def merged_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One edge per (source, type, target): the last observation by (observed_at, relation_id) gives its properties.

    Calls and references need a source entity that exists, those that are resolved also a symbol_id; CONTAINS needs its target entity; imports
    stand on their own; other types are ignored.
    """
    known = entities.select("machine_id", "file_path", F.col("name").alias("__sl_name"))
    r = relations.withColumns({"source": F.nullif("source", F.lit("")), "symbol_id": F.nullif("symbol_id", F.lit(""))})
    kind = F.col("relation_type")
    calls = r.filter((kind == "CALLS_SYNTAX") & F.col("source").isNotNull() | kind.isin("CALLS_RESOLVED", "REFERENCES") & F.col("source").isNotNull() & F.col("symbol_id").isNotNull())
    contains = r.filter(kind == "CONTAINS")
    tied = calls.withColumn("__sl_name", F.col("source")).unionByName(contains.withColumn("__sl_name", F.col("target"))).join(known, ["machine_id", "file_path", "__sl_name"], "left_semi").drop("__sl_name")
    rows = tied.unionByName(r.filter(kind.isin("IMPORTS", "IMPORTS_RESOLVED")))
    none = F.lit(None).cast("string")
    to_symbol = F.when(kind.isin("CALLS_RESOLVED", "REFERENCES"), F.col("symbol_id")).otherwise(F.col("target"))
    shaped = rows.select(
        node_id(F.col("machine_id"), F.col("file_path"), F.when(kind.isin("CALLS_SYNTAX", "CALLS_RESOLVED", "REFERENCES"), F.col("source"))).alias("from_id"),
        kind.alias("relation"),
        F.when(kind == "CONTAINS", node_id(F.col("machine_id"), F.col("file_path"), F.col("target"))).otherwise(node_id(F.col("machine_id"), none, to_symbol)).alias("to_id"),
        "machine_id", "project", "file_path",
        F.when(kind == "CONTAINS", "Entity").when(kind.isin("IMPORTS", "IMPORTS_RESOLVED"), "Module").when(kind == "CALLS_SYNTAX", "UnresolvedSymbol").otherwise("ResolvedSymbol").alias("to_kind"),
        F.when(kind.isin("CONTAINS", "IMPORTS", "IMPORTS_RESOLVED"), "File").otherwise("Entity").alias("from_kind"),
        F.coalesce("line", F.lit(0)).alias("line"), _or("confidence", "syntax"), _or("layer", "syntax"), _or("status", "observed"), _or("symbol_id", ""), "observed_at", "relation_id",
    )
    rest = [c for c in shaped.columns if c not in (*EDGE, "observed_at", "relation_id")]
    last = shaped.groupBy(*EDGE).agg(F.max(F.struct("observed_at", "relation_id", *rest)).alias("m"))
    return last.select(*EDGE, *[F.col(f"m.{c}").alias(c) for c in (*rest, "observed_at", "relation_id")])


def graph_nodes(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, machine_id, kind, name, file_path): entities, their files, and what edges lead to."""
    none = F.lit(None).cast("string")
    files = entities.select("machine_id", "file_path").union(edges.select("machine_id", "file_path")).distinct()
    return (
        entities.select(node_id(F.col("machine_id"), F.col("file_path"), F.col("name")).alias("id"), "machine_id", F.lit("Entity").alias("kind"), "name", "file_path")
        .unionByName(files.select(node_id(F.col("machine_id"), F.col("file_path"), none).alias("id"), "machine_id", F.lit("File").alias("kind"), none.alias("name"), "file_path"))
        .unionByName(
            edges.filter("to_kind <> 'Entity'").select(F.col("to_id").alias("id"), "machine_id", F.col("to_kind").alias("kind"), F.expr("substr(to_id, length(machine_id) + 2)").alias("name"), none.alias("file_path")).distinct()
        )
    )


def node_projects(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, project) of every node that edges touch: an entity has its own project, a file, module or symbol that of the newest edge that named it."""
    own = entities.select(node_id(F.col("machine_id"), F.col("file_path"), F.col("name")).alias("id"), "project")
    named = edges.filter("from_kind = 'File'").select(F.col("from_id").alias("id"), "project", "observed_at", "relation_id").unionByName(edges.filter("to_kind <> 'Entity'").select(F.col("to_id").alias("id"), "project", "observed_at", "relation_id"))
    return own.unionByName(named.groupBy("id").agg(F.max(F.struct("observed_at", "relation_id", "project")).alias("m")).select("id", "m.project"))


def detach_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """The edges that stay when the entities and nodes of ``files`` (machine_id, file_path) are deleted with all that is attached to them."""
    gone = files.select("machine_id", "file_path").distinct()
    kept = edges.join(gone, ["machine_id", "file_path"], "left_anti")
    # edges of other files that end on an entity of a deleted one
    ends = F.split(F.expr("substr(to_id, length(machine_id) + 2)"), "#")[0]
    return kept.filter("to_kind <> 'Entity'").unionByName(
        kept.filter("to_kind = 'Entity'").withColumn("__sl_end", ends).join(gone.withColumnRenamed("file_path", "__sl_end"), ["machine_id", "__sl_end"], "left_anti").drop("__sl_end").select(*kept.columns)
    )


def orphan_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Module and symbol nodes without any edge."""
    used = edges.select(F.col("to_id").alias("id")).union(edges.select(F.col("from_id").alias("id")))
    return nodes.filter(F.col("kind").isin("Module", "UnresolvedSymbol", "ResolvedSymbol")).join(used, "id", "left_anti")


def dependencies(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "both", machine_id: str | None = None, project: str | None = None, projects: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) one step around all entities of a name: phase 0 root, 1 upstream, 2 downstream, 3 imports of the containing file.

    Any other direction than upstream, downstream and both gives the roots only. Nodes come once, by their first phase; edges are not merged.
    With ``project`` the roots and both ends of every edge must be of it, by ``projects`` (id, project).
    """
    scope = (lambda d: d.filter(F.col("machine_id") == machine_id)) if machine_id else (lambda d: d)
    roots = scope(nodes.filter((F.col("kind") == "Entity") & (F.col("name") == name))).select("id", "machine_id", "file_path")
    followed = scope(edges.filter(F.col("relation").isin(*TRAVERSED)))
    if project:
        inside = projects.filter(F.col("project") == project).select("id").distinct()
        roots = roots.join(inside, "id", "left_semi")
        followed = followed.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(inside.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)
    parts = []
    root_ids = roots.select(F.col("id").alias("__sl_root")).distinct()
    if direction in ("upstream", "both"):
        parts.append(followed.join(root_ids, followed.to_id == F.col("__sl_root"), "left_semi").withColumn("phase", F.lit(1)))
    if direction in ("downstream", "both"):
        parts.append(followed.join(root_ids, followed.from_id == F.col("__sl_root"), "left_semi").withColumn("phase", F.lit(2)))
        contains = followed.filter("relation = 'CONTAINS'").join(root_ids, F.col("to_id") == F.col("__sl_root"), "left_semi").select(F.col("from_id").alias("__sl_file")).distinct()
        parts.append(followed.filter("relation IN ('IMPORTS', 'IMPORTS_RESOLVED')").join(contains, F.col("from_id") == F.col("__sl_file"), "left_semi").withColumn("phase", F.lit(3)))
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    if found is None:
        found = followed.withColumn("phase", F.lit(0)).filter("false")
    other = found.select(F.when(F.col("phase") == 1, F.col("from_id")).otherwise(F.col("to_id")).alias("id"), "phase")
    seen = roots.select("id", F.lit(0).alias("phase")).unionByName(other).groupBy("id").agg(F.min("phase").alias("phase"))
    return seen, found


def capped(seen: DataFrame, found: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> tuple[DataFrame, DataFrame]:
    """The first nodes, then of the edges with both ends among them the first ones. Order: phase, then relation and ids."""
    nodes = seen.orderBy("phase", "id").limit(max_nodes)
    ids = nodes.select("id")
    both = found.join(F.broadcast(ids.withColumnRenamed("id", "from_id")), "from_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "to_id")), "to_id", "left_semi")  # at most max_nodes rows
    return nodes, both.orderBy("phase", *EDGE).limit(max_edges)


def look_up_summary(seen: DataFrame, found: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """One row about a look-up: what the caps leave, what there was before, whether they cut nodes or edges between kept nodes, and edges per group."""
    nodes, _ = capped(seen, found, max_nodes, max_edges)
    ids = nodes.select("id")
    inside = found.join(F.broadcast(ids.withColumnRenamed("id", "from_id")), "from_id", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "to_id")), "to_id", "left_semi")  # at most max_nodes rows
    kept = inside.orderBy("phase", *EDGE).limit(max_edges)
    names = sorted({g for gs in GROUPS.values() for g in gs})
    groups = edge_groups(kept).agg(*[F.count_if(F.col("edge_group") == g).alias(g) for g in names])
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    counts = n(seen, "full_node_count").crossJoin(n(found, "full_edge_count")).crossJoin(n(inside, "__sl_inside")).crossJoin(groups)  # one row each
    return counts.select(
        F.least("full_node_count", F.lit(max_nodes)).cast("long").alias("node_count"), F.least("__sl_inside", F.lit(max_edges)).cast("long").alias("edge_count"), "full_node_count", "full_edge_count",
        (F.col("full_node_count") > max_nodes).alias("nodes_truncated"), (F.col("__sl_inside") > max_edges).alias("edges_truncated"), *names,
    )


def edge_groups(edges: DataFrame) -> DataFrame:
    """A row (edge_group, edge columns) for every group an edge belongs to; unknown relations are "other"."""
    table = F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return edges.select("*", F.explode(F.coalesce(table[F.col("relation")], F.array(F.lit("other")))).alias("edge_group"))


def edge_summary(edges: DataFrame) -> DataFrame:
    return edge_groups(edges).groupBy("edge_group").agg(F.count(F.lit(1)).alias("n_edges"))


def file_dependencies(entities: DataFrame, pairs: DataFrame, relation: str = "DEPENDS_ON") -> DataFrame:
    """Entity-to-entity edges between the entities of two files, for given file pairs (machine_id, from_path, to_path). Other relations than those of a look-up are refused."""
    if relation not in TRAVERSED:
        raise ValueError(f"unknown relation {relation}")
    a = entities.select("machine_id", F.col("file_path").alias("from_path"), F.col("name").alias("from_name"))
    b = entities.select("machine_id", F.col("file_path").alias("to_path"), F.col("name").alias("to_name"))
    return pairs.distinct().join(a, ["machine_id", "from_path"]).join(b, ["machine_id", "to_path"]).withColumn("relation", F.lit(relation))


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("__sl_rn", F.row_number().over(w)).filter("__sl_rn = 1").drop("__sl_rn")
