"""Keyed tables of the corpus: scopes, vectors, token index, query cache, health; and the fold of a batch of events into all of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverloom.functions.embedding import get_embedder
from silverloom.functions.identifiers import point_id
from silverloom.functions.text import index_tokens
from silverloom.operators import chunking, graph, ingest, stats, tree
from silverloom.session import staged
from silverloom.sources.schema import RELATION

MAX_EMBED_CHARS = 100_000


def scoped(df: DataFrame, machine_id: str | None = None, project: str | None = None) -> DataFrame:
    """Rows of a scope; an empty or missing name sets no bound."""
    if machine_id:
        df = df.filter(F.col("machine_id") == machine_id)
    if project:
        df = df.filter(F.col("project") == project)
    return df


def ordered_scan(files: DataFrame, skip_machines: list[str] | None = None) -> DataFrame:
    """All files in the order (machine, project, path), without some machines."""
    rows = files.filter(~F.col("machine_id").isin(skip_machines)) if skip_machines else files
    return rows.orderBy("machine_id", "project", "file_path")


def known_hashes(files: DataFrame) -> DataFrame:
    return files.filter("content_hash IS NOT NULL").select("machine_id", "file_path", "content_hash")


def overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace the old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows but for those of some files (machine_id, file_path)."""
    return rows.join(files.select("machine_id", "file_path").distinct(), ["machine_id", "file_path"], "left_anti")


def without_machine(rows: DataFrame, machine_id: str) -> DataFrame:
    return rows.filter(~F.col("machine_id").eqNullSafe(F.lit(machine_id)))


def token_rows(files: DataFrame) -> DataFrame:
    """(machine_id, file_path, field, term, n) of the token index."""
    t = files.select("machine_id", "file_path", F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array(index_tokens(F.col("file_path")), index_tokens(F.coalesce("content", F.lit("")))))).alias("field", "terms"))
    return t.select("machine_id", "file_path", "field", F.explode("terms").alias("term")).groupBy("machine_id", "file_path", "field", "term").agg(F.count(F.lit(1)).alias("n"))


def sync_tokens(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The token index after files changed: their old rows go, their new ones come."""
    return without_files(index, changed).unionByName(token_rows(changed))


def cache_key(backend: Column, model: Column, text: Column) -> Column:
    """Key of a query embedding: the trimmed text in lower case."""
    return F.sha2(F.concat_ws(":", backend, model, F.lit("query"), F.lower(F.trim(text))), 256)


def cached_embeddings(cache: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(embeddings of all queries, cache with the new ones). Cache: cache_key, embedding. Queries: qid, cache_key, query."""
    hit = queries.join(cache, "cache_key")
    fresh = queries.join(cache, "cache_key", "left_anti")
    made = get_embedder().embedded(fresh.groupBy("cache_key").agg(F.min("query").alias("query")), "cache_key", "query", "query")
    return hit.select("qid", "embedding").unionByName(fresh.join(made, "cache_key").select("qid", "embedding")), cache.unionByName(made)


def chunk_points(events: DataFrame) -> DataFrame:
    """Vector rows (id, machine_id, project, file_path, entity, chunk_no, start_line, end_line, snippet, text) of clean events with content."""
    e = events.filter(F.length("content") < MAX_EMBED_CHARS).withColumnRenamed("path", "file_path")
    rows = chunking.file_chunks(e, ["machine_id", "project", "file_path"])
    ident = point_id(F.col("machine_id"), F.coalesce("project", F.lit("")), F.col("file_path"), F.col("entity"), F.col("chunk_no"))
    return rows.select(ident.alias("id"), "machine_id", "project", "file_path", "entity", "chunk_no", "start_line", "end_line", "snippet", "text")


def event_relations(events: DataFrame) -> DataFrame:
    """The relations events bring along, as rows of the relations table; of equal ones the later event counts."""
    r = events.select("machine_id", "project", F.col("path").alias("file_path"), "sec", "event_id", F.explode("relations").alias("r"))
    return r.select(
        "machine_id", "project", "file_path", F.col("r.type").alias("relation_type"), *[F.col(f"r.{c}") for c in ("source", "target", "target_type", "line", "confidence", "layer", "status", "symbol_id")],
        F.timestamp_seconds("sec").alias("observed_at"), F.col("event_id").alias("relation_id"),
    )


def reindex_events(files: DataFrame, skip_machines: list[str] | None = None) -> DataFrame:
    """The content table as events that renew it: a MODIFY of each file with its true hash, without entities and relations."""
    rows = files.filter(~F.col("machine_id").isin(skip_machines)) if skip_machines else files
    none = F.lit(None)
    return rows.filter("content IS NOT NULL").select(
        F.xxhash64("machine_id", "file_path").alias("event_id"), F.lit("MODIFY").alias("event_type"), F.col("file_path").alias("path"), none.cast("string").alias("old_path"), "project", "machine_id",
        F.lit(0).cast("long").alias("sec"), F.sha2("content", 256).alias("content_hash"), "content", F.from_json(F.lit("[]"), "array<struct<name:string,type:string,line:int,start_line:int,end_line:int>>").alias("entities"),
        F.from_json(F.lit("[]"), f"array<{RELATION}>").alias("relations"),
    )


@dataclass
class Corpus:
    """All tables of a corpus. ``ingest`` gives the corpus after a batch of clean events; vectors and hashes are renewed together.

    Nodes of modules and symbols are those that edges lead to, so that one without edges is gone at once.
    """

    files: DataFrame
    tokens: DataFrame
    points: DataFrame
    entities: DataFrame
    edges: DataFrame
    pending: list[str] = field(default_factory=list)

    def ingest(self, events: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> Corpus:
        """Deletes first, then upserts. Files whose hash is known keep graph and vectors; a failing ``embed`` leaves vectors and hashes as they were.

        A changed file loses its entities and edges and gets those of its event; events with relations but without content add these to the graph as it stands.
        """
        # what the batch decides, and the edges, are written down: the tables of many batches on end stay short plans
        gone = staged(ingest.delete_fanout(events).select("machine_id", F.col("path").alias("file_path")).distinct(), "gone")
        live = events.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("content").isNotNull())
        last = graph.last_by(live, ["machine_id", "path"], ["sec", "event_id"])
        base = without_files(self.files, gone)
        same = staged(ingest.hash_short_circuit(last, base), "same")
        changed = last.join(same.filter("NOT unchanged").select("event_id"), "event_id", "left_semi")
        put = last.select("machine_id", "project", F.col("path").alias("file_path"), "content", "content_hash")
        touched = changed.select("machine_id", F.col("path").alias("file_path"))
        try:
            fresh = staged((embed or (lambda p: p))(chunk_points(changed)), "vectors")  # a lazy embedder fails here, not later
            points = overwrite(without_files(without_files(self.points, gone), touched), fresh.select(*self.points.columns), ["id"])
            pending = []
        except Exception as e:  # the embedder is someone else's code
            points, pending = without_files(self.points, gone), [str(e)]
            put = put.withColumn("content_hash", F.lit(None).cast("string"))
        files = ingest.upsert(base, put, ["machine_id", "file_path"], ["content_hash"])
        ents = changed.select("machine_id", "project", F.col("path").alias("file_path"), F.explode("entities").alias("e")).select("machine_id", "project", "file_path", "e.name", F.col("e.type").alias("entity_type"), "e.start_line", "e.end_line")
        entities = overwrite(without_files(without_files(self.entities, gone), touched), ents.select(*self.entities.columns).dropDuplicates(["machine_id", "file_path", "name"]), ["machine_id", "file_path", "name"])
        edges = graph.detach_files(self.edges, gone.unionByName(touched))
        if "relations" in events.columns:
            alone = events.filter(F.col("event_type").isin("CREATE", "MODIFY") & F.col("content").isNull())
            found = staged(graph.merged_edges(event_relations(changed).unionByName(event_relations(alone)), entities).select(*self.edges.columns), "new-edges")
            edges = overwrite(edges, found, graph.EDGE)
        edges = staged(edges, "edges")
        return Corpus(files, sync_tokens(without_files(self.tokens, gone), put), points, entities, edges, pending)

    def reindex(self, skip_machines: list[str] | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> Corpus:
        """The corpus with all vectors made anew from its contents, but for those of some machines; graph and entities stay."""
        points = self.points.filter(F.col("machine_id").isin(skip_machines)) if skip_machines else self.points.filter("false")
        fresh = staged((embed or (lambda p: p))(chunk_points(reindex_events(self.files, skip_machines))), "vectors")
        return Corpus(self.files, self.tokens, points.unionByName(fresh.select(*points.columns)), self.entities, self.edges)

    def nodes(self) -> DataFrame:
        return graph.graph_nodes(self.entities, self.edges)

    def stats(self) -> dict[str, object]:
        """Counts of all parts; a part that cannot be read makes the whole "degraded" and the others are still given."""
        out: dict[str, object] = {"status": "ok"}
        for name, part in (("files", self.files), ("tokens", self.tokens), ("points", self.points), ("entities", self.entities), ("edges", self.edges)):
            try:
                out[name] = part.count()
            except Exception as e:  # reported, not hidden
                out[name], out["status"] = f"error: {e}"[:200], "degraded"
        return out

    def trees(self) -> DataFrame:
        return tree.render_trees(tree.tree_paths(self.files))

    def health(self, least_ratio: float = 0.5) -> DataFrame:
        return health(self.points, self.entities, least_ratio)


def health(points: DataFrame, entities: DataFrame, least_ratio: float = 0.5) -> DataFrame:
    """One row: points, entities, their ratio and the issues found, as a text."""
    lag = stats.vector_lag(points, entities)
    issues = F.array_compact(
        F.array(F.when(F.col("n_entities") == 0, "no entities"), F.when(F.col("n_points") == 0, "no vectors"), F.when((F.col("n_entities") > 0) & (F.col("vector_lag_ratio") < least_ratio), "vectors lag behind"))
    )
    return lag.select("*", F.array_join(issues, "; ").alias("issues"))
