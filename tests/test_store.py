import hashlib

import pytest
from pyspark.sql import functions as F

from silverloom.operators import store
from silverloom.functions.embedding import Embedder, get_embedder
from silverloom.operators.jobs import RelationCache, auto_replay_tick, drop_deleted, settle, upsert_jobs

EVENTS = "delivery_id long, event_id long, event_type string, path string, old_path string, project string, machine_id string, sec long, content_hash string, content string, entities array<struct<name:string,type:string,line:int,start_line:int,end_line:int>>"
EDGE = "from_id string, relation string, to_id string, machine_id string, project string, file_path string, to_kind string, from_kind string"


def empty(spark):
    return store.Corpus(
        spark.createDataFrame([], "machine_id string, project string, file_path string, content string, content_hash string"),
        spark.createDataFrame([], "machine_id string, file_path string, field int, term string, n long"),
        spark.createDataFrame([], "id string, machine_id string, project string, file_path string, entity string, chunk_no int, start_line int, end_line int, snippet string, text string"),
        spark.createDataFrame([], "machine_id string, project string, file_path string, name string, entity_type string, start_line int, end_line int"),
        spark.createDataFrame([("m1:/x.go#f", "CALLS_SYNTAX", "m1:g", "m1", "p", "/x.go", "UnresolvedSymbol", "Entity"), ("m1:/b.go", "DEPENDS_ON", "m1:/x.go#f", "m1", "p", "/b.go", "Entity", "File")], EDGE),
    )


def batch(spark, *rows):
    full = [(i, i, kind, path, old, "p", "m1", i, h, content, ents) for i, (kind, path, h, content, ents, old) in enumerate(rows)]
    return spark.createDataFrame(full, EVENTS)


def ev(kind, path, h=None, content=None, ents=None, old=None):
    return (kind, path, h, content, ents, old)


def names(df, c="file_path"):
    return sorted(r[c] for r in df.collect())


def test_ingest(spark):
    c = empty(spark).ingest(batch(spark, ev("CREATE", "/src/main.go", "v1", "package main\nfunc main() {\n}\n", [("main", "function", 2, 2, 3)]), ev("CREATE", "/b.py", "h", "needle = 1\n"), ev("CREATE", "/x.go", "x", "package x", [])))
    assert names(c.files) == ["/b.py", "/src/main.go", "/x.go"] and names(c.entities, "name") == ["main"]
    assert {(r.file_path, r.entity) for r in c.points.collect()} == {("/src/main.go", "main"), ("/b.py", ""), ("/x.go", "")}
    assert c.edges.count() == 0  # /x.go was replaced: its own edges and those onto its entities are gone
    assert c.tokens.filter("term = 'needle'").count() == 1 and c.stats()["files"] == 3 and c.stats()["status"] == "ok"
    # the same hash: content is refreshed, vectors and graph stay; a delete in the same batch comes first whatever its place
    d = c.ingest(batch(spark, ev("MODIFY", "/src/main.go", "v1", "package main // same hash"), ev("MODIFY", "/b.py", "h2", "haystack = 1\n"), ev("DELETE", "/x.go")))
    assert names(d.files) == ["/b.py", "/src/main.go"] and names(d.entities, "name") == ["main"]
    assert d.files.filter("file_path = '/src/main.go'").first().content.endswith("same hash")
    assert d.tokens.filter("term = 'needle'").count() == 0 and d.tokens.filter("term = 'haystack'").count() == 1
    e = d.ingest(batch(spark, ev("RENAME", "/src/new.go", old="/src/main.go")))
    assert names(e.files) == ["/b.py"] and e.entities.count() == 0 and names(e.points) == ["/b.py"]
    assert e.trees().count() == 1 and "no entities" in e.health().first().issues


def test_failing_embedder_keeps_vectors_and_hashes(spark):
    def fail(points):
        raise RuntimeError("embedder down")

    c = empty(spark).ingest(batch(spark, ev("CREATE", "/a.py", "v1", "a = 1\n")))
    d = c.ingest(batch(spark, ev("MODIFY", "/a.py", "v2", "b = 2\n")), fail)
    row = d.files.first()
    assert d.pending == ["embedder down"] and row.content == "b = 2\n" and row.content_hash == "v1" and d.points.first().text.startswith("a")
    again = d.ingest(batch(spark, ev("MODIFY", "/a.py", "v2", "b = 2\n")))
    assert again.files.first().content_hash == "v2" and again.points.first().text.startswith("b")


def test_lazily_failing_embedder(spark):
    """An embedder that fails in its tasks, not when the plan is made, is caught as well."""

    def fail(points):
        return points.withColumn("text", F.when(F.col("text").isNotNull(), F.raise_error(F.lit("embedder down"))))

    c = empty(spark).ingest(batch(spark, ev("CREATE", "/a.py", "v1", "a = 1\n")))
    d = c.ingest(batch(spark, ev("MODIFY", "/a.py", "v2", "b = 2\n")), fail)
    assert len(d.pending) == 1 and "embedder down" in d.pending[0] and d.files.first().content_hash == "v1" and d.points.first().text.startswith("a")


def test_ingest_of_relations(spark):
    """A changed file gets the edges of its event; relations without content are added to what is there; nodes without edges are gone."""
    relation = "array<struct<type:string,source:string,target:string,target_type:string,line:int,confidence:string,layer:string,status:string,symbol_id:string>>"

    def with_relations(rows, relations):
        plain = batch(spark, *rows)
        found = spark.createDataFrame([(i, [(t, s, x, None, 1, None, None, None, sym) for t, s, x, sym in r]) for i, r in enumerate(relations)], f"event_id long, relations {relation}")
        return plain.join(found, "event_id")

    ents = [("f", "function", 1, 1, 1), ("g", "function", 2, 2, 2)]
    one = with_relations([ev("CREATE", "/a.go", "h1", "func f() {}\nfunc g() {}", ents)], [[("CALLS_SYNTAX", "f", "print", None), ("IMPORTS", None, "fmt", None), ("CALLS_SYNTAX", "nobody", "x", None)]])
    c = empty(spark).ingest(one)
    mine = lambda c: {(r.from_id, r.relation, r.to_id) for r in c.edges.filter("file_path = '/a.go'").collect()}
    assert mine(c) == {("m1:/a.go#f", "CALLS_SYNTAX", "m1:print"), ("m1:/a.go", "IMPORTS", "m1:fmt")}
    alone = with_relations([ev("MODIFY", "/a.go")], [[("CALLS_RESOLVED", "g", "h", "pkg.h"), ("REFERENCES", "g", "h", None)]])
    d = c.ingest(alone)
    assert mine(d) == mine(c) | {("m1:/a.go#g", "CALLS_RESOLVED", "m1:pkg.h")} and d.files.count() == 1
    again = with_relations([ev("MODIFY", "/a.go", "h2", "func f() {}", ents[:1])], [[("IMPORTS", None, "os", None)]])
    e = d.ingest(again)
    assert mine(e) == {("m1:/a.go", "IMPORTS", "m1:os")} and "fmt" not in names(e.nodes().filter("name IS NOT NULL"), "name")


def test_reindex(spark):
    c = empty(spark).ingest(batch(spark, ev("CREATE", "/a.py", "h1", "a = 1\n"), ev("CREATE", "/b.py", "h2", "b = 1\n")))
    c.points = c.points.filter("file_path = '/a.py'")
    assert names(c.reindex().points) == ["/a.py", "/b.py"] and names(c.reindex(["m1"]).points) == ["/a.py"]
    assert store.reindex_events(c.files).filter("path = '/a.py'").first().content_hash == hashlib.sha256(b"a = 1\n").hexdigest()


def test_replay_tick(spark):
    rows = [(i, "dead", "timeout" if i % 2 else "parse error", 0, 0) for i in range(1, 13)]
    jobs = spark.createDataFrame(rows, "job_id long, state string, last_error string, replay_count int, dead_at long")
    assert auto_replay_tick(jobs, 100, 10, 3, 0, 3) == ([1, 3, 5], 6)
    assert auto_replay_tick(jobs, 100, 10, 3, 6, 3) == ([7, 9, 11], 12)
    assert auto_replay_tick(jobs, 100, 10, 3, 9, 3) == ([11, 1, 3], 3)  # it goes on from the beginning
    assert auto_replay_tick(jobs.filter("job_id % 2 = 0"), 100, 10, 3, 0, 2, 2) == ([], 8)
    assert auto_replay_tick(jobs.filter("false"), 100, 10, 3, 5, 3) == ([], 0)


def test_relation_cache():
    c = RelationCache(2)
    for k in "ab":
        c.put("r", k, "h", [k])
    c.put("r", "a", "h", ["new"])  # keeps its place
    c.put("r", "c", "h", ["c"])
    got = c.get("r", "b", "h")
    got.append("mine")
    assert c.get("r", "a", "h") is None and c.get("r", "b", "h") == ["b"] and c.get("r", "b", "other") is None
    none = RelationCache(0)
    none.put("r", "a", "h", [])
    assert none.get("r", "a", "h") is None


def test_embedder_batches_and_prefixes(spark):
    def sizes(texts):
        assert len(texts) <= 32 and all(t.startswith("q: ") for t in texts)
        return [[float(len(texts))] for _ in texts]

    rows = spark.range(70).selectExpr("id", "if(id = 5, NULL, 'x') AS t").coalesce(1)
    got = [r.embedding[0] for r in Embedder("t", sizes, query_prefix="q: ").embedded(rows, "id", "t", "query").collect()]
    assert sorted(got) == [5.0] * 5 + [32.0] * 64
    assert get_embedder().name == get_embedder("AUTO").name == get_embedder("Hash").name == "hash"
    with pytest.raises(ValueError):
        get_embedder().embedded(rows, "id", "t", "other")


def test_scope_and_deletes(spark):
    f = spark.createDataFrame([("m1", "alpha", "/1"), ("m1", "beta", "/2"), ("m2", "alpha", "/3"), (None, None, "/4")], "machine_id string, project string, file_path string")
    assert [store.scoped(f, *a).count() for a in ((), ("m1",), ("m1", "beta"), ("", "alpha"), ("zz",))] == [4, 2, 1, 2, 0]
    assert names(store.without_machine(f, "m1")) == ["/3", "/4"] and names(store.without_files(f, f.filter("file_path = '/1'"))) == ["/2", "/3", "/4"]
    assert [r.file_path for r in store.ordered_scan(f.filter("machine_id IS NOT NULL"), ["m2"]).collect()] == ["/1", "/2"]


def test_query_cache(spark):
    key = store.cache_key(F.lit("b"), F.lit("m"), F.col("query"))
    q = spark.createDataFrame([(1, " Find X "), (2, "Find X"), (3, "find x")], "qid int, query string").withColumn("cache_key", key)
    got, cache = store.cached_embeddings(spark.createDataFrame([], "cache_key string, embedding array<float>"), q)
    assert got.count() == 3 and cache.count() == 1  # blanks around and case do not matter
    got2, cache2 = store.cached_embeddings(cache, q)
    assert sorted(map(tuple, got2.select("qid").collect())) == [(1,), (2,), (3,)] and cache2.count() == 1


def test_jobs(spark):
    old = spark.createDataFrame([("m", "p", "/a", "h1", "dead", 4, 9), ("m", "p", "/b", "h1", "running", 2, 9), ("m", "p", "/c", "h1", "done", 1, 9)], "machine_id string, project string, path string, content_hash string, state string, attempt_count int, next_attempt_at long")
    new = spark.createDataFrame([("m", "p", "/a", "h2"), ("m", "p", "/b", "h1"), ("m", "p", "/d", "h1")], "machine_id string, project string, path string, content_hash string")
    got = {r.path: (r.content_hash, r.state, r.attempt_count, r.next_attempt_at) for r in upsert_jobs(old, new, 100).collect()}
    assert got == {"/a": ("h2", "pending", 0, 100), "/b": ("h1", "running", 2, 9), "/c": ("h1", "done", 1, 9), "/d": ("h1", "pending", 0, 100)}
    assert names(drop_deleted(old, new.filter("path <> '/d'")), "path") == ["/c"]
    jobs = spark.createDataFrame([(1, "running", 3), (2, "running", 3), (3, "pending", 3)], "job_id long, state string, lease_version int")
    reports = spark.createDataFrame([(1, 3, "done"), (2, 2, "release"), (3, 3, "done"), (4, 1, "done")], "job_id long, lease_version int, outcome string")
    assert {r.job_id: r.outcome for r in settle(jobs, reports).collect()} == {1: "done", 2: "stale", 3: "stale", 4: "stale"}


def test_stats_of_a_broken_part(spark):
    c = empty(spark)
    c.points = spark.range(3).select(F.raise_error(F.lit("gone")).alias("x")).filter("x IS NOT NULL")
    got = c.stats()
    assert got["status"] == "degraded" and str(got["points"]).startswith("error") and got["edges"] == 2
    with pytest.raises(Exception):
        c.points.count()
