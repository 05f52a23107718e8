import datetime as dt

import pytest
from pyspark.sql import functions as F

from silverloom.operators import chunking, evaluation, fusion, graph, ingest, jobs, lexical, stats, tree, vector


def starts(spark, n, window=2400, stride=600):
    df = spark.createDataFrame([("x" * n,)], "content string").withColumn("k", F.lit(1))
    return [r.start for r in chunking.windows(df, ["k"], window, stride).orderBy("chunk_no").collect()]


def test_windows(spark):
    assert starts(spark, 5000) == [0, 600, 1200, 1800, 2400, 3000] and starts(spark, 0) == [] and starts(spark, 5) == [0]
    df = spark.createDataFrame([(1, "a\n" * 2500), (2, ""), (3, None), (4, "hello")], "k int, content string")
    rows = chunking.windows(df, ["k"]).collect()
    assert max(r.end for r in rows if r.k == 1) == 5000 and {r.k for r in rows} == {1, 4}
    first = next(r for r in rows if r.k == 1 and r.chunk_no == 1)
    assert (first.start_line, first.end_line) == (301, 1501)


def test_chunks(spark):
    schema = "k int, content string, entities array<struct<name:string,type:string,line:int,start_line:int,end_line:int>>"
    text = "l1\nl2\n alpha \nx\ny\nl6\nbeta\nz\nend"
    df = spark.createDataFrame([(1, text, [("alpha", "f", 3, 3, 5), ("beta", "f", 7, 7, 99), ("alpha", "f", 3, 3, 5), ("none", "f", 1, None, 2)]), (2, "q" * 200_000, None), (3, "z" * 50_000, [("big", "f", 1, 1, 1)]), (4, "", []), (5, None, None)], schema)
    rows = chunking.file_chunks(df, ["k"]).collect()
    assert sorted((r.entity, r.text) for r in rows if r.k == 1) == [("alpha", "alpha \nx\ny"), ("beta", "beta\nz\nend")]
    assert sum(r.k == 2 for r in rows) == 64 and [len(r.text) for r in rows if r.k == 3] == [32_000] and not any(r.k > 3 for r in rows)


def hits(spark, rows):
    return spark.createDataFrame([(1, "m", "p", *r) for r in rows], "qid int, machine_id string, project string, file_path string, rank int, snippet string, entity string")


def test_fusion(spark):
    sem, lex = hits(spark, [("/a", 1, "", "User"), ("/a", 2, "s2", "HashPassword"), ("/a", 3, "s3", "User"), ("/b", 4, "s4", "")]), hits(spark, [("/a", 1, "l1", None), ("/c", 2, "l2", None)])
    got = {r.file_path: r for r in fusion.fuse(sem, lex).collect()}
    assert got["/a"].score == pytest.approx(1 / 21 + 1 / 22 + 1 / 23 + 0.7 / 21) and got["/a"].snippet == "l1" and got["/a"].matched_entities == ["HashPassword", "User"]
    assert got["/b"].matched_entities == [] and got["/c"].score == pytest.approx(0.7 / 22)
    q = spark.createDataFrame([(1, "hash password")], "qid int, query string")
    top = fusion.boosted(fusion.fuse(sem, lex), q).collect()
    assert [r.file_path for r in top] == ["/a", "/b", "/c"] and top[0].score == pytest.approx(got["/a"].score + 0.5 / 21)
    assert fusion.fuse(sem.filter("false"), lex.filter("false")).count() == 0


def test_lexical(spark):
    files = spark.createDataFrame([(1, "/x/a.go", "alpha beta"), (2, "/y/b.go", "beta beta beta"), (3, "/z/c.py", None), (4, "/z/a/b.go", "")], "id int, file_path string, content string")
    q = spark.createDataFrame([(1, "beta"), (2, "a/b.go"), (3, "--"), (4, ""), (5, "beta beta")], "qid int, query string")
    s = {(r.qid, r.id): r.score for r in lexical.bm25(lexical.index_files(files, ["id"]), lexical.query_phrases(q), ["id"]).collect()}
    assert {k for k in s if k[0] == 2} == {(2, 4)} and not any(k[0] in (3, 4) for k in s)
    assert s[5, 2] == pytest.approx(2 * s[1, 2]) and s[1, 2] > s[1, 1]


def test_vectors(spark):
    pts = spark.createDataFrame([(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0]), (98, None)], "vec_id long, embedding array<float>")
    qs = pts.filter("vec_id in (1, 2, 98)").withColumnRenamed("vec_id", "qid")
    exact = vector.exact_top_k(pts, qs, 3)
    rows = sorted((r.qid, r.rank, r.vec_id) for r in exact.collect())
    assert rows[0] == (1, 1, 1) and {r[0] for r in rows} == {1, 2} and [r[2] for r in rows if r[0] == 1] == [1, 16, 31]
    index = vector.index_top_k(pts.filter("vec_id < 90"), qs, 3, cells=4, probes=4)
    assert sorted((r.qid, r.rank, r.vec_id) for r in index.collect()) == rows
    assert vector.exact_top_k(pts.filter("false"), qs, 3).count() == 0 and vector.exact_top_k(pts, qs.filter("false"), 3).count() == 0


def test_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.vec_id) for r in vector.exact_top_k(e, q, 10).collect()}
    found = {(r.qid, r.vec_id) for r in vector.index_top_k(e, q, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_graph_caps_and_groups(spark):
    n = spark.createDataFrame([(f"n{i:02}", i % 2) for i in range(10)], "id string, phase int")
    e = spark.createDataFrame([(f"n{2 * i:02}", r, f"n{2 * i + 2:02}", 1) for i, r in enumerate(["IMPORTS_RESOLVED", "CALLS_RESOLVED", "CALLS", "ODD"])], "from_id string, relation string, to_id string, phase int")
    nodes, edges = graph.capped(n, e, 3, 100)
    assert [r.id for r in nodes.collect()] == ["n00", "n02", "n04"] and edges.count() == 2
    assert graph.capped(n, e, 50, 3)[1].count() == 3
    groups = {(r.relation, r.edge_group) for r in graph.edge_groups(e).collect()}
    assert groups == {("IMPORTS_RESOLVED", "imports"), ("IMPORTS_RESOLVED", "imports_resolved"), ("CALLS_RESOLVED", "calls"), ("CALLS_RESOLVED", "calls_resolved"), ("CALLS", "calls"), ("ODD", "other")}


def test_upsert(spark):
    old = spark.createDataFrame([("m", "/a", 1, "h1"), ("m", "/b", 2, "h2"), (None, "/c", 3, None)], "machine_id string, file_path string, v int, content_hash string")
    new = spark.createDataFrame([("m", "/a", 9, None), (None, "/c", 8, "h8"), ("n", "/a", 7, None)], old.schema)
    got = {(r[0], r[1]): (r[2], r[3]) for r in ingest.upsert(old, new, ["machine_id", "file_path"], ["content_hash"]).collect()}
    assert got == {("m", "/a"): (9, "h1"), ("m", "/b"): (2, "h2"), (None, "/c"): (8, "h8"), ("n", "/a"): (7, None)}


def test_longest_prefix_and_ignore(spark):
    paths = spark.createDataFrame([("/w/a/x.go",), ("/w/a/b/y.go",), ("/z/q.go",), ("q.go",), (None,)], "path string")
    roots = spark.createDataFrame([("/w/a", "A"), ("/w/a/b", "B"), ("/w/a/bb", "C")], "root string, project string")
    assert {r.path: r.project for r in ingest.longest_prefix(paths, roots).collect()} == {"/w/a/x.go": "A", "/w/a/b/y.go": "B", "/z/q.go": "z", "q.go": ""}
    ig = spark.createDataFrame([("a/node_modules/b.js",), ("a/b.log",), ("src/builder.go",), ("build",), ("",)], "p string").select(ingest.ignored(F.col("p")))
    assert [r[0] for r in ig.collect()] == [True, True, False, True, False]


def test_batches(spark):
    e = spark.createDataFrame([("p" if i % 3 else None, i, 50_000 * i) for i in range(30)], "project string, event_id long, sec long")
    got = {r.event_id: (r.project, r.batch_no) for r in ingest.batches(e, 4).collect()}
    mine = sorted(i for i in range(30) if i % 3)
    assert [got[i][1] for i in mine] == [k // 4 for k in range(len(mine))] and got[0] == (None, 0) and len(got) == 30


def test_percentiles(spark):
    t0 = dt.datetime(2025, 1, 1)
    s = spark.createDataFrame([("r", float(v), t0 + dt.timedelta(seconds=v), v) for v in range(1, 101)] + [("x", 5.0, t0, 1)], "route string, ms double, at timestamp_ntz, id long")
    got = {r.route: tuple(r)[1:] for r in stats.latency_percentiles(s, known=["r"]).collect()}
    assert got == {"r": (100, 50.0, 95.0, 99.0), "_other_": (1, 5.0, 5.0, 5.0)}
    small = stats.latency_percentiles(s.filter("id <= 20 AND route = 'r'"), last=10).first()
    assert tuple(small)[1:] == (10, 15.0, 20.0, 20.0)


def test_errors_and_backoff(spark):
    cases = {"": True, None: True, "dial tcp: i/o timeout": True, "Connection Refused": True, "unexpected EOF": True, "hub returned 500": True, "hub returned 408": True, "hub returned 429": True, "hub returned 404": False, "syntax error: unexpected }": False, "hub returned 413": False}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r[0]: r[1] for r in df.select("m", jobs.is_transient(F.col("m"))).collect()} == cases
    b = spark.createDataFrame([(a,) for a in (0, 1, 2, 3, 20, 200)], "a int").select(jobs.backoff_ms(F.col("a"), 5000))
    assert [r[0] for r in b.collect()] == [5000, 5000, 10000, 20000, 3_600_000, 3_600_000]


def ranked(spark, lists):
    return spark.createDataFrame([(q, i + 1, f, "e", s) for q, hits in lists.items() for i, (f, s) in enumerate(hits)], "qid string, rank int, file_path string, entity string, score double")


def test_gates(spark):
    base = {"q1": [(f"f{i}", 1 - i / 10) for i in range(10)]}
    same = ranked(spark, base)
    assert tuple(evaluation.gate(same, same).first()) == (1.0, 0, 0)
    lost = lambda n: ranked(spark, {"q1": [(f"f{i}", 1 - i / 10) for i in range(10 - n)] + [(f"g{i}", 0.01) for i in range(n)]})
    assert evaluation.gate(same, lost(2)).first().verdict == 0 and evaluation.gate(same, lost(3)).first().verdict == 1
    worse = ranked(spark, {"q1": [("f0", 0.5), ("f1", 0.4)]})
    assert evaluation.gate_a(same, worse).first().ok is False
    assert evaluation.gate(same, ranked(spark, {"q2": [("a", 1.0)]})).first().verdict == 2
    assert evaluation.jaccard(same, lost(5)).first().jaccard == pytest.approx(5 / 15, abs=1e-6)


def test_tree(spark):
    files = spark.createDataFrame([("m", "demo", "/w/demo/src/main.go"), ("m", "demo", "/w/demo/lib/util.go"), ("m", "demo", "/w/demo/a.md"), ("m", "demo", "/else/b.md"), ("m", None, "/x")], "machine_id string, project string, file_path string")
    assert tree.render_trees(tree.tree_paths(files)).first().tree == "demo/\n├── a.md\n├── b.md\n├── lib/\n│   └── util.go\n└── src/\n    └── main.go"
    many = spark.range(1000).select(F.lit("m").alias("machine_id"), F.lit("p").alias("project"), F.format_string("/p/f%04d", "id").alias("file_path"))
    lines = tree.render_trees(tree.tree_paths(many)).first().tree.split("\n")
    assert len(lines) == 302 and lines[-1] == "[truncated]"


def test_deep_tree_behind_many_names(spark):
    """The first lines are exact although thousands of nodes lie nearer to the root."""
    deep = [("m", "p", "/p/a/" + "/".join("d" * (k + 1) for k in range(20)) + "/f.go")]
    wide = [("m", "p", f"/p/z{i:05}/x") for i in range(3000)]
    files = spark.createDataFrame(deep + wide, "machine_id string, project string, file_path string")
    lines = tree.render_trees(tree.tree_paths(files)).first().tree.split("\n")
    assert lines[1] == "├── a/" and lines[2] == "│   └── d/" and lines[22].endswith("└── f.go") and lines[23] == "├── z00000/" and lines[24] == "│   └── x" and len(lines) == 302


@pytest.mark.parametrize("lines,path,want", [
    (["*.log.txt"], "a/b.log.txt", True), (["/docs/"], "docs/a.md", True), (["/docs/"], "x/docs/a.md", False), (["docs/"], "x/docs/a.md", True), (["docs/"], "docs", False), (["a/b"], "a/b/c", True), (["a/b"], "x/a/b", False),
    (["**/gen/**"], "x/gen/a.go", True), (["**/gen/**"], "gen/a.go", True), (["*.js", "!keep.js"], "x/keep.js", False), (["!keep.js", "*.js"], "keep.js", True), (["x?.py"], "x1.py", True), (["x?.py"], "x12.py", False),
    (["# a", "", "  "], "# a", False), (["\\#a"], "#a", True), (["a[0-3].c"], "a2.c", True), (["a[!0-3].c"], "a2.c", False), (["a/**/b"], "a/b", True), (["a/**/b"], "a/x/y/b", True), (["node_modules"], "q/node_modules/x", True),
])
def test_ignore_lines(spark, lines, path, want):
    assert spark.range(1).select(ingest.ignored_by(F.lit(path), lines)).first()[0] is want


def test_ignore_globs(spark):
    df = spark.createDataFrame([("a/x.bak",), ("a.bak/x",), ("b",)], "p string")
    assert [r[0] for r in df.select(ingest.ignored_by(F.col("p"), globs=["*.bak"])).collect()] == [True, False, False]


def test_walked_tree(tmp_path):
    root = tmp_path / "proj"
    for d in ("a/b", "node_modules/x", "z"):
        (root / d).mkdir(parents=True)
    for p in ("a/b/c.txt", "a/d.txt", "k.txt", "node_modules/x/y.js"):
        (root / p).write_text("")
    assert tree.walked_tree(str(root)) == "proj/\n├── a/\n│   ├── b/\n│   │   └── c.txt\n│   └── d.txt\n├── k.txt\n└── z/"
    assert tree.walked_tree(str(root), max_depth=2).endswith("└── ...\n[truncated]")
    for i in range(300):
        (root / "z" / f"f{i:03}").write_text("")
    lines = tree.walked_tree(str(root)).split("\n")
    assert len(lines) == 202 and lines[-1] == "[truncated]"


def test_search_results_have_all_fields(spark):
    from silverloom.operators.fusion import results
    from silverloom.sources.schema import SEARCH_RESULT

    top = spark.createDataFrame([(1, 1, "/a", None, None, None, 0.5, None)], "qid int, rank int, file_path string, machine_id string, project string, snippet string, score double, matched_entities array<string>")
    got = results(top)
    assert [f"{n} {t}" for n, t in got.dtypes[2:]] == SEARCH_RESULT.split(", ") and got.first().asDict() == {"qid": 1, "rank": 1, "file_path": "/a", "machine_id": "", "project": "", "snippet": "", "score": 0.5, "matched_entities": []}
