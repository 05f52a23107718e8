import json

from pyspark.sql import functions as F

from silverloom.operators.changefeed import FileTable
from silverloom.session import build_session, shared_folder
from silverloom.sources import files as S
from silverloom.streaming import events as E


def test_folder_scan(spark, tmp_path):
    for name, data in (("a.py", b"x = 1\n"), ("node_modules/b.js", b"x"), ("c/d.log", b"x"), ("big.go", b"x" * 600_000), ("bin.dat", b"\xff\xfe\x00")):
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in S.scan_folder(spark, str(tmp_path / "src"), "p", "m", 7).collect()}
    assert set(got) == {"a.py", "bin.dat"} and got["a.py"].content == "x = 1\n" and got["bin.dat"].content is None and got["a.py"].timestamp == 7


def test_outbox(spark):
    good = json.dumps([{"type": "CREATE", "path": "/a", "timestamp": 5, "entities": [{"name": "f", "line": 3}]}, {"type": "DELETE", "path": "/b"}])
    q = spark.createDataFrame([(1, 10, good), (2, 5, "broken"), (3, 5, None), (4, 7, "[]")], "delivery_id long, id long, payload string")
    rows = S.outbox_events(q).orderBy("delivery_id", "position").collect()
    assert [(r.delivery_id, r.position, r.path) for r in rows] == [(1, 0, "/a"), (1, 1, "/b")] and rows[0].entities[0].name == "f"
    assert [r.id for r in S.dequeue(q, 1).collect()] == [7]


def test_ranked_lists(spark, tmp_path):
    lists = {"q1": [{"id": "1", "score": 0.5, "file_path": "/a", "entity": "f"}, {"id": "2", "score": 0.4, "file_path": "/b", "entity": None}]}
    for i, doc in enumerate((lists, {"results": lists, "model": "x"})):
        p = tmp_path / f"{i}.json"
        p.write_text(json.dumps(doc, indent=1))
        rows = S.read_ranked(spark, str(p)).orderBy("rank").collect()
        assert [(r.qid, r.rank, r.file_path, r.score) for r in rows] == [("q1", 1, "/a", 0.5), ("q1", 2, "/b", 0.4)]
    S.write_ranked(S.read_ranked(spark, str(tmp_path / "0.json")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().hits[1].file_path == "/b"
    assert json.loads(S.report_json(spark.range(2)))[1] == {"id": 1}


def test_stream_equals_batch(spark, tmp_path):
    """Micro-batches of one file each, in any order, give the same table as one batch."""
    source = spark.read.parquet("/root/testdata/sf0.001/file_events.parquet")
    folder = str(tmp_path / "in")
    source.repartition(3).write.parquet(folder)
    a, b = FileTable(spark, str(tmp_path / "a"), 4), FileTable(spark, str(tmp_path / "b"), 4)
    E.fold_into_table(E.event_stream(spark, folder, 1), a)
    b.apply(spark.read.parquet(folder))
    assert a.manifest()["version"] == 3
    rows = lambda t: sorted((r.machine_id, r.path, r.event_id, r.content) for r in t.current().collect())
    assert rows(a) == rows(b) and rows(a)


def test_unchanged_state_over_batches(spark, tmp_path):
    schema = "event_id long, machine_id string, path string, sec long, content_hash string"
    for k, rows in enumerate([[(1, "m", "/a", 1, "x"), (2, "m", "/a", 2, "x"), (3, "m", "/b", 1, "x")], [(4, "m", "/a", 3, "x"), (5, "m", "/a", 4, "y"), (6, "m", "/a", 5, "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen: list[int] = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    E.run_all(E.skip_unchanged(stream), lambda batch, _: seen.extend(r.event_id for r in batch.collect()), "t")
    assert sorted(seen) == [2, 4]


def test_debounce(spark, tmp_path):
    rows = [("m", "/a", f"2025-01-01 00:00:0{s}") for s in (0, 1, 2)] + [("m", "/b", "2025-01-01 00:00:09"), ("n", "/a", "2025-01-01 00:00:01"), ("m", "/z", "2025-01-02 00:00:00")]
    spark.createDataFrame(rows, "machine_id string, path string, t string").select("machine_id", "path", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got: list = []
    stream = spark.readStream.schema("machine_id string, path string, at timestamp").parquet(str(tmp_path / "in"))
    E.run_all(E.debounced(stream), lambda batch, _: got.extend((r.machine_id, r.n_events) for r in batch.collect()), "d")
    assert sorted(got) == [("m", 1), ("m", 3), ("n", 1)]


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and build_session() is spark


def test_staged_tables_are_removed(spark):
    from pathlib import Path

    from silverloom import session

    kept, session._FOLDERS[:] = list(session._FOLDERS), []
    df = session.staged(spark.range(3), "x")
    path = Path(session._FOLDERS[0].removeprefix("file:").replace("//", "/"))
    assert df.count() == 3 and path.exists()
    session.clear_staged(spark)
    assert not path.exists() and not session._FOLDERS
    session._FOLDERS[:] = kept


def test_ticker_and_bounded_deduplication(spark, tmp_path):
    """A stream that runs at ticks takes files that come later, and repeats within the time are dropped over batches."""
    put = lambda k, rows: spark.createDataFrame(rows, "id long, t string").select("id", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0, [(1, "2025-01-01 00:00:00"), (1, "2025-01-01 00:00:01")])
    seen: list[int] = []
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(tmp_path / "in"))
    query = E.run_every(E.deduplicated(stream, ["id"], "at", "1 hour"), lambda batch, _: seen.extend(r.id for r in batch.collect()), "tick", "200 milliseconds")
    try:
        query.processAllAvailable()
        put(1, [(1, "2025-01-01 00:10:00"), (2, "2025-01-01 00:10:00")])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen) == [1, 2]
