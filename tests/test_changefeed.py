import random

import pytest
from pyspark.sql import functions as F

from silverloom.operators.changefeed import FileTable, bucket_of, whole_seconds

SCHEMA = "delivery_id long, event_id long, event_type string, path string, old_path string, project string, machine_id string, timestamp_seconds long, content_hash string, content string, sec string, live string, r int"


def feed(spark, path, rows):
    full = [(i, *r, "x", "y", 1) for i, r in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ev(event, kind, path, t, content="c", old=None, machine="m"):
    return (event, kind, path, old, "p", machine, t, None if content is None else f"h{event}", content)


def state(table):
    return {(r.machine_id, r.path): r.event_id for r in table.current().collect()}


def fold(rows):
    """The plain way: all distinct events in order."""
    seen, out = set(), {}
    unit = lambda t: -1 if t is None else t // 1000 if t >= 10**11 else t
    for e in sorted(rows, key=lambda e: (unit(e[6]), e[0])):
        event, kind, path, old, _, machine, _, _, content = e
        if event in seen:
            continue
        seen.add(event)
        kind = (kind or "").strip().upper()
        if kind in ("CREATE", "MODIFY") and content is not None and path is not None:
            out[machine, path] = event
        elif kind in ("DELETE", "RENAME"):
            out.pop((machine, path), None)
            if kind == "RENAME":
                out.pop((machine, old), None)
    return out


def test_cases(spark, tmp_path):
    rows = [
        ev(1, "CREATE", "/a", 100), ev(2, " modify", "/a", 100), ev(3, "MODIFY", "/a", 200, None), ev(4, "CREATE", "/b", 100_000_000_000), ev(5, "Delete", "/b", 99_999_999, None),
        ev(6, "CREATE", "/c", 10), ev(7, "RENAME", "/d", 20, None, "/c"), ev(8, "MODIFY", "/c", 30), ev(9, "CREATE", "/e", 10), ev(10, "RENAME", "/e", 11, None), ev(11, "CREATE", None, 5),
        ev(12, "CREATE", "/caf\u00e9", 1), ev(13, "DELETE", "/cafe\u0301", 2, None), ev(14, "TOUCH", "/t", 2), ev(15, None, "/t", 2), ev(16, "CREATE", "/n", None), ev(17, "CREATE", "/m", 1, machine=None),
        ev(2, "MODIFY", "/a", 100), ev(18, "CREATE", "/empty", 3, ""),
    ]
    t = FileTable(spark, str(tmp_path / "t"), 4)
    assert t.apply(feed(spark, str(tmp_path / "f"), rows)) == 1
    assert state(t) == {("m", "/a"): 2, ("m", "/b"): 4, ("m", "/c"): 8, ("m", "/n"): 16, (None, "/m"): 17, ("m", "/empty"): 18}


def test_empty_feed_and_empty_table(spark, tmp_path):
    t = FileTable(spark, str(tmp_path / "t"))
    assert t.current().count() == 0
    assert t.apply(feed(spark, str(tmp_path / "f"), [])) == 0
    assert t.manifest()["files"] == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_fold(spark, tmp_path, seed):
    """Shuffled, repeated and late changes in three batches give what one ordered pass gives; untouched buckets keep their files."""
    rng = random.Random(seed)
    kinds = ["CREATE", "MODIFY", "MODIFY", "DELETE", "RENAME"]
    rows = []
    for i in range(400):
        kind = rng.choice(kinds)
        content = None if kind in ("DELETE", "RENAME") or rng.random() < 0.1 else f"text {i}"
        rows.append(ev(i, kind, f"/{rng.randint(0, 40)}", rng.choice([1, 1000]) * rng.randint(10**8, 10**8 + 50), content, f"/{rng.randint(0, 40)}" if kind == "RENAME" else None))
    rows += rng.sample(rows, 60)
    rng.shuffle(rows)
    t = FileTable(spark, str(tmp_path / "t"), 8)
    for k in range(3):
        before = t.manifest()
        t.apply(feed(spark, str(tmp_path / f"f{k}"), rows[k::3]))
        assert t.manifest()["version"] == k + 1
        assert state(FileTable(spark, str(tmp_path / "t"))) == state(t)
        if k:
            assert t.current(before["version"]).count() >= 0  # old versions stay readable
    assert state(t) == fold(rows)
    one = feed(spark, str(tmp_path / "one"), [ev(1000, "CREATE", "/new", 10**9)])
    old = t.manifest()
    t.apply(one)
    new = t.manifest()
    assert sum(old["files"].get(b) != f for b, f in new["files"].items()) == 1
    assert t.current().filter("path = '/new'").first().content == "c"


def test_units(spark):
    got = spark.createDataFrame([(1,), (1_700_000_000,), (1_700_000_000_999,), (1_700_000_000_999_999,), (1_700_000_000_999_999_999,), (None,)], "t long").select(whole_seconds(F.col("t")))
    assert [r[0] for r in got.collect()] == [1, 1_700_000_000, 1_700_000_000, 1_700_000_000, 1_700_000_000, None]


def test_buckets_split_as_the_table_grows(spark, tmp_path, monkeypatch):
    """Linear hashing: the number of buckets follows the size, each key is found in the bucket of its hash, and nothing is lost."""
    import numpy as np

    from silverloom.operators import changefeed

    monkeypatch.setattr(changefeed, "BUCKET_BYTES", 2000)
    rng, rows = random.Random(5), []
    t = FileTable(spark, str(tmp_path / "t"), 2)
    for k in range(4):
        batch = [ev(1000 * k + i, "CREATE" if i % 7 else "DELETE", f"/{rng.randint(0, 150)}", 10**9 + rng.randint(0, 99), f"text {i}" * 5 if i % 7 else None) for i in range(200)]
        rows += batch
        t.apply(feed(spark, str(tmp_path / f"f{k}"), batch))
        assert state(t) == fold(rows)
    m = t.manifest()
    assert m["buckets"] > 4
    for b, files in m["files"].items():
        h = np.array([r.h for r in spark.read.parquet(*files).select("h").collect()])
        assert (bucket_of(h, m["buckets"]) == int(b)).all()
    assert t.vacuum(1) > 0 and state(FileTable(spark, str(tmp_path / "t"))) == fold(rows)


def test_only_one_writer_commits_a_version(spark, tmp_path):
    t = FileTable(spark, str(tmp_path / "t"), 2)
    t.apply(feed(spark, str(tmp_path / "f"), [ev(1, "CREATE", "/a", 5)]))
    with pytest.raises(RuntimeError):
        t._commit({**t.manifest(), "version": 1})
    (tmp_path / "t" / "manifests" / "v00000002.json").write_text('{"version": 2, "buc')  # of a writer that died
    assert state(t) == {("m", "/a"): 1}
    assert t.apply(feed(spark, str(tmp_path / "g"), [ev(2, "CREATE", "/b", 5)])) == 3 and len(state(t)) == 2


def test_part_of_a_feed(spark, tmp_path):
    t = FileTable(spark, str(tmp_path / "t"), 4)
    scan = feed(spark, str(tmp_path / "f"), [ev(1, "CREATE", "/a", 5), ev(2, "DELETE", "/a", 6, None), ev(3, "CREATE", "/b", 1)])
    t.apply(scan, F.col("event_id") == 2)
    assert state(t) == {}
    t.apply(scan, F.col("event_id") != 2)  # the older creation comes late
    assert state(t) == {("m", "/b"): 3}
