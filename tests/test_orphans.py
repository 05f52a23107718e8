import datetime as dt
import random

from pyspark.sql import functions as F

from silverloom.operators.orphans import OrphanLedger, _carries, half_year, parent_log, reference_log, run_ledger

REL = "relation_id long, target_type string, target_ref string, observed_at timestamp_ntz, status string, tbl string, key string"
FILES = "machine_id string, file_path string, content string"
ENT = "node_id string, first_seen_at timestamp_ntz, removed_at timestamp_ntz, kd string"
SYM = "symbol_ref string, added_at timestamp_ntz, retired_at timestamp_ntz"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def tables(spark, files, entities, symbols):
    return (
        spark.createDataFrame([(m, p, None) for m, p in files], FILES),
        spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in entities], ENT),
        spark.createDataFrame([(k, day(a), day(b)) for k, a, b in symbols], SYM),
    )


def relations(spark, rows):
    return spark.createDataFrame([(i, t, k, day(d), None, "x", "y") for i, t, k, d in rows], REL)


def orphans(spark, rel, parents):
    log = reference_log(relations(spark, rel)).unionByName(parent_log(*tables(spark, *parents)))
    return {r.ref for r in run_ledger(log, half_year(F.col("at")))[1].filter("orphan").collect()}


def test_lifetimes_blanks_and_normal_forms(spark):
    parents = ([("m", "/caf\u00e9")], [("m:/a#f", 10, 20), ("m:/a#f", 30, None), ("m:/a#g", 5, 5), ("m:/a#h", None, None)], [("s", 1, None)])
    rel = [
        (1, "file", " m:/cafe\u0301 ", 0), (2, "file", "m:/none", 0), (3, "function", "m:/a#f", 9), (4, "class", "m:/a#f", 10), (5, "type", "m:/a#f", 20), (6, "interface", "m:/a#f", 31),
        (7, "function", "m:/a#g", 5), (8, "function", "m:/a#h", 50), (9, "symbol", "S", 5), (10, "symbol", "s\t", 5), (11, "symbol", "", 5), (12, "symbol", None, 5), (13, "module", "x", 5),
        (14, None, "x", 5), (15, "file", "m:/caf\u00e9", None), (16, "symbol", "s", None), (17, "function", "m:/a#f", 9),
    ]
    assert orphans(spark, rel, parents) == {2, 3, 5, 7, 8, 9, 16, 17}


def test_empty_tables(spark):
    assert orphans(spark, [], ([], [], [])) == set()
    assert orphans(spark, [(1, "file", "a", 1)], ([], [], [])) == {1}


def test_hot_key_against_brute_force(spark):
    """One key with two thirds of all references and many lifetimes, in several batches and partitions."""
    rng = random.Random(3)
    ents = [("hot", d, d + rng.randint(1, 2)) for d in range(0, 700, 3)] + [(f"k{i}", rng.randint(0, 700), rng.choice([None, 750])) for i in range(50)]
    rel = [(i, "function", "hot" if i % 3 else f"k{rng.randint(0, 60)}", rng.randint(0, 720)) for i in range(3000)]
    alive = lambda k, d: any(n == k and a <= d and (b is None or d < b) for n, a, b in ents)
    assert orphans(spark, rel, ([], ents, [])) == {i for i, _, k, d in rel if not alive(k, d)}


def test_arrivals_resolve_and_deletions_reopen(spark):
    ledger = OrphanLedger(spark)

    def step(rel, ents):
        log = reference_log(relations(spark, rel)).unionByName(parent_log(*tables(spark, [], ents, [])))
        found = {r.ref for r in ledger.apply(log).filter("orphan").collect()}
        return found, sum(r.n_pending for r in ledger.snapshots[-1].collect())

    assert step([(1, "function", "k", 1), (2, "function", "k", 2)], []) == ({1, 2}, 2)
    assert step([(3, "function", "k", 12)], [("k", 10, None)]) == (set(), 0)
    ended = spark.createDataFrame([("k", day(20), day(21))], "node_id string, first_seen_at timestamp_ntz, removed_at timestamp_ntz")
    from silverloom.operators.orphans import lifetime_log

    gone = lifetime_log(ended, "entities", F.col("node_id"), F.col("first_seen_at"), F.col("removed_at")).filter("delta < 0")
    late = reference_log(relations(spark, [(4, "function", "k", 30)]))
    assert {r.ref for r in ledger.apply(late.unionByName(gone)).filter("orphan").collect()} == {4}
    assert sum(r.n_pending for r in ledger.snapshots[-1].collect()) == 4


def test_carries_over_partitions():
    class R:
        def __init__(self, pid, kd, first, net):
            self.pid, self.kd, self.first, self.net = pid, kd, first, net

    rows = [R(0, b"a", True, 1), R(0, b"b", False, 2), R(1, b"b", True, 3), R(2, b"b", True, -1), R(2, b"c", False, 5), R(3, b"d", True, 1)]
    assert _carries(rows) == [(0, 0), (1, 2), (2, 5), (3, 0)]


def test_state_in_many_small_batches(spark, monkeypatch):
    """A batch a day, with segments merged in between: every snapshot counts what waits at the end of its day."""
    from silverloom.operators import orphans as module

    monkeypatch.setattr(module, "SEGMENTS", 3)
    rng = random.Random(8)
    ents = [(f"k{rng.randint(0, 5)}", a, rng.choice([None, a + rng.randint(1, 4)])) for a in (rng.randint(0, 7) for _ in range(14))]
    rel = [(i, "function", f"k{rng.randint(0, 6)}", rng.randint(0, 8)) for i in range(60)]
    log = reference_log(relations(spark, rel)).unionByName(parent_log(*tables(spark, [], ents, [])))
    ledger, judged = run_ledger(log, F.floor(F.col("at") / 86_400_000_000).cast("long"))
    alive = lambda k, d: any(n == k and a <= d and (b is None or d < b) for n, a, b in ents)
    assert {r.ref for r in judged.filter("orphan").collect()} == {i for i, _, k, d in rel if not alive(k, d)}
    start = int(day(0).replace(tzinfo=dt.timezone.utc).timestamp()) // 86_400
    for s in ledger.snapshots:
        for r in [s.groupBy("snapshot").agg(F.sum("n_references").alias("n"), F.sum("n_pending").alias("p")).first()]:
            d = int(r.snapshot) - start if r else 0
            assert r is None or (r.n, r.p) == (sum(x[3] <= d for x in rel), sum(x[3] <= d and not alive(x[2], d) for x in rel))
