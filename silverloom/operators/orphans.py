"""References to records that do not exist.

``OrphanLedger`` keeps a keyed state: for every key of a referenced table how many rows with that key are alive, and how many references of each period point at it (those that found
a parent too, as a deletion makes them orphans again). The state is a log of segments, one a batch, stored in hash buckets of the key. A batch of references and of
arrivals and deletions of parents reads the state of its own keys only, and only the batch is shuffled for that; the rest of the state is not touched. New references probe the parents as they were
at that moment, arriving parents resolve the references that wait for them, deletions reopen them; what this changes in the number of pending
references is added to the counts per table and period, of which each batch leaves a snapshot. Segments are merged once there are ``SEGMENTS``.

Within a batch all changes and references are brought into the order (key, moment, parents first) by range partitioning,
each partition keeps a running number of living parents, and the numbers a key has from earlier partitions are added
from a table of one row per partition. A key that holds a third of all rows is thereby spread over many tasks.

Defined cases: keys are trimmed, compared in NFC and case-sensitively; blank keys are no references; target types without
a referenced table (``module`` and unknown ones) are no references; a parent row whose end is not after its start never lives, one without a start
never counts (a file row always counts); a reference without a moment is judged at the beginning of time; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.functions.text import nfc
from silverloom.session import bucketed, staged

#: The table each kind of target refers to.
TARGET_TABLE = {"file": "files", "symbol": "shared_symbols", "function": "entities", "class": "entities", "type": "entities", "interface": "entities"}
START = -(2**63)
LOG = "epoch long, tbl string, kd binary, at long, kind int, delta long, ref long, period string"


def _digest(table: Column, key: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("\u0001", table, key)))


def _moment(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def reference_log(relations: DataFrame) -> DataFrame:
    """References as narrow log rows (table, 16-byte key, moment, relation_id, month)."""
    table = F.create_map(*[F.lit(x) for pair in TARGET_TABLE.items() for x in pair])[F.col("target_type")]
    key = F.trim(F.regexp_replace("target_ref", r"^\s+|\s+$", ""))
    return (
        relations.select("relation_id", "observed_at", table.alias("tbl"), key.alias("key"))
        .filter(F.col("tbl").isNotNull() & (F.col("key") != ""))
        .select(
            "tbl", _digest(F.col("tbl"), nfc(F.col("key"))).alias("kd"), F.coalesce(_moment(F.col("observed_at")), F.lit(START)).alias("at"),
            F.lit(1).alias("kind"), F.lit(0).cast("long").alias("delta"), F.col("relation_id").alias("ref"), F.date_format("observed_at", "yyyy-MM").alias("period"),
        )
    )


def lifetime_log(rows: DataFrame, table: str, key: Column, start: Column | None, end: Column | None) -> DataFrame:
    """Arrivals (+1) and deletions (-1) of parents; without ``start`` a row lives for ever."""
    lives = rows.select(key.alias("key"), *([] if start is None else [_moment(start).alias("a"), _moment(end).alias("b")])).filter(F.col("key").isNotNull())
    if start is None:
        changes = F.array(F.struct(F.lit(START).alias("at"), F.lit(1).alias("delta")))
    else:
        lives = lives.filter(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a"))))
        changes = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("delta")))
    return (
        lives.select(_digest(F.lit(table), nfc(F.col("key"))).alias("kd"), F.explode(changes).alias("c"))
        .filter(F.col("c.at").isNotNull())
        .groupBy("kd", "c.at").agg(F.sum("c.delta").alias("delta"))
        .select(F.lit(table).alias("tbl"), "kd", "at", F.lit(0).alias("kind"), "delta", F.lit(None).cast("long").alias("ref"), F.lit(None).cast("string").alias("period"))
    )


def parent_log(files: DataFrame, entities: DataFrame, shared_symbols: DataFrame) -> DataFrame:
    return (
        lifetime_log(files, "files", F.concat("machine_id", F.lit(":"), "file_path"), None, None)
        .unionByName(lifetime_log(entities, "entities", F.col("node_id"), F.col("first_seen_at"), F.col("removed_at")))
        .unionByName(lifetime_log(shared_symbols, "shared_symbols", F.col("symbol_ref"), F.col("added_at"), F.col("retired_at")))
    )


_SWEPT = "pid int, kd binary, tbl string, ref long, period string, alive long, first boolean, last boolean, net long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running number of living parents within one sorted partition. Gives the references, then a summary of the partition's first and last key."""
    pid = TaskContext.get().partitionId()
    first = last = None
    first_net = running = 0
    schema = pa.schema([("pid", pa.int32()), ("kd", pa.binary()), ("tbl", pa.string()), ("ref", pa.int64()), ("period", pa.string()), ("alive", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("net", pa.int64())])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kd, delta, kind = batch.column("kd"), np.asarray(batch.column("delta")), np.asarray(batch.column("kind"))
        if first is None:
            first = last = kd[0].as_py()
        codes = np.asarray(kd.dictionary_encode().indices)
        start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        total = np.cumsum(delta)
        before = np.where(start > 0, total[start - 1], 0)
        opening = np.zeros(len(start), np.int64)
        if kd[0].as_py() == last:
            opening[0] = running
        alive = total - np.repeat(before - opening, np.diff(np.r_[start, n]))
        in_first = np.zeros(n, bool)
        if kd[0].as_py() == first:
            end = start[1] if len(start) > 1 else n
            in_first[:end] = True
            first_net = int(alive[end - 1])
        last, running = kd[n - 1].as_py(), int(alive[n - 1])
        refs = np.flatnonzero(kind == 1)
        if len(refs):
            at = pa.array(refs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(refs), pid, np.int32)), kd.take(at), batch.column("tbl").take(at), batch.column("ref").take(at), batch.column("period").take(at),
                 pa.array(alive[refs]), pa.array(in_first[refs]), pa.nulls(len(refs), pa.bool_()), pa.nulls(len(refs), pa.int64())], schema=schema)
    if first is not None:
        edges = [(first, True, first == last, first_net)] + ([] if first == last else [(last, False, True, running)])
        k = len(edges)
        yield pa.RecordBatch.from_arrays(
            [pa.array([pid] * k, pa.int32()), pa.array([e[0] for e in edges], pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()),
             pa.nulls(k, pa.int64()), pa.array([e[1] for e in edges]), pa.array([e[2] for e in edges]), pa.array([e[3] for e in edges], pa.int64())], schema=schema)


def _carries(summary: list) -> list[tuple[int, int]]:
    """(partition, number its first key has from earlier partitions), from one or two rows per partition."""
    out, key, held = [], None, 0
    for row in sorted(summary, key=lambda r: (r.pid, not r.first)):
        if row.first:
            carry = held if row.kd == key else 0
            out.append((row.pid, carry))
            key, held = row.kd, carry + row.net
        else:
            key, held = row.kd, row.net
    return out


SEGMENTS = 8
_STATE = "tbl string, kd binary, is_ref boolean, period string, n long, alive long"
_COUNTS = ["n_references", "n_orphans", "n_pending"]


@dataclass
class OrphanLedger:
    """State: ``segments`` (tbl, kd, is_ref, period, n, alive), whose sums are the references and living parents of each key; ``counts`` per table and period."""

    spark: SparkSession
    segments: list[DataFrame] = field(default_factory=list)
    counts: DataFrame | None = None
    snapshots: list[DataFrame] = field(default_factory=list)

    def _state_of(self, keys: DataFrame) -> DataFrame:
        """The state of some keys (kd), by way of the buckets."""
        found = self.spark.createDataFrame([], _STATE)
        for segment in self.segments:
            found = found.unionByName(segment.join(keys, "kd", "left_semi"))
        return found.groupBy("tbl", "kd", "is_ref", "period").agg(F.sum("n").alias("n"), F.sum("alive").alias("alive"))

    def apply(self, log: DataFrame, label: str = "") -> DataFrame:
        """Applies one batch of references and parent changes, later than all earlier ones.

        Returns a row (ref, tbl, period, orphan) per reference, judged at its own moment, and keeps the new state and a snapshot.
        """
        columns = ["tbl", "kd", "at", "kind", "delta", "ref", "period"]
        none = lambda t: F.lit(None).cast(t)
        before = staged(self._state_of(log.select("kd").distinct()), "orphan-before")
        opening = before.filter("NOT is_ref AND alive <> 0").select("tbl", "kd", F.lit(START).alias("at"), F.lit(0).alias("kind"), F.col("alive").alias("delta"), none("long").alias("ref"), none("string").alias("period"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["kd", "at", "kind", "ref"]
        swept = staged(log.select(*columns).unionByName(opening).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _SWEPT), "orphans")
        summary = swept.filter(F.col("last").isNotNull()).select("pid", "kd", "first", "net").collect()  # two rows per partition at most
        carry = F.create_map(*[F.lit(x) for pair in _carries(summary) if pair[1] for x in pair] or [F.lit(-1), F.lit(0)])
        alive = F.col("alive") + F.when(F.col("first"), F.coalesce(carry[F.col("pid")], F.lit(0))).otherwise(0)
        judged = swept.filter(F.col("last").isNull()).select("ref", "tbl", "kd", "period", (alive <= 0).alias("orphan"))

        zero = F.lit(0).cast("long")
        new_refs = judged.groupBy("tbl", "kd", "period").agg(F.count(F.lit(1)).alias("n")).select("tbl", "kd", F.lit(True).alias("is_ref"), "period", "n", zero.alias("alive"))
        changes = log.filter("kind = 0").groupBy("tbl", "kd").agg(F.sum("delta").alias("alive")).select("tbl", "kd", F.lit(False).alias("is_ref"), none("string").alias("period"), zero.alias("n"), "alive")
        segment = bucketed(new_refs.unionByName(changes), "orphan-state", "kd", n)

        both = before.withColumn("fresh", F.lit(False)).unionByName(segment.withColumn("fresh", F.lit(True)))
        was = lambda c: F.sum(F.when(~F.col("fresh"), F.col(c)).otherwise(0))
        parents = both.filter("NOT is_ref").groupBy("kd").agg(was("alive").alias("alive_before"), F.sum("alive").alias("alive_after"))
        refs = both.filter("is_ref").groupBy("tbl", "kd", "period").agg(was("n").alias("n_before"), F.sum("n").alias("n_after"))
        waits = lambda alive, n: F.when(F.coalesce(alive, zero) <= 0, F.col(n)).otherwise(0)
        pending = refs.join(parents, "kd", "left").groupBy("tbl", "period").agg(F.sum(waits(F.col("alive_after"), "n_after") - waits(F.col("alive_before"), "n_before")).alias("n_pending"))
        seen = judged.groupBy("tbl", "period").agg(F.count(F.lit(1)).alias("n_references"), F.count_if("orphan").alias("n_orphans"))
        rows = pending.select("tbl", "period", zero.alias("n_references"), zero.alias("n_orphans"), "n_pending").unionByName(seen.withColumn("n_pending", zero))
        if self.counts is not None:
            rows = rows.unionByName(self.counts)
        self.counts = staged(rows.groupBy("tbl", "period").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "orphan-counts")
        self.snapshots.append(self.counts.select(F.lit(label).alias("snapshot"), "tbl", "period", *_COUNTS))
        self.segments.append(segment)
        if len(self.segments) >= SEGMENTS:
            whole = self.segments[0]
            for s in self.segments[1:]:
                whole = whole.unionByName(s)
            whole = whole.groupBy("tbl", "kd", "is_ref", "period").agg(F.sum("n").alias("n"), F.sum("alive").alias("alive")).filter("is_ref OR alive <> 0")
            self.segments = [bucketed(whole, "orphan-state", "kd", n)]
        return judged.select("ref", "tbl", "period", "orphan")


def run_ledger(log: DataFrame, epoch: Column) -> tuple[OrphanLedger, DataFrame]:
    """Applies a whole log in the order of its epochs, a batch each. Gives the ledger and the judged references."""
    spark = log.sparkSession
    parts = staged(log.withColumn("epoch", epoch), "orphan-log", ["epoch"])
    ledger, judged = OrphanLedger(spark), spark.createDataFrame([], "ref long, tbl string, period string, orphan boolean")
    for (e,) in sorted(tuple(r) for r in parts.select("epoch").distinct().collect()):  # one row per epoch
        judged = judged.unionByName(ledger.apply(parts.filter(F.col("epoch") == e), str(e)))
    return ledger, judged


def half_year(at: Column) -> Column:
    """Epoch of a moment: year * 10 + half; 0 for the beginning of time."""
    ts = F.timestamp_micros(at)
    return F.when(at == START, 0).otherwise(F.year(ts) * 10 + F.when(F.month(ts) > 6, 2).otherwise(1)).cast("long")
