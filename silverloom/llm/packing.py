"""Filling fixed-capacity containers with texts.

Hierarchical multi-length packing. Texts are routed to context-size tiers (capacity, 1/2, 1/4, ... of it). The long tier is packed
first; what a container of a tier leaves free is filled from the same and from all shorter tiers, the longest piece that
fits first. All this is decided on the histogram of token counts, which has at most ``capacity`` entries however many
texts there are: the plan says which ranks of each length go to which containers. The texts of a length are then
numbered in parallel (counts per task, offsets, local numbers) and look their container up in the plan.

Containers of a pack are dealt to step groups of ``group_size`` in the order of their work (sum of squared lengths) forth and back,
so that the groups do nearly equal work.

Defined cases: a text over the capacity is cut into full containers and a rest; a null or empty text has no tokens and stands in container 0;
texts of equal length are taken in the order of doc_id; repeated rows are packed one by one; a capacity that is null or under 1 is an
error; no documents give no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverloom.llm.tokens import TOKENIZER, sized
from silverloom.session import staged

TIERS, CHUNK = 4, 100_000


def tier_of(length: int, capacity: int, tiers: int = TIERS) -> int:
    """0 for lengths over half the capacity, 1 over a quarter, ...; the last tier takes the rest."""
    t = 0
    while t < tiers - 1 and length * 2 <= capacity:
        capacity //= 2
        t += 1
    return t


def plan_containers(counts: dict[int, int], capacity: int, tiers: int = TIERS) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(tier, containers, [(length, pieces of it in each container)]) for all pieces of a histogram."""
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    lengths = sorted(left)
    plan = []

    def drop(n: int) -> None:
        del left[n]
        lengths.pop(bisect_right(lengths, n) - 1)

    while lengths:
        longest = lengths[-1]
        tier, gap = tier_of(longest, capacity, tiers), capacity - longest
        pattern = {longest: 1}
        i = len(lengths) - 1
        while gap > 0 and i >= 0:
            i = min(i, bisect_right(lengths, gap) - 1)  # the longest that fits, of this tier or a shorter one
            if i < 0:
                break
            n = lengths[i]
            take = min(gap // n, left[n] - pattern.get(n, 0))
            if take > 0:
                pattern[n] = pattern.get(n, 0) + take
                gap -= take * n
            i -= 1
        times = min(left[n] // k for n, k in pattern.items())
        plan.append((tier, times, sorted(pattern.items(), reverse=True)))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                drop(n)
    return plan


class Placement:
    """Looks up the container of a piece from its length and its rank among the pieces of this length, whole arrays at once."""

    def __init__(self, plan: list):
        at: dict[int, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        container = 0
        for _, times, pattern in plan:
            for n, k in pattern:
                rows.append((n, at.get(n, 0), k, container))
                at[n] = at.get(n, 0) + k * times
            container += times
        rows.sort()
        entries = np.array(rows, np.int64).reshape(-1, 4)
        lengths = sorted(at)
        self.base = np.zeros(max(lengths, default=0) + 1, np.int64)  # number of shorter pieces, by length
        self.base[lengths] = np.cumsum([0, *(at[n] for n in lengths)])[:-1]
        self.rank, self.each, self.container = entries[:, 1], entries[:, 2], entries[:, 3]
        self.first = self.base[entries[:, 0]] + self.rank

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.first, self.base[lengths] + ranks, "right") - 1
        return self.container[i] + (ranks - self.rank[i]) // self.each[i]


def pack_documents(documents: DataFrame, limits: DataFrame, tokenizer: str = TOKENIZER, group_size: int = 8, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(assignments, containers) for every pack of ``limits`` (pack_name, capacity_tokens; a handful of rows).

    Assignments: pack_name, doc_id, part, n_tokens, container_id. Containers: pack_name, container_id, tier, n_pieces, used_tokens, fill, step_group.
    """
    spark = documents.sparkSession
    packs = [(r[0], r[1]) for r in limits.select("pack_name", "capacity_tokens").distinct().collect()]
    if any(c is None or c < 1 for _, c in packs):
        raise ValueError("capacity_tokens must be at least 1")
    sizes = staged(sized(documents, [key], tokenizer).withColumn("task", F.spark_partition_id()), "sizes")
    caps = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("cap")) for n, c in packs]))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("p.cap"))).cast("int")
    pieces = (
        sizes.select(F.col(key).alias("doc_id"), "n_tokens", "task", caps.alias("p"))
        .select("doc_id", "n_tokens", "task", F.col("p.pack_name").alias("pack_name"), F.col("p.cap").alias("cap"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        .select("pack_name", "doc_id", "part", "task", F.least(F.col("cap"), F.col("n_tokens") - F.col("part") * F.col("cap")).alias("length"))
    )
    by_task = staged(pieces.groupBy("pack_name", "length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = by_task.groupBy("pack_name", "length").agg(F.sum("n").alias("n")).collect()  # at most the sum of the capacities
    plans = {name: plan_containers({r.length: r.n for r in histogram if r.pack_name == name}, cap) for name, cap in packs}
    placements = spark.sparkContext.broadcast({name: Placement(p) for name, p in plans.items()})  # at most a row for each length a container has

    earlier = Window.partitionBy("pack_name", "length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("pack_name", "length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    local = Window.partitionBy("pack_name", "length", "task").orderBy("doc_id", "part")
    ranked = pieces.withColumn("r", F.row_number().over(local) - 1).join(offsets, ["pack_name", "length", "task"]).select("pack_name", "doc_id", "part", "length", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            names = np.array(batch.column("pack_name").to_pylist(), dtype=object)
            out = np.zeros(batch.num_rows, np.int64)
            for name, placement in placements.value.items():
                mine = np.flatnonzero((names == name) & (lengths > 0))
                if len(mine):
                    out[mine] = placement(lengths[mine], ranks[mine])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("pack_name", "doc_id", "part", "length")] + [pa.array(out, pa.int64())], names=["pack_name", "doc_id", "part", "n_tokens", "container_id"])

    key_type = dict(documents.dtypes)[key]
    assigned = ranked.mapInArrow(place, f"pack_name string, doc_id {key_type}, part int, n_tokens long, container_id long")

    rows = []
    for name, cap in packs:
        start = 0
        plan = []
        for tier, times, pattern in plans[name]:
            plan.append((sum(n * n * k for n, k in pattern), start, tier, times, pattern))
            start += times
        groups, at = max(1, -(-start // group_size)), 0
        for _, first, tier, times, pattern in sorted(plan, key=lambda x: (-x[0], x[1])):
            rows.append((name, cap, first, times, tier, sum(k for _, k in pattern), sum(n * k for n, k in pattern), at, groups))
            at += times
    schema = "pack_name string, cap long, first long, times long, tier int, n_pieces long, used_tokens long, at long, groups long"
    pos = F.col("at") + F.col("i")
    lap, col = F.floor(pos / F.col("groups")), pos % F.col("groups")
    # one pattern may fill a third of all containers: they are numbered in chunks that are spread over the tasks
    chunks = spark.createDataFrame(rows, schema).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))))
    if sum(row[3] for row in rows) > CHUNK:
        chunks = chunks.repartition("pack_name", "first", "chunk")
    containers = (
        chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("times"), (F.col("chunk") + 1) * CHUNK) - 1)))
        .select(
            "pack_name", (F.col("first") + F.col("i")).alias("container_id"), "tier", "n_pieces", "used_tokens", F.round(F.col("used_tokens") / F.col("cap"), 6).alias("fill"),
            F.when(lap % 2 == 0, col).otherwise(F.col("groups") - 1 - col).alias("step_group"),
        )
    )
    return assigned, containers
