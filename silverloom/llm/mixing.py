"""Mixing sources to target weights.

The total is the largest for which every source can give its share without using a text more often than allowed. It is cut into
blocks of equally many tokens, which the Sainte-Lague rule allots to the sources by highest quotients; as this rule never takes back
a block when the total grows, the allotments of growing totals differ by whole numbers, the quotas of the shards. Every source puts its
texts into a seeded order and cuts it into blocks; beginning with a seeded block and passing through them again for each further use, the blocks up to the quota
are selected, the first ones for the first shard and so on. Each draw of a text thus belongs to a block and, by the quotas, to a shard. A text is drawn if it ends within the quota of its
source. What then is missing (less than the text that stands at the end) is filled by further texts, the longest that fits first, until none fits; these stand in the last block.
They are found from the counts of the lengths that fit, not one by one.

The running token count of a source is built from totals per hash bucket and running counts within the buckets, so that a source
with a third of all texts is spread over many tasks.

Defined cases: sources are compared in lower case with blanks and hyphens as underscores; texts of other sources are left out first. With ``merge_equal`` (the default) equal texts are one text (the one
with the smallest doc_id, in that row's source), so that copies do not get around ``max_repeats``; without it every row is a text. Null and empty texts, and sources without a target, are never drawn;
a target without any text is reported with a share of 0 and the others share the total among themselves; max_repeats that is null or under 1 counts as 0 uses.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverloom.llm.tokens import TOKENIZER, sized
from silverloom.session import staged

BLOCK_TOKENS = 512


def clean_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def sainte_lague(weights: dict[str, float], seats: int) -> dict[str, int]:
    """Seats by the highest quotients weight / (2k + 1); of equal quotients the name that sorts first wins."""
    total = sum(weights.values())
    if total <= 0 or seats <= 0:
        return dict.fromkeys(weights, 0)
    # at a common divisor every source has round(weight * x) seats; start below the wanted number, then add by highest quotient
    x = max(0.0, (seats - len(weights)) / total)
    got = {s: max(0, int(w * x + 0.5) - 1) if w > 0 else 0 for s, w in weights.items()}
    while sum(got.values()) > seats:
        s = min((s for s in got if got[s]), key=lambda s: (weights[s] / (2 * got[s] - 1), s))
        got[s] -= 1
    for _ in range(seats - sum(got.values())):
        s = min((s for s in weights if weights[s] > 0), key=lambda s: (-weights[s] / (2 * got[s] + 1), s))
        got[s] += 1
    return got


def shard_quotas(weights: dict[str, float], blocks: int, shards: int) -> list[dict[str, int]]:
    """Blocks of each source in each shard: differences of the allotments of growing totals."""
    out, before = [], dict.fromkeys(weights, 0)
    for j in range(1, shards + 1):
        now = sainte_lague(weights, blocks * j // shards)
        out.append({s: now[s] - before[s] for s in weights})
        before = now
    return out


def fill_gap(gap: int, lengths: dict[int, int]) -> dict[int, int]:
    """length -> number of texts that fill a gap, the longest that fits first. ``lengths``: length -> number of texts there are."""
    out = {}
    for n in sorted(lengths, reverse=True):
        if (k := min(lengths[n], gap // n)) > 0:
            out[n] = k
            gap -= k * n
    return out


def mix_sources(
    documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, shards: int = 8, seed: int = 1, texts_per_bucket: int = 1_000_000, merge_equal: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draws, shares, quotas).

    Draws: doc_id, source, n_tokens, use (from 0), block, shard, a row for each time a text is drawn. Shares: source, target_share, reached_share, n_tokens, n_texts, n_draws.
    Quotas: shard, source, n_blocks.
    """
    spark = documents.sparkSession
    want = {r[0]: (float(r[1] or 0), max(0, int(r[2] or 0))) for r in targets.select(clean_source(F.col("source")), "target_share", "max_repeats").collect() if r[0]}
    source = clean_source(F.col("source"))
    mine = documents.filter((F.col("text") != "") & (source.isin(*want) if want else F.lit(False)))
    counted = sized(mine.withColumns({"__sl_source": source, "__sl_digest": F.md5("text")}), ["doc_id", "__sl_source", "__sl_digest"], tokenizer)
    if merge_equal:
        counted = counted.groupBy("__sl_digest").agg(F.min(F.struct("doc_id", "__sl_source", "n_tokens")).alias("d")).select("d.*", "__sl_digest")
    texts = staged(counted.select("doc_id", F.col("__sl_source").alias("source"), "n_tokens", F.xxhash64(F.lit(seed), "__sl_digest", "doc_id").alias("h")).filter("n_tokens > 0"), "mix-texts")
    have = {r[0]: (r[1], r[2]) for r in texts.groupBy("source").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()}  # one row per target
    weights = {s: share for s, (share, most) in want.items() if s in have and share > 0 and most > 0}
    scale = sum(weights.values())
    total = min((have[s][0] * want[s][1] * scale / w for s, w in weights.items()), default=0)
    quotas = shard_quotas(weights, int(total // block_tokens), shards) if weights else []
    blocks = {s: sum(q[s] for q in quotas) for s in weights}
    rng = random.Random(seed)
    rows = []
    for s in sorted(weights):
        start = rng.randrange(max(1, have[s][0] // block_tokens)) * block_tokens
        rows.append((s, have[s][0], min(blocks[s] * block_tokens, have[s][0] * want[s][1]), want[s][1], start, list(accumulate(q[s] for q in quotas))))
    limits = F.broadcast(spark.createDataFrame(rows, "source string, per_pass long, quota long, most int, start long, ends array<long>"))  # one row per target

    buckets = max(16, min(65_536, sum(n for _, n in have.values()) // texts_per_bucket))
    placed = texts.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("offset") - F.col("start")
    uses = F.floor((F.col("quota") - F.col("begin") - F.col("n_tokens")) / F.col("per_pass")) + 1
    located = staged(
        placed.join(offsets, ["source", "bucket"])
        .join(limits, "source")
        .withColumn("begin", at)
        .withColumn("begin", F.when(F.col("begin") < 0, F.col("begin") + F.col("per_pass")).otherwise(F.col("begin")))
        .select("doc_id", "source", "n_tokens", "h", "begin", "most", F.least(F.col("most"), F.greatest(F.lit(0), uses)).cast("int").alias("n")),
        "mix-located",
    )
    got = {r[0]: r[1] for r in located.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n"))).collect()}  # one row per target
    gaps = [(r[0], r[2] - got.get(r[0], 0)) for r in rows if r[2] > got.get(r[0], 0)]
    gap_rows = F.broadcast(spark.createDataFrame(gaps, "source string, gap long"))
    open_ = located.filter(F.col("n") < F.col("most")).join(gap_rows, "source").filter(F.col("n_tokens") <= F.col("gap"))
    lengths: dict[str, dict[int, int]] = {}
    for s, n, k in open_.groupBy("source", "n_tokens").agg(F.count(F.lit(1))).collect():  # lengths below a gap, which is below the longest text
        lengths.setdefault(s, {})[n] = k
    picks = [(s, n, k) for s, gap in gaps for n, k in fill_gap(gap, lengths.get(s, {})).items()]
    pick_rows = F.broadcast(spark.createDataFrame(picks, "source string, n_tokens long, k long"))
    turn = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("h", "doc_id"))
    fillers = open_.join(pick_rows, ["source", "n_tokens"]).withColumn("turn", turn).filter(F.col("turn") <= F.col("k"))

    block = F.floor((F.col("use") * F.col("per_pass") + F.col("begin")) / block_tokens)
    chosen = located.filter("n > 0").withColumn("use", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("most").join(limits, "source").select("doc_id", "source", "n_tokens", "use", block.alias("block"), "ends")
    last = fillers.select("doc_id", "source", "n_tokens", F.col("n").alias("use")).join(limits, "source").select("doc_id", "source", "n_tokens", "use", (F.element_at("ends", -1) - 1).alias("block"), "ends")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("block")))
    draws = staged(chosen.unionByName(last).select("doc_id", "source", "n_tokens", "use", "block", shard.alias("shard")), "mix-drawn")
    sums = draws.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("use") == 0).alias("n_texts"), F.count(F.lit(1)).alias("n_draws"))
    aims = spark.createDataFrame([(s, share) for s, (share, _) in want.items()], "source string, target_share double")
    all_tokens = F.sum("n_tokens").over(Window.partitionBy())  # one row per target
    shares = aims.join(sums, "source", "left").select(
        "source", "target_share", F.round(F.coalesce(F.col("n_tokens") / all_tokens, F.lit(0.0)), 6).alias("reached_share"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_tokens", "n_texts", "n_draws")],
    )
    quota_rows = [(j, s, n) for j, q in enumerate(quotas) for s, n in q.items()]
    return draws, shares, spark.createDataFrame(quota_rows, "shard int, source string, n_blocks long")


def drawn_texts(draws: DataFrame) -> DataFrame:
    """A row for each drawn text: doc_id, source, n_tokens, n_draws, and its shards and blocks in the order of its uses."""
    places = F.array_sort(F.collect_list(F.struct("use", "shard", "block")))  # at most max_repeats
    return draws.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("n_draws"), places.alias("p")).select("doc_id", "source", "n_tokens", "n_draws", F.col("p.shard").alias("shards"), F.col("p.block").alias("blocks"))
