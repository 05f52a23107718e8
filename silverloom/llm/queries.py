"""Queries over texts and source files, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silverloom.llm.mixing import clean_source, drawn_texts, mix_sources
from silverloom.llm.mojibake import garbled
from silverloom.llm.packing import pack_documents
from silverloom.llm.parsing import FAILED, parse_rates, parsed_files
from silverloom.llm.provenance import classified
from silverloom.llm.splitting import split_items
from silverloom.session import staged


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_items(_t(spark, sf, "file_events")).filter("piece = 0").select("delivery_id", "entity_index")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_items(_t(spark, sf, "file_events"))


def p3_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The items put together again from their pieces, and how many pieces are too long or overlap the one before wrongly."""
    pieces = F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text")))  # those of one text
    items = split_items(_t(spark, sf, "file_events")).groupBy("delivery_id", "entity_index").agg(pieces.alias("p"))
    before = lambda i: F.when(i > 0, F.element_at("p", i)["end"]).otherwise(F.lit(0))
    rebuilt = F.array_join(F.transform("p", lambda x, i: F.substring(x["text"], before(i) - x["start"] + 1, F.length(x["text"]))), "")
    overlap = lambda x, i: before(i) - x["start"]
    wrong = F.size(F.filter("p", lambda x, i: (x["piece"] != i) | (overlap(x, i) > 300) | ((i > 0) & (overlap(x, i) < 0)) | (F.length(x["text"]) != x["end"] - x["start"])))
    long = F.size(F.filter("p", lambda x: F.length(x["text"]) > 2400))
    return items.select("delivery_id", "entity_index", F.md5(rebuilt).alias("text_md5"), long.alias("n_too_long"), wrong.alias("n_wrong"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return parsed_files(_t(spark, sf, "file_events")).filter(F.col("verdict").isin(*FAILED)).select("delivery_id")


def p4_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = parsed_files(_t(spark, sf, "file_events"))
    return rows.withColumn("accepted_by", F.array_join("accepted_by", ","))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return parse_rates(parsed_files(_t(spark, sf, "file_events")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_t(spark, sf, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return garbled(_t(spark, sf, "documents"))


def p6_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return classified(_t(spark, sf, "files"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_kinds(spark, sf).filter("kind <> 'hand'").select("file_id")


def p7_assignments(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_t(spark, sf, "documents"), _t(spark, sf, "pack_limits"))[0]


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_t(spark, sf, "documents"), _t(spark, sf, "pack_limits"))[1]


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per pack: documents, those not placed, parts placed twice, containers over their capacity or whose load is not that reported."""
    limits = _t(spark, sf, "pack_limits").select("pack_name", "capacity_tokens").distinct()
    assigned, containers = pack_documents(_t(spark, sf, "documents"), limits)
    assigned = staged(assigned, "packed")
    docs = _t(spark, sf, "documents").select("doc_id")
    per_part = assigned.groupBy("pack_name", "doc_id", "part").agg(F.count(F.lit(1)).alias("n"))
    per_doc = per_part.groupBy("pack_name", "doc_id").agg(F.max("part").alias("last"), F.count(F.lit(1)).alias("n_parts"), F.sum(F.col("n") - 1).alias("twice"))
    placed = per_doc.join(docs, "doc_id").groupBy("pack_name").agg(F.count_if(F.col("n_parts") == F.col("last") + 1).alias("n_whole"), F.sum("twice").alias("n_twice"))
    load = assigned.filter("n_tokens > 0").groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("load"))
    wrong = load.join(containers, ["pack_name", "container_id"], "full_outer").join(F.broadcast(limits), "pack_name").groupBy("pack_name").agg(F.count_if(F.coalesce((F.col("load") != F.col("used_tokens")) | (F.col("load") > F.col("capacity_tokens")), F.lit(True))).alias("n_wrong"))
    n = docs.agg(F.count(F.lit(1)).alias("n_documents"))
    return limits.join(placed, "pack_name", "left").join(wrong, "pack_name", "left").crossJoin(F.broadcast(n)).select("pack_name", "n_documents", (F.col("n_documents") - F.col("n_whole")).alias("n_missing"), "n_twice", "n_wrong")  # one row of counts per pack


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per pack: containers, the fewest that could hold all tokens, mean fill."""
    c = p7_containers(spark, sf).join(F.broadcast(_t(spark, sf, "pack_limits").select("pack_name", "capacity_tokens").distinct()), "pack_name")
    return c.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("used_tokens") / F.first("capacity_tokens")).alias("n_least"), F.round(F.sum("used_tokens") / F.sum("capacity_tokens"), 6).alias("mean_fill"))


def p8_drawn(spark: SparkSession, sf: str) -> DataFrame:
    d = drawn_texts(mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[0])
    return d.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("shards", "blocks")})


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Per source with a target: texts drawn too often, draws outside of the blocks of their shard, draws of another source's text."""
    draws, _, quotas = mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))
    t = _t(spark, sf, "mix_targets").select(clean_source(F.col("source")).alias("source"), "max_repeats")
    ends = quotas.withColumn("end", F.sum("n_blocks").over(Window.partitionBy("source").orderBy("shard"))).withColumn("start", F.col("end") - F.col("n_blocks"))  # shards x sources
    own = _t(spark, sf, "documents").select("doc_id", clean_source(F.col("source")).alias("own"))
    per_text = draws.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("use").alias("n_uses")).join(own, "doc_id", "left").join(F.broadcast(t), "source")
    a = per_text.groupBy("source").agg(F.count_if((F.col("n") > F.col("max_repeats")) | (F.col("n") != F.col("n_uses"))).alias("n_too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("n_foreign"))
    b = draws.join(F.broadcast(ends), ["source", "shard"], "left").groupBy("source").agg(F.count_if(F.coalesce((F.col("block") < F.col("start")) | (F.col("block") >= F.col("end")), F.lit(True))).alias("n_misplaced"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return t.select("source").join(a, "source", "left").join(b, "source", "left").select("source", zero("n_too_often"), zero("n_foreign"), zero("n_misplaced"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[1]


def p8_quotas(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))[2]


_ALL = (p3_found, p3_pieces, p3_rebuilt, p4_found, p4_verdicts, p4_rates, p6_found, p6_kinds, p7_assignments, p7_containers, p7_invariants, p7_fill, p8_drawn, p8_invariants, p8_shares, p8_quotas, p9_found, p9_restored)
QUERIES = {f.__name__: f for f in _ALL}

_P3 = r"""
WITH src AS (
  SELECT delivery_id, content, entities, regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n$', '') AS body,
         '[ \t\n\v\f\r\x1c-\x1f\x85\xa0]' AS ws FROM file_events WHERE content IS NOT NULL),
lines AS (SELECT *, string_split(body, chr(10)) AS ln FROM src),
ents AS (
  SELECT delivery_id, i - 1 AS entity_index,
         regexp_replace(regexp_replace(array_to_string(ln[entities[i].start_line : entities[i].end_line], chr(10)), '^[\s\x{85}\x{a0}\x{1c}-\x{1f}]+', ''), '[\s\x{85}\x{a0}\x{1c}-\x{1f}]+$', '') AS text
  FROM (SELECT delivery_id, ln, entities, unnest(range(1, len(entities) + 1)) AS i FROM lines)
  WHERE entities[i].start_line >= 1 AND entities[i].start_line <= entities[i].end_line AND entities[i].start_line <= len(ln)),
usable AS (SELECT * FROM ents WHERE text <> '')
"""

ORACLE = {
    "p3_found": _P3
    + """SELECT delivery_id, CAST(entity_index AS INTEGER) AS entity_index FROM usable WHERE length(text) > 2400
UNION ALL
SELECT delivery_id, -1 FROM src WHERE length(content) > 2400 AND delivery_id NOT IN (SELECT delivery_id FROM usable)""",
    "p3_rebuilt": _P3
    + """SELECT delivery_id, CAST(entity_index AS INTEGER) AS entity_index, md5(text) AS text_md5, 0 AS n_too_long, 0 AS n_wrong FROM usable WHERE length(text) > 2400
UNION ALL
SELECT delivery_id, -1, md5(content), 0, 0 FROM src WHERE length(content) > 2400 AND delivery_id NOT IN (SELECT delivery_id FROM usable)""",
    "p7_invariants": "SELECT pack_name, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_missing, 0 AS n_twice, 0 AS n_wrong FROM (SELECT DISTINCT pack_name, capacity_tokens FROM pack_limits)",
    "p8_invariants": r"SELECT regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source, 0 AS n_too_often, 0 AS n_foreign, 0 AS n_misplaced FROM mix_targets",
}
