import json

import pytest
from pyspark.sql import functions as F

from silverloom.operators.redelivery import split_deliveries

SCHEMA = "delivery_id long, batch_id long, machine_id string, project string, id long, payload string, block long, bitmap string"


def run(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "q.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("overwrite").parquet(path)
    d = split_deliveries(spark.read.parquet(path))
    return sorted((r[0] for r in d.first("delivery_id").collect()), key=str), sorted((r[0] for r in d.repeats("delivery_id").collect()), key=str)


def message(path="/a", t=1, h="AB", **more):
    return {"type": "MODIFY", "path": path, "timestamp": t, "content_hash": h, **more}


def row(delivery, events, machine="m", number=1, raw=None):
    return (delivery, 1, machine, "p", number, raw if raw is not None else json.dumps(events), 7, "x")


def test_same_message_in_other_styles(spark, tmp_path):
    a = message("/caf\u00e9")
    rows = [
        row(1, [a]),
        row(2, None, raw=json.dumps([dict(reversed(a.items()))], indent=2, ensure_ascii=False)),
        row(3, [message("/cafe\u0301", h="ab", content="x")]),
        row(4, [message("/caf\u00e9", t=2)]),
        row(5, [a], machine="n"),
        row(6, [a], number=2),
        row(7, [a, a]),
    ]
    assert run(spark, tmp_path, rows, 3) == ([1, 4, 5, 6, 7], [2, 3])


def test_nulls_ties_and_bad_payloads(spark, tmp_path):
    rows = [
        row(1, None, raw="not json"), row(2, None, raw=" not json "), row(3, None, raw="other"),
        (4, 1, None, None, None, None, None, None), (5, 1, None, None, None, None, None, None),
        row(6, [message()], machine=None), row(7, [message()], machine=None),
        row(None, [message()]), row(9, [message()]), row(9, [message()]),
        row(10, []), row(11, []), row(12, None, raw=""), row(13, None, raw=""),
    ]
    first, again = run(spark, tmp_path, rows)
    assert sorted(first, key=str) == sorted([1, 3, 4, 6, 9, 10, 12], key=str)
    assert sorted(again, key=str) == sorted([2, 5, 7, None, 9, 11, 13], key=str)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == ([], [])


@pytest.mark.parametrize("rows", [40_000])
def test_many_blocks_and_one_hot_message(spark, tmp_path, rows):
    """Over one block of rows, a third of them the same message; wide columns come back untouched."""
    path = str(tmp_path / "big.parquet")
    hot = json.dumps([message()])
    made = spark.range(rows, numPartitions=1).select(
        F.col("id").alias("delivery_id"), F.lit("m").alias("machine_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), F.lit(hot).alias("payload"), F.concat(F.lit("w"), F.col("id")).alias("wide")
    )
    made.write.option("parquet.block.size", 200_000).parquet(path)
    d = split_deliveries(spark.read.parquet(path))
    first = d.first()
    hot_rows = len(range(0, rows, 3))
    assert first.count() == rows - hot_rows + 1
    assert first.filter(F.col("wide") != F.concat(F.lit("w"), F.col("delivery_id"))).count() == 0
    assert d.repeats("delivery_id").agg(F.count(F.lit(1)), F.min("delivery_id")).first() == (hot_rows - 1, 3)


@pytest.mark.parametrize("name", ["a b", "\u00fc \u00e9", "p%20q", "x+y=1", "a#b?"])
def test_special_characters_in_paths(spark, tmp_path, name):
    assert run(spark, tmp_path / name, [row(1, [message()]), row(2, [message()])]) == ([1], [2])


def test_partition_folders_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [row(1, [message()]), row(2, [message()]), row(3, [message(t=2)])]
    spark.createDataFrame(rows, SCHEMA).withColumn("day", F.when(F.col("delivery_id") != 1, F.col("delivery_id").cast("int"))).drop("block").write.partitionBy("day").parquet(path)
    scan = spark.read.schema(SCHEMA + ", day int").parquet(path)
    got = sorted((r.delivery_id, r.day, r.block, r.bitmap) for r in split_deliveries(scan).first().collect())
    assert got == [(1, None, None, "x"), (3, 3, None, "x")]
