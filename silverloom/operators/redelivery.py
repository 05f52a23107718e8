"""Messages delivered more than once: exactly one delivery of each message stays.

Only a 16-byte identifier, the delivery number and the position in the file are shuffled. The first delivery of each message
wins; every file then gets a vector of its winning rows, and the wide payloads are read once more through these vectors.

Defined cases: deliveries agree if machine, number and the list of events agree (events by type, path in NFC, timestamp as a
number, hash ignoring case); nulls agree with nulls only; a payload that is no JSON list or object counts by its trimmed text; of equal delivery
numbers the row that stands first in the files wins; a null delivery number comes after all others; an empty table gives an
empty result. Further columns are passed on untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverloom.functions.text import nfc_all
from silverloom.sources.positions import FILE, ROW, read_rows, row_vectors, with_position

EVENTS = "array<struct<type:string,path:string,timestamp:string,content_hash:string>>"


def message_digest(machine: Column, number: Column, payload: Column, events: Column) -> Column:
    """128-bit identifier of a message. ``events``: the payload parsed as EVENTS; null if it can't be parsed."""
    moment = F.transform(events, lambda e: F.coalesce(e.timestamp.try_cast("decimal(30,6)").cast("string"), e.timestamp))
    parts = F.struct(
        machine.alias("m"),
        number.cast("string").alias("n"),
        F.when(events.isNull(), F.trim(payload)).alias("raw"),
        events.type.alias("t"),
        nfc_all(events.path).alias("p"),
        moment.alias("s"),
        F.transform(events.content_hash, F.lower).alias("h"),
    )
    return F.unhex(F.md5(F.to_json(parts)))


@dataclass
class Deliveries:
    """The deliveries of a queue table, split into the first of each message and the repeats."""

    scan: DataFrame
    vectors: DataFrame

    def first(self, *columns: str) -> DataFrame:
        """Exactly one delivery of each message."""
        return read_rows(self.vectors, self._schema(columns))

    def repeats(self, *columns: str) -> DataFrame:
        """The other deliveries."""
        return read_rows(self.vectors, self._schema(columns), invert=True)

    def _schema(self, columns: tuple[str, ...]):
        return self.scan.select(*columns).schema if columns else self.scan.schema


def split_deliveries(scan: DataFrame, order: str = "delivery_id") -> Deliveries:
    """``scan`` is a plain Parquet scan with machine_id, id, payload and the delivery number ``order``."""
    narrow = with_position(scan)
    keyed = narrow.select(
        F.col("machine_id"), F.col("id"), F.col("payload"), F.col(order).alias("__sl_order"), FILE, ROW, F.from_json("payload", EVENTS).alias("__sl_events")
    ).select(
        message_digest(F.col("machine_id"), F.col("id"), F.col("payload"), F.col("__sl_events")).alias("__sl_key"),
        F.struct(F.col("__sl_order").isNull(), "__sl_order", FILE, ROW).alias("__sl_at"),
    )
    winners = keyed.groupBy("__sl_key").agg(F.min("__sl_at").alias("w")).select(f"w.{FILE}", f"w.{ROW}")
    return Deliveries(scan, row_vectors(scan, winners))
