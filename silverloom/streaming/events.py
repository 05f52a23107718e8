"""Streams of file events: coalescing by micro-batch, keyed state for unchanged content, folding into a snapshot table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from silverloom.operators.changefeed import FileTable
from silverloom.session import new_folder, remove_folder


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream over a Parquet table of events; a folder, or a single file."""
    schema = spark.read.parquet(path).schema
    is_file = path.endswith(".parquet") and _is_file(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file:
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def run_all(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, batch by batch, with a checkpoint in the shared folder."""
    checkpoint = new_folder(stream.sparkSession, f"stream-{label}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, every: str = "5 seconds") -> StreamingQuery:
    """Runs a stream until it is stopped, a batch at each tick of what came since the last."""
    checkpoint = new_folder(stream.sparkSession, f"stream-{label}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def deduplicated(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first event of each key; a key is forgotten ``within`` after its moment, so that the state is bounded."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def skip_unchanged(events: DataFrame) -> DataFrame:
    """(event_id) of the events whose content hash is that of the event before for their file, with one hash of state per file.

    ``events``: event_id, machine_id, path, sec, content_hash; within a batch they are taken by (sec, event_id).
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (None,)
        rows = pd.concat(list(parts)).sort_values(["sec", "event_id"])
        same = []
        for event, h in zip(rows["event_id"], rows["content_hash"]):
            if h == last:
                same.append(event)
            last = h
        state.update((last,))
        yield pd.DataFrame({"event_id": pd.Series(same, dtype="int64")})

    return events.groupBy("machine_id", "path").applyInPandasWithState(step, "event_id long", "last string", "append", GroupStateTimeout.NoTimeout)


def fold_into_table(stream: DataFrame, table: FileTable) -> None:
    """Every micro-batch is written once, applied to the bucketed table and removed; a batch that comes again changes nothing, as newer rows win."""

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = new_folder(batch.sparkSession, f"batch-{batch_id}")
        batch.write.parquet(folder)
        table.apply(batch.sparkSession.read.parquet(folder))
        remove_folder(batch.sparkSession, folder)
        table.vacuum()

    run_all(stream, write, "fold")


def debounced(events: DataFrame, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of events of a machine: a session ends when nothing came for ``gap``. Columns: machine_id, start, end, n_events, n_paths."""
    s = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "machine_id")
    return s.agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("path").alias("n_paths")).select("machine_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "n_paths")
