"""Reading Parquet rows by their position in their file.

A row is known by (file, row index). A selection over rows is a set of *row vectors*: one 4 KiB bitmap for each block of
32,768 rows of a file, built by Spark's bitmap aggregates. Wide columns are then read by tasks that get a file's vectors and
skip the other rows while decoding, so that no wide row is shuffled or joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 32_768
FILE, ROW = "__sl_file", "__sl_row"


def with_position(df: DataFrame) -> DataFrame:
    """Adds the file (as a 64-bit hash of its path) and the row index to a plain Parquet scan."""
    return df.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def scanned(df: DataFrame) -> bool:
    """Whether ``df`` is a plain Parquet scan, whose rows have a file and a position."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def row_vectors(scan: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per block of ``scan``: path, block, number of rows, bitmap of the rows in ``chosen`` (null if none).

    ``scan`` is a plain Parquet scan, ``chosen`` has the columns FILE and ROW.
    """
    at = F.col(ROW) + 1  # Spark counts bitmap positions from 1
    one = F.when(F.min("path") == F.max("path"), F.min("path")).otherwise(F.raise_error(F.lit("two files share the hash of their paths")))
    blocks = (
        scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias(ROW))
        .groupBy("path", F.floor(F.col(ROW) / BLOCK).alias("block"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .groupBy(F.xxhash64("path").alias(FILE), "block")
        .agg(F.max("n_rows").alias("n_rows"), one.alias("path"))
    )
    bits = chosen.groupBy(F.col(FILE), (F.bitmap_bucket_number(at) - 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
    )
    return blocks.join(bits, [FILE, "block"], "left").select("path", "block", "n_rows", "bitmap")


def locate(uri: str):
    """The pyarrow file system of a path and the path in it."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if parts.scheme else uri
    system, base = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
    return system, base.rstrip("/") + "/" + uri.split(parts.netloc, 1)[1].lstrip("/")


def _open(uri: str):
    """Opens a file by the path Spark gives, in which special characters are percent-encoded."""
    import pyarrow.parquet as pq

    system, path = locate(unquote(uri))
    return pq.ParquetFile(system.open_input_file(path))


def _from_path(path: str, field: pa.Field, n: int) -> pa.Array:
    """A column that a file lacks: the value of a partition folder, else null."""
    m = re.search(f"/{re.escape(field.name)}=([^/]*)/", unquote(path))
    value = None if not m or m[1] == "__HIVE_DEFAULT_PARTITION__" else m[1]
    return pa.array([value] * n, pa.string()).cast(field.type)


def _masked(file, blocks: list[tuple[int, bytes | None]], columns: list[str], invert: bool) -> Iterator[pa.RecordBatch]:
    """The chosen rows of the blocks, which must be sorted; each row group is decoded at most once."""
    wanted = {b: np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[:BLOCK].astype(bool) if bits else np.zeros(BLOCK, bool) for b, bits in blocks}
    start = 0
    for g in range(file.num_row_groups):
        size = file.metadata.row_group(g).num_rows
        first, last = start // BLOCK, (start + size - 1) // BLOCK
        if size and any(b in wanted and (invert or wanted[b].any()) for b in range(first, last + 1)):
            at = start
            for batch in file.iter_batches(8192, row_groups=[g], columns=columns):
                rows = np.arange(at, at + batch.num_rows)
                at += batch.num_rows
                keep = np.zeros(batch.num_rows, bool)
                for b in range(rows[0] // BLOCK, rows[-1] // BLOCK + 1):
                    if b in wanted:
                        here = rows // BLOCK == b
                        bits = wanted[b][rows[here] % BLOCK]
                        keep[here] = ~bits if invert else bits
                if keep.any():
                    yield batch.filter(pa.array(keep))
        start += size


def read_rows(vectors: DataFrame, schema: T.StructType, invert: bool = False, blocks_per_task: int = 64) -> DataFrame:
    """Reads ``schema`` from the files of ``vectors``: the rows in the bitmaps, or with ``invert`` the others.

    A task handles up to ``blocks_per_task`` neighbouring blocks of a file. Files must be readable by path from the executors.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [f.name for f in schema.fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        todo: dict[str, list] = {}
        for batch in batches:
            for path, block, bitmap in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "bitmap"))):
                todo.setdefault(path, []).append((block, bitmap))
        for path, blocks in todo.items():
            file = _open(path)
            there = [c for c in columns if c in file.schema_arrow.names]
            for out in _masked(file, sorted(blocks, key=lambda x: x[0]), there, invert):
                arrays = [out.column(c).cast(target.field(c).type) if c in there else _from_path(path, target.field(c), out.num_rows) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    some = F.coalesce(F.bitmap_count("bitmap"), F.lit(0))
    n_tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        vectors.filter((some < F.col("n_rows")) if invert else (some > 0))
        .select("path", "block", "bitmap")
        .repartition(n_tasks, F.col("path"), F.floor(F.col("block") / blocks_per_task))
        .mapInArrow(read, schema)
    )
