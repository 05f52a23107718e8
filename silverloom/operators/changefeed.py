"""Applying a stream of inserts, updates and deletes to a bucketed copy-on-write table.

``FileTable`` keeps the newest state of every key (machine, path) in Parquet files of one hash bucket each, and a manifest that names
the files of each bucket. A batch of changes is cut down to the last effective change of each key while it is still narrow
(key, moment, event, position in the file); only the rows that won are read whole and routed, once, to the task of their bucket. There they are sort-merged
with the bucket's base files, which the task opens itself, so that base rows are never shuffled; the new files are written beside the old ones and a new manifest makes them
current. Buckets without changes keep their files. Deleted keys stay as rows without content that carry the moment of the deletion, so that a late older
change of a later batch cannot bring them back.

Buckets grow by linear hashing: when the table holds more than ``BUCKET_BYTES`` (as in memory) a bucket, the next batch also splits as many buckets as are missing, each
into itself and one new bucket.

Defined cases: event types ignore case and blanks, unknown ones change nothing; moments in milli-, micro- or nanoseconds are cut to
seconds by their size; a CREATE or MODIFY without content changes nothing; RENAME ends ``path`` and ``old_path``; repeated
deliveries of an event are one event, of which the row standing first counts; a null path is skipped; a null moment
comes before all others, a null machine is a machine of its own; an empty feed leaves the table as it is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverloom.functions.text import nfc
from silverloom.session import remove_folder
from silverloom.sources.positions import FILE, ROW, locate, read_rows, row_vectors, with_position

KEY = ["machine_id", "path"]
BUCKET_BYTES = 256 << 20
BUCKET, BASE = "__sl_bucket", "__sl_base"
STATE = "machine_id string, path string, sec long, event_id long, live boolean, project string, content_hash string, content string, h long"


def whole_seconds(t: Column) -> Column:
    """Moments as whole seconds, whatever unit (s, ms, us, ns) the watcher wrote."""
    size = F.abs(t)
    unit = F.when(size >= 10**17, 10**9).when(size >= 10**14, 10**6).when(size >= 10**11, 10**3).otherwise(1).cast("long")
    return ((t - F.pmod(t, unit)) / unit).cast("long")  # exact, as the dividend is a multiple of the unit


def effective_changes(events: DataFrame) -> DataFrame:
    """Narrow rows (machine_id, path, sec, event_id, live, FILE, ROW) of the changes that matter; a RENAME gives two."""
    kind = F.upper(F.trim("event_type"))
    live = kind.isin("CREATE", "MODIFY")
    return (
        events.select(
            "machine_id", nfc(F.col("path")).alias("path"), nfc(F.when(kind == "RENAME", F.col("old_path"))).alias("old_path"), kind.alias("kind"),
            whole_seconds(F.col("timestamp_seconds")).alias("sec"), "event_id", F.col("content").isNotNull().alias("full"), FILE, ROW,
        )
        .filter(F.col("kind").isin("DELETE", "RENAME") | (F.col("kind").isin("CREATE", "MODIFY") & F.col("full")))
        .select("machine_id", F.explode(F.array_distinct(F.array_compact(F.array("path", "old_path")))).alias("path"), "sec", "event_id", F.col("kind").isin("CREATE", "MODIFY").alias("live"), FILE, ROW)
    )


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each key; combined before the shuffle, so that a hot key costs one row per task."""
    newest = F.max(F.struct("sec", "event_id", F.col("live"), (-F.col(ROW)).alias("r"), F.col(FILE).alias("f"))).alias("m")
    return changes.groupBy(*KEY).agg(newest).select(*KEY, "m.sec", "m.event_id", "m.live", F.col("m.f").alias(FILE), (-F.col("m.r")).alias(ROW))


def bucket_of(h, n: int):
    """The bucket of a hash among n, by linear hashing; for a column, an array or a number."""
    low = 1 << (n.bit_length() - 1)  # the largest power of two up to n
    wide, narrow = 2 * low - 1, low - 1
    if isinstance(h, Column):
        w = h.bitwiseAND(F.lit(wide).cast("long"))
        return F.when(w < n, w).otherwise(h.bitwiseAND(F.lit(narrow).cast("long")))
    return np.where((h & wide) < n, h & wide, h & narrow)


def merged(base: list[pa.Table], arrivals: pa.Table) -> pa.Table:
    """The newest row of each key, sorted by key. A base row stays if an arrival is the same change again."""
    import pyarrow.compute as pc

    rows = pa.concat_tables([arrivals, *(b.select(arrivals.column_names).cast(arrivals.schema) for b in base)])
    order = pc.sort_indices(rows.select([*KEY, "sec", "event_id"]), sort_keys=[(c, "ascending") for c in (*KEY, "sec", "event_id")], null_placement="at_start").to_numpy()
    codes = [rows.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()[order] for c in KEY]
    last = np.ones(len(order), bool)
    last[:-1] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
    return rows.take(pa.array(order[last]))


class FileTable:
    """A keyed table of bucket files under ``root``, changed only by new manifests.

    ``buckets`` is the number to begin with: given, or four per 256 MB of the first feed, 16 at least.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        there = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest that is finished, or that of a version: {"version", "buckets", "files": {bucket: [path, ...]}, "bytes": {bucket: size}}."""
        for name in reversed(self._list("manifests")):
            if version is not None and int(name[1:-5]) > version:
                continue
            stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            except ValueError:  # its writer is still at it, or died
                continue
            finally:
                stream.close()
        return {"version": 0, "buckets": self.buckets, "files": {}, "bytes": {}}

    def _commit(self, manifest: dict) -> None:
        """Creates the manifest of a version, which only one writer can; readers skip it until it is whole."""
        try:
            out = self._fs.create(self._path(f"{self.root}/manifests/v{manifest['version']:08d}.json"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"version {manifest['version']} was committed by another writer") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def current(self, version: int | None = None) -> DataFrame:
        """The rows that exist, with the event that gave their content."""
        files = [f for fs in self.manifest(version)["files"].values() for f in fs]
        rows = self.spark.read.schema(STATE).parquet(*files) if files else self.spark.createDataFrame([], STATE)
        return rows.filter("live").drop("live", "h")

    def apply(self, scan: DataFrame, where: Column | None = None) -> int:
        """Applies a feed (a plain Parquet scan of file events), or those of its rows for which ``where`` holds, and returns the new version."""
        manifest = self.manifest()
        first = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if not manifest["buckets"] else 0
        old = manifest["buckets"] or max(16, 4 * first // BUCKET_BYTES)
        new = max(old, -(-sum(manifest["bytes"].values()) // BUCKET_BYTES))
        rows = with_position(scan)
        last = last_changes(effective_changes(rows if where is None else rows.filter(where))).withColumn("h", F.xxhash64(*KEY)).persist()
        try:
            touched = {r[0] for r in last.select(bucket_of(F.col("h"), old)).distinct().collect()}  # at most as many as there are buckets
            if not touched:
                return manifest["version"]
            touched |= set(bucket_of(np.arange(old, new), old).tolist())  # those that are split
            version = max([int(n[1:-5]) for n in self._list("manifests")], default=0) + 1
            folder = f"{self.root}/data/v{version:08d}-{uuid.uuid4().hex}"
            done = self._rewritten(scan, last, manifest, touched, old, new, folder).collect()  # a row per new file
        finally:
            last.unpersist()
        files = {b: fs for b, fs in manifest["files"].items() if int(b) not in touched}
        sizes = {b: n for b, n in manifest["bytes"].items() if int(b) not in touched}
        for bucket, path, size in done:
            files.setdefault(str(bucket), []).append(path)
            sizes[str(bucket)] = sizes.get(str(bucket), 0) + size
        self._commit({"version": version, "buckets": new, "files": files, "bytes": sizes})
        return version

    def _rewritten(self, scan: DataFrame, last: DataFrame, manifest: dict, touched: set[int], old: int, new: int, folder: str) -> DataFrame:
        """Writes the new files of the touched buckets: (bucket, path, bytes). A task that runs twice leaves files that no manifest names."""
        names = ["machine_id", "path", "sec", "event_id", "live", "project", "content_hash", "content", "h"]
        wide = read_rows(row_vectors(scan, last.filter("live").select(FILE, ROW)), scan.select("machine_id", "path", "timestamp_seconds", "event_id", "project", "content_hash", "content").schema)
        arrivals = wide.select("machine_id", nfc(F.col("path")).alias("path"), whole_seconds(F.col("timestamp_seconds")).alias("sec"), "event_id", F.lit(True).alias("live"), "project", "content_hash", "content")
        none = F.lit(None).cast("string")
        endings = last.filter("not live").select("machine_id", "path", "sec", "event_id", "live", none.alias("project"), none.alias("content_hash"), none.alias("content"))
        changes = arrivals.unionByName(endings).withColumn("h", F.xxhash64(*KEY)).withColumns({BUCKET: bucket_of(F.col("h"), old), BASE: none})
        # a leading row for each bucket tells its task the base files
        heads = self.spark.createDataFrame([(b, json.dumps(manifest["files"].get(str(b), []))) for b in sorted(touched)], f"{BUCKET} long, {BASE} string")
        heads = heads.select(*[F.lit(None).cast(t).alias(c) for c, t in changes.dtypes if c not in (BUCKET, BASE)], BUCKET, BASE)
        todo = changes.unionByName(heads).repartition(min(len(touched), max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), len(touched) // 64)), BUCKET)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq

            def merge(bucket: int, parts: list[pa.RecordBatch]) -> Iterator[tuple[int, str, int]]:
                together = pa.Table.from_batches(parts)
                lead = together.filter(together.column(BASE).is_valid()).column(BASE).to_pylist()
                base = []
                for path in json.loads(lead[0]) if lead else []:
                    system, at = locate(path)
                    base.append(pq.read_table(system.open_input_file(at)))
                rows = merged(base, together.filter(together.column(BASE).is_null()).select(names))
                to = bucket_of(rows.column("h").to_numpy(), new)
                for b in np.unique(to).tolist():
                    mine = rows.filter(pa.array(to == b))
                    path = f"{folder}/b{b:08d}-{uuid.uuid4().hex}.parquet"
                    system, at = locate(path)
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(at) as out:
                        pq.write_table(mine, out, compression="zstd")
                    yield b, path, mine.nbytes

            def given(found: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["bucket", "path", "bytes"])

            bucket, parts = None, []
            for batch in batches:
                ids = np.asarray(batch.column(BUCKET))
                borders = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
                for a, b in zip(borders, borders[1:]):
                    if ids[a] != bucket and parts:
                        yield given(list(merge(bucket, parts)))
                        parts = []
                    bucket = int(ids[a])
                    parts.append(batch.slice(a, b - a))
            if parts:
                yield given(list(merge(bucket, parts)))

        return todo.sortWithinPartitions(BUCKET).mapInArrow(run, "bucket long, path string, bytes long")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests but for the newest ``keep`` versions, and all files that only they name; returns how many folders went."""
        names = self._list("manifests")
        kept = [self.manifest(int(n[1:-5])) for n in names[-keep:]]
        used = {f.rsplit("/", 2)[1] for m in kept for fs in m["files"].values() for f in fs}
        newest = max([m["version"] for m in kept], default=0)
        for name in names[:-keep]:
            remove_folder(self.spark, f"{self.root}/manifests/{name}")
        gone = [d for d in self._list("data") if d not in used and int(d[1:9]) <= newest]  # younger ones belong to a writer that has not committed yet
        for d in gone:
            remove_folder(self.spark, f"{self.root}/data/{d}")
        return len(gone)
