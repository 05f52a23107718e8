"""Session building, the shared working folder and staging of intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders below the shared one that this driver made.
_FOLDERS: list[str] = []


def build_session(app: str = "silverloom", cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="silverloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by ``clear_staged`` or when the driver ends."""
    path = f"{shared_folder(spark)}/silverloom/{label}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def clear_staged(spark: SparkSession) -> None:
    """Removes all folders made so far; results that still read them must have been written elsewhere."""
    while _FOLDERS:
        remove_folder(spark, _FOLDERS.pop())


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _FOLDERS else None
    if spark is not None:
        clear_staged(spark)


def remove_folder(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may already be gone
        pass


def staged(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so that lost executors lose no work."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marks a table of narrow rows for broadcast if it has at most ``rows``; a larger one is joined by a shuffle. Counts it, so it should be cheap to compute."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bucketed(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """As ``staged``, in ``n`` hash buckets of a key: a join on the key shuffles the other side only."""
    spark = df.sparkSession
    path, name = new_folder(spark, label), f"silverloom_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever the driver found it. Once per application."""
    context = spark.sparkContext
    if getattr(context, "_silverloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="silverloom-code-"), "silverloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("silverloom", os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._silverloom_shipped = True
