"""Session helpers: a local session for tests/bench, the shared scratch
folder (``spark.checkpoint.dir``) for lineage cuts and round-trip files, and
shipping of this package to the executors."""
from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "quillmask") -> SparkSession:
    """Session for tests and the bench.  On a cluster, use the cluster's own
    session; nothing in the library depends on these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the tables of tests and benches have one row group each
    spark.conf.set("quillmask.spreadPartitions", str(partitions))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.  Only a local master
    may fall back to a temporary folder (tests, bench); on a cluster that
    folder would be a different one on every machine, so it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quillmask-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes, _write_lock = {}, threading.Lock()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """While a table is written, whose plan nothing else runs: its shuffle files
    go when it is there, not when the driver happens to collect its garbage."""
    with _write_lock:
        open_, before = _writes.get(spark, (0, None))
        before = before if open_ else spark.conf.get(CLEANUP, "false")
        _writes[spark] = (open_ + 1, before)
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _write_lock:
            open_, before = _writes.pop(spark)
            if open_ > 1:
                _writes[spark] = (open_ - 1, before)
            else:
                spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: a lineage
    cut like a checkpoint, but compressed and by column, so tokens and sentences
    take about the room of their text."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(StructType([StructField(f.name, f.dataType) for f in df.schema.fields])).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per context): the
    functions that run inside tasks are pickled by module name, and the
    repository may be on the driver's ``sys.path`` only."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmask_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="quillmask-ship-"), "quillmask_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(PACKAGE_DIR):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE_DIR)))
    sc.addPyFile(target)
    sc._quillmask_shipped = True
