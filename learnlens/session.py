"""Session-level helpers: the shared scratch folder and size-checked broadcast."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster that setting points at a distributed file system every
    executor sees, and it must be set: a driver-local folder would not be
    visible to the executors. Only a local-mode session without the setting
    (tests) gets a temporary folder, registered as its checkpoint dir.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc is not None else None)
    if not root:
        # A session without a context (Spark Connect) can be on any cluster.
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="learnlens-ckpt-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application: Python workers import what
    their functions name, and only the driver may have it on its path. The archive
    lies in the shared folder, named by its contents, and executors fetch it from there."""
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if package.endswith(".zip") or not os.path.isdir(package):
        return  # it came as an archive itself
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for folder, folders, files in os.walk(package):
            folders.sort()
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    entry = zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(package)))
                    with open(path, "rb") as source:
                        archive.writestr(entry, source.read())
    name = f"{shared_root(spark)}/learnlens/package-{hashlib.sha256(raw.getvalue()).hexdigest()[:16]}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex[:12]}")
        out = fs.create(part, True)
        out.write(raw.getvalue())
        out.close()
        if not fs.rename(part, path):  # another session was first
            fs.delete(part, False)
    sc.addPyFile(str(fs.makeQualified(path)))
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    path = f"{shared_root(spark)}/learnlens/{name}-{uuid.uuid4().hex[:12]}"
    for names in _NAMED:
        names.append(path)
    return path


_NAMED: list[list[str]] = []


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Removes at the end the scratch tables that were named inside. Results must be
    stored elsewhere or collected by then, since they may read these tables."""
    names: list[str] = []
    _NAMED.append(names)
    try:
        yield
    finally:
        _NAMED.pop()  # the blocks close inside out
        for path in names:
            remove_scratch(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage is cut, and a lost
    executor costs a second read instead of a second computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_marks(spark: SparkSession, folder: str) -> list[str]:
    """Name, size and time of the files in a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in found)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named, on the path's own file system."""
    if f"{shared_root(spark)}/learnlens/" not in path:
        raise ValueError(f"not a scratch folder: {path}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def planned_bytes(df: DataFrame) -> int | None:
    """The plan's size statistic: file lengths scaled to the columns read, no
    job. ``None`` where the session does not show it (Spark Connect)."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """Hint a broadcast only when the size statistic proves the side is small.

    Otherwise the plan keeps a shuffle join, which AQE may still convert at
    run time from measured shuffle sizes.
    """
    size = planned_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


# Rows that a task sorts or counts by key, and the partitions below which adaptive execution deals.
TASK_ROWS = 500_000
FEW_PARTITIONS = 4


def partitions_for(rows: int, task_rows: int) -> int | None:
    """Partitions of ``task_rows`` rows each; ``None`` for a few, which adaptive execution may
    deal. It deals by compressed bytes, and so many rows of keys may be a few of these
    that a task's memory would grow with the table; a number given to ``repartition`` holds."""
    n = -(-rows // task_rows)
    return n if n > FEW_PARTITIONS else None


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """Rows dealt by columns, ``TASK_ROWS`` a task; as they are if these are few tasks."""
    n = partitions_for(rows, TASK_ROWS)
    return df.repartition(n, *columns) if n else df


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "learnlens") -> SparkSession:
    """A local session for tests and the bench (the caller owns it on a cluster)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Broadcast only on measured sizes: no static (file-size estimate)
        # broadcast; AQE converts a join once a shuffle stage has measured
        # its side below the adaptive threshold.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "16MB")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
