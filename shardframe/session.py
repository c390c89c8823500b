"""Session helpers: a local session for tests and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "shardframe") -> SparkSession:
    """A local session for tests and bench runs; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHARDFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def qualify(spark: SparkSession, path: str) -> str:
    """A path with the scheme and authority that the driver's default filesystem gives it.

    Executors open files by this name, so a bare path on a cluster never means an executor's own disk.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by the cluster in ``spark.checkpoint.dir``.

    A local master has no such folder, so there (and only there) a temporary one stands in.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return qualify(spark, configured)
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="shardframe-")
    context.setCheckpointDir(made)
    return qualify(spark, made)


# Folders made by this driver, deleted when it ends or when asked.
_made: list[str] = []


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, unique across drivers; deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release_shared)
    _made.append(path)
    return path


class _DriverOnly(dict):
    """Tables of the driver, which no task sees."""

    def __reduce__(self):
        return _DriverOnly, ()


# Tables that several queries of a session use, by their key.
_shared: dict[tuple, object] = _DriverOnly()


def shared_once(spark: SparkSession, key: tuple, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once in a session for each key, until the shared folder is released."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def release_shared(spark: SparkSession | None = None) -> int:
    """Delete everything that this driver wrote to the shared folder; results that read it are lost."""
    spark = spark or SparkSession.getActiveSession()
    _shared.clear()
    done = 0
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _made:
            where = jvm.org.apache.hadoop.fs.Path(_made.pop())
            done += where.getFileSystem(conf).delete(where, True)
        return done
    # The session has ended before the driver.
    from shardframe.sources.files import filesystem

    while _made:
        system, inner = filesystem(_made.pop())
        if system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir(inner)
            done += 1
    return done


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from there.

    It survives lost executors, later reads take only the columns they need, and Spark knows its size.
    """
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stable copy of ``df``: a second use sees the same rows."""
    return store(df, "stable")
