"""Session defaults, the shared working folder and the reporting date."""

from __future__ import annotations

import datetime as dt
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "lendwell", cpus: int | None = None) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the caller of every column expression costs more than small plans do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local-mode session without the setting gets a folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="lendwell-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder that nothing reads any more."""
    if not path.startswith(shared_folder(spark).rstrip("/") + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of steps whose results are written.

    It removes them when the driver collects its garbage, which may be long after they are last used.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Folders of the steps that are under way, the innermost last.
_STEPS: list[str] = []


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[str]:
    """A scratch folder for steps whose written rows and checkpoints nothing reads afterwards; it is removed at the end."""
    folder = scratch_path(spark, name)
    context = spark.sparkContext
    _STEPS.append(folder)
    context.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        _STEPS.remove(folder)
        context.setCheckpointDir(_STEPS[-1] if _STEPS else shared_folder(spark))
        remove(spark, folder)
        release(spark)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table, which is compressed and can be removed, and go on from the written copy."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def day(as_of: dt.date | None) -> Column:
    """The reporting date as a foldable column, today when none is given."""
    return F.current_date() if as_of is None else F.lit(as_of)


def days_before(as_of: dt.date | None, days: int) -> Column:
    return F.date_sub(day(as_of), days)


def months_before(as_of: dt.date | None, months: int) -> Column:
    return F.add_months(day(as_of), -months)
