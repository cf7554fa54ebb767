"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Rows of a lookup that may be sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
# Rows of one piece of work in a Python worker.
PIECE_ROWS = 1_000
BATCH_CONF, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of a session, once.

    Functions that run there are imported by name, also where the package is not installed. Batches
    of rows for them are made smaller than Spark's default, which suits numbers, not whole texts; a session
    that names a size of its own keeps it.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(PIECE_ROWS))
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="lendwell-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "lendwell.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(at, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _SENT.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column with nulls read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast of ``df`` when its counted rows are under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def give_back() -> None:
    """Return what a task has freed to the system: workers are kept for later tasks, and their peak with them."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(frames: Iterable[pd.DataFrame], column: str, most: int, rows: int = PIECE_ROWS) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that each piece holds about ``most`` characters of a text column, and at most ``rows``.

    A single longer text makes a piece of its own.
    """
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy()
        start, held = 0, 0
        for at, size in enumerate(sizes):
            if at > start and (held + size > most or at - start >= rows):
                yield frame.iloc[start:at].reset_index(drop=True)
                start, held = at, 0
            held += size
        if start < len(frame):
            yield frame.iloc[start:].reset_index(drop=True)
    give_back()


class Forest:
    """Groups of values that were joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, value: int) -> int:
        up = self.up
        while (above := up.get(value, value)) != value:
            up[value] = up.get(above, above)
            value = above
        return value

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> pd.DataFrame:
        own = list(self.up)
        return pd.DataFrame({"a": own, "b": [self.root(v) for v in own]}, dtype=np.int64)
