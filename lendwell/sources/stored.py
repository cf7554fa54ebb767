"""Tables kept between runs: a folder per day, rows in buckets of a key, days replaced one by one.

A table is known by its path. Its layout (key, day column, buckets, whether a key is hot) lies in
``_layout`` below the path, so that any session can open it again under the same buckets. Joins and
groupings by the key then read buckets in place, without an exchange of the table.

A task reads a bucket as a whole. Where one key has more rows than a task should take, the table is
read by files instead: the exchange comes back, and with it Spark's splitting of skewed joins.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendwell.operators.skew import hot_keys

BUCKETS = 8
LAYOUT = "key string, day string, buckets int, hot boolean"
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Layout:
    key: str
    day: str
    buckets: int
    hot: bool


def layout_of(spark: SparkSession, path: str) -> Layout | None:
    """How the table at ``path`` is stored; None where there is none."""
    try:
        row = spark.read.schema(LAYOUT).json(f"{path}/_layout").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else Layout(**row.asDict())


def table_name(path: str) -> str:
    return f"stored_{hashlib.md5(path.encode()).hexdigest()[:20]}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def opened(spark: SparkSession, path: str, layout: Layout, schema: str | None = None) -> str:
    """Name of the catalog table over ``path``; a session that does not know it yet learns its days."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        known = schema is None
        if known:
            found = spark.read.parquet(path).schema
            schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in found)
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY ({quoted(layout.day)}) "
            f"CLUSTERED BY ({quoted(layout.key)}) SORTED BY ({quoted(layout.key)}) INTO {layout.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )
        if known:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


@contextmanager
def days_replaced(spark: SparkSession) -> Iterator[None]:
    """Overwriting replaces the days that are written, and no others."""
    before = spark.conf.get(OVERWRITE_MODE)
    spark.conf.set(OVERWRITE_MODE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE_MODE, before)


def replace_days(
    df: DataFrame, path: str, key: str, day: str, buckets: int = BUCKETS, rows_per_task: int | None = None
) -> None:
    """Store the rows of ``df``; days that it holds are replaced, others are not touched.

    Every day has a file per bucket. Rows of hot keys are dealt over several tasks and so have several.
    """
    spark = df.sparkSession
    stored = layout_of(spark, path)
    if stored is not None and (stored.key, stored.day) != (key, day):
        raise ValueError(f"{path} is stored by {stored.key} and {stored.day}")
    buckets = stored.buckets if stored is not None else buckets
    hot = hot_keys(df, key, rows_per_task).collect()
    layout = Layout(key, day, buckets, bool(hot) or (stored is not None and stored.hot))
    columns = [*(c for c in df.columns if c != day), day]
    rows = df.select(*[F.col(quoted(c)) for c in columns])
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema)
    name = opened(spark, path, layout, schema if stored is None else None)
    if hot:
        parts = F.broadcast(spark.createDataFrame(hot, "hot_key " + df.schema[key].dataType.simpleString() + ", parts int"))
        marked = rows.join(parts, F.col(quoted(key)).eqNullSafe(F.col("hot_key")), "left")
        salt = F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in columns]), F.coalesce("parts", F.lit(1)))
        rows = marked.withColumn("stored_salt", salt).repartition(buckets, key, "stored_salt").select(*[F.col(quoted(c)) for c in columns])
    else:
        rows = rows.repartition(buckets, key)
    with days_replaced(spark):
        rows.write.insertInto(name, overwrite=True)
    if stored != layout:
        row = spark.createDataFrame([(layout.key, layout.day, layout.buckets, layout.hot)], LAYOUT)
        row.coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def days(spark: SparkSession, path: str) -> list[dt.date]:
    """The stored days, rising."""
    layout = layout_of(spark, path)
    if layout is None:
        return []
    found = spark.sql(f"SHOW PARTITIONS {opened(spark, path, layout)}").collect()
    return sorted(dt.date.fromisoformat(r["partition"].split("=", 1)[1]) for r in found)


def read_stored(spark: SparkSession, path: str, by_key: bool = True) -> DataFrame:
    """All stored days. ``by_key`` reads buckets in place; otherwise files are split by size, for work on rows."""
    layout = layout_of(spark, path)
    if layout is None:
        raise ValueError(f"no stored table at {path}")
    name = opened(spark, path, layout)
    if by_key and not layout.hot:
        return spark.table(name)
    return spark.read.schema(spark.table(name).schema).parquet(path)


def newest_day(spark: SparkSession, path: str, by_key: bool = True, upto: dt.date | None = None) -> DataFrame:
    """Rows of the newest stored day, or of the newest one up to a day; without the day's column."""
    stored = [d for d in days(spark, path) if upto is None or d <= upto]
    frame = read_stored(spark, path, by_key)
    column = layout_of(spark, path).day
    return frame.filter(F.col(column) == F.lit(stored[-1] if stored else None).cast("date")).drop(column)
