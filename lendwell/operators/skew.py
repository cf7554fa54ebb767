"""Equi-joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "salt"
ROWS_PER_TASK = 1_000_000
MOST_HOT_KEYS = 10_000


def hot_keys(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """Keys with more rows than one task should take, and how many parts to cut them in.

    A hot key also has more than one row in ``MOST_HOT_KEYS`` of all, so that at most so many come
    out, whatever the size; keys below that share are left to adaptive execution.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows"))
    # The largest key and all rows come from one pass; keys are looked at again only if one is hot.
    most, total = counts.agg(F.max("key_rows"), F.sum("key_rows")).first()
    least = max(rows_per_task, (total or 0) // MOST_HOT_KEYS)
    found = counts.filter(F.col("key_rows") > least) if (most or 0) > least else counts.limit(0)
    return found.select(
        F.col(key).alias("hot_key"),
        F.ceil(F.col("key_rows") / rows_per_task).cast("int").alias("parts"),
    )


def spread_join(
    left: DataFrame,
    lookups: list[DataFrame],
    key: str,
    row_id: str,
    how: str = "left",
    rows_per_task: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with each lookup on ``key``, cutting hot keys of ``left`` into parts.

    Keys are counted first, by a job of its own, unless the caller passes ``hot`` with what
    ``hot_keys`` found in the same frame, as for several queries over one table. Without a hot key the joins are plain ones. Otherwise rows
    of a hot key are dealt over its parts by ``row_id`` and lookup rows of that key are
    copied once per part; all joins share one partitioning of ``left``. Null keys are
    dealt out too, although they match nothing.
    """
    counted = hot_keys(left, key, rows_per_task) if hot is None else hot
    # A plan that is known to be empty runs no job.
    hot_rows = counted.collect()
    lookups = [lookup.filter(F.col(key).isNotNull()) for lookup in lookups]
    if not hot_rows:
        for lookup in lookups:
            left = left.join(lookup, key, how)
        return left
    hot = F.broadcast(left.sparkSession.createDataFrame(hot_rows, counted.schema))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col(key).eqNullSafe(F.col("hot_key")), "left").drop("hot_key")

    dealt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(row_id), F.col("parts")))
    joined = with_parts(left).withColumn(SALT, F.coalesce(dealt, F.lit(0)).cast("int")).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    for lookup in lookups:
        copied = with_parts(lookup).withColumn(SALT, copies).drop("parts")
        joined = joined.join(copied, [key, SALT], how)
    return joined.drop(SALT)


def by_rows(df: DataFrame, keys: list[str], rows: int, rows_per_task: int) -> DataFrame:
    """Deal rows over tasks by their number, for work that costs the same for every row, however few bytes it has.

    At least as many tasks as there are cores. ``keys`` tell rows apart, so that a repeated task has the same ones.
    """
    least = min(df.sparkSession.sparkContext.defaultParallelism, max(rows, 1))
    return df.repartition(max(least, -(-rows // rows_per_task)), *keys)
