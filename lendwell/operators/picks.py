"""Latest or largest rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of every key under ``order``.

    The filter on the rank lets Spark cut every key to ``n`` rows per task
    before the shuffle, so a hot key never travels whole.
    """
    name = rank or "key_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    picked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return picked if rank else picked.drop(name)
