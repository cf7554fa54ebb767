"""Approximate distinct counts, as an option: sketches of fixed size that can be stored and merged.

A sketch of 2 ** ``SIZE`` registers is off by about 0.8 % (one standard deviation), for any number of ids, and merging
loses nothing more. Nulls are not counted. Exact counts are the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 14
# Three standard deviations of a merged sketch
ERROR = 3 * 1.04 / 2 ** (SIZE / 2)


def sketch(column: Column | str) -> Column:
    """Aggregate: a sketch of the different values of a whole-number or text column."""
    return F.hll_sketch_agg(column, F.lit(SIZE))


def sketched(merged: Column) -> Column:
    """The number of different values in a sketch, 0 where there is none."""
    return F.coalesce(F.hll_sketch_estimate(merged), F.lit(0)).cast("bigint")


def distinct_count(column: str, approx: bool = False) -> Column:
    """Aggregate: different values of a column, exactly or by a sketch."""
    return sketched(sketch(column)) if approx else F.count_distinct(column)


def daily_sketches(rows: DataFrame, day: Column, column: str) -> DataFrame:
    """``day, ids``: one sketch a day, to be stored; the rows are not needed again."""
    return rows.groupBy(day.alias("day")).agg(sketch(column).alias("ids"))


def distinct_between(sketches: DataFrame, first, last) -> DataFrame:
    """``ids``: different values from ``first`` to ``last``, both included, from stored sketches of days."""
    inside = sketches.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return inside.agg(sketched(F.hll_union_agg("ids")).alias("ids"))
