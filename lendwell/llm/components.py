"""Connected components of an edge table by alternating large and small stars.

Every round points each vertex's larger (then smaller) neighbours at the least vertex around
it; the number of edges never grows, and rounds stay few for long chains too. Stars are formed
by a partial aggregate and a join, so a vertex may have any number of neighbours. Before the first
round, every task merges the edges that it already holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import Forest
from lendwell.session import checkpointed


def merged(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's edges as stars around the least vertices."""
    forest = Forest()
    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            forest.join(a, b)
    yield forest.edges()


def large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b: every larger neighbour of a vertex to the least vertex around it."""
    up = edges.select(F.col("b").alias("v"), F.col("a").alias("w"))
    around = up.union(edges.select(F.col("a").alias("v"), F.col("b").alias("w")))
    least = around.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
    return up.join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    pointed = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.union(least.select("a", F.col("m").alias("b"))).distinct()


def written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and hash."""
    kept = checkpointed(edges)
    return kept, tuple(kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` for the vertices of ``edges`` (a, b) that are not the least of their component."""
    current, before = written(edges.filter("a <> b").select("a", "b").mapInPandas(merged, "a long, b long").distinct())
    while before[0]:
        current, after = written(small_star(large_star(current)))
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
