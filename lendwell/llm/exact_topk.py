"""Exact top-k search by inner product with three-phase uniform thresholds.

A vector's components are cut into slices; each slice gives a list of partial scores, and a
score is the sum over slices. Rows are dealt into shards, queries into blocks, and every
(block, shard) pair is one group of bounded size, so no task holds all vectors or all queries.

1. Each group sends, per query and slice, its k best partial scores and its lowest one.
   Merged, they give for every query k candidates whose full score is at least a bound: the
   cutoff. Slices in which a candidate was not listed count with the slice's lowest score.
2. The cutoff goes back to all groups. Measured from each slice's lowest score, a vector whose
   total reaches the cutoff has a slice with at least an even part of it; every other vector is
   left out by its partial scores alone.
3. The remaining slices of what is left are added up exactly; entries that reach the cutoff
   are merged into the k best per query.

Components become ``floor(scale * x)``. Scores are exact: they are computed in doubles while
all sums stay below 2**53, else in Python integers, and held to the range of a long.

Cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors, also empty ones, count as filled up with zeros; rows with the same id are rows of their own
(only the query's own row is left out); a row with a null id is a candidate, after all others of its score;
equal scores go to the smaller id, then to the row read first; fewer than k candidates give fewer ranks; other
columns do not matter; no vectors give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendwell.session import checkpointed

SCALE = 256
SLICES = 4
SHARD_ROWS = 1024
BLOCK_ROWS = 1024
EXACT_DOUBLE = float(2**53)
LONG = np.iinfo(np.int64)

FIRST_SCHEMA = "query_row long, slice int, low double, rows array<long>, scores array<double>"
LAST_SCHEMA = "query_row long, query_id long, vec_id long, nameless boolean, cand_row long, score long"


def whole_components(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, vec_id, parts``: usable vectors with their scaled components as doubles."""
    parts = F.transform(F.col("embedding"), lambda x: x.cast("double") * scale)
    usable = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("parts"))
        .filter(F.col("parts").isNotNull() & usable)
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "parts")
    )


def matrix(parts: pd.Series, width: int) -> np.ndarray:
    """Rows floored and filled up with zeros; whole numbers kept as doubles, which hold large ones too."""
    out = np.zeros((len(parts), width))
    for i, row in enumerate(parts):
        out[i, : len(row)] = row
    return np.floor(out)


def bounds(width: int, slices: int) -> list[tuple[int, int]]:
    cuts = [width * i // slices for i in range(slices + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: doubles where they are exact, else Python integers."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if largest < EXACT_DOUBLE:
        return left @ right.T
    big = np.vectorize(int, otypes=[object])
    return big(left).dot(big(right).T)


def loaded(queries: pd.DataFrame, cands: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query matrix, candidate matrix and the mask of pairs that are one row."""
    own = queries["row"].to_numpy()[:, None] == cands["cand"].to_numpy()[None, :]
    return matrix(queries["parts"], width), matrix(cands["cand_parts"], width), own


def first_lists(k: int, width: int, slices: int):
    """Phase 1 in one group: per query and slice the k best partial scores and the lowest."""

    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_row": [], "slice": [], "low": [], "rows": [], "scores": []}
        if len(queries) and len(cands):
            q, c, own = loaded(queries, cands, width)
            ids = cands["cand"].to_numpy()
            for number, (a, b) in enumerate(bounds(width, slices)):
                part = products(q[:, a:b], c[:, a:b]).astype(float)
                low = part.min(axis=1)
                part[own] = -np.inf
                best = np.argpartition(-part, k - 1, axis=1)[:, :k] if k < part.shape[1] else np.argsort(-part, axis=1)
                for i, row in enumerate(queries["row"]):
                    picked = best[i][np.isfinite(part[i, best[i]])]
                    out["query_row"].append(row)
                    out["slice"].append(number)
                    out["low"].append(low[i])
                    out["rows"].append(ids[picked].tolist())
                    out["scores"].append(part[i, picked].tolist())
        return pd.DataFrame(out)

    return run


def cutoffs(lists: DataFrame, k: int, slices: int) -> DataFrame:
    """Per query the cutoff and each slice's lowest partial score; no cutoff below k candidates."""
    lows = lists.groupBy("query_row", "slice").agg(F.min("low").alias("low"))
    by_query = lows.groupBy("query_row").agg(
        F.map_from_entries(F.collect_list(F.struct("slice", "low"))).alias("lows"), F.sum("low").alias("all_low")
    )
    entries = lists.select("query_row", "slice", F.explode(F.arrays_zip("rows", "scores")).alias("entry")).select(
        "query_row", "slice", F.col("entry.rows").alias("cand"), F.col("entry.scores").alias("score")
    )
    # What a listed candidate has above the slices' lows; at most slices * k * shards rows a query.
    above = (
        entries.join(lows, ["query_row", "slice"])
        .groupBy("query_row", "cand")
        .agg(F.sum(F.col("score") - F.col("low")).alias("above"))
    )
    ranked = Window.partitionBy("query_row").orderBy(F.col("above").desc(), "cand")
    kth = (
        above.withColumn("place", F.row_number().over(ranked))
        .filter(F.col("place") <= k)
        .groupBy("query_row")
        .agg(F.min("above").alias("kth"), F.count(F.lit(1)).alias("found"))
        .filter(F.col("found") == k)
    )
    # Sums of doubles above 2**53 are rounded: leave room for it, as a lower cutoff is always safe.
    slack = F.lit(1e-12) * (F.abs(F.col("kth")) + F.abs(F.col("all_low")))
    return by_query.join(kth, "query_row", "left").select(
        "query_row",
        F.array(*[F.element_at("lows", F.lit(s)) for s in range(slices)]).alias("lows"),
        (F.col("kth") - slack).alias("cutoff"),
    )


def last_entries(k: int, width: int, slices: int):
    """Phases 2 and 3 in one group: entries that pass a slice's part of the cutoff, resolved exactly."""

    def run(queries: pd.DataFrame, cands: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(cands):
            q, c, own = loaded(queries, cands, width)
            cuts = bounds(width, slices)
            ids, rows, nameless = (cands[c].to_numpy() for c in ("cand_id", "cand", "cand_nameless"))
            lows = np.array([list(x)[: len(cuts)] for x in queries["lows"]], dtype=float)
            cutoff = queries["cutoff"].to_numpy(dtype=float)
            bound = np.where(np.isnan(cutoff), -np.inf, cutoff)
            parts = [products(q[:, a:b], c[:, a:b]) for a, b in cuts]
            passed = np.zeros(own.shape, dtype=bool)
            for s, part in enumerate(parts):
                passed |= part.astype(float) - lows[:, s, None] >= (bound / len(cuts))[:, None]
            passed &= ~own
            least = bound + lows.sum(axis=1)
            for i, (row, query) in enumerate(zip(queries["row"], queries["vec_id"])):
                at = np.flatnonzero(passed[i])
                total = parts[0][i, at]
                for part in parts[1:]:
                    total = total + part[i, at]
                if np.isfinite(least[i]):
                    enough = (total >= least[i] - 1).astype(bool)
                    at, total = at[enough], total[enough]
                best = sorted(zip((-total).tolist(), nameless[at].tolist(), ids[at].tolist(), rows[at].tolist()))[:k]
                out.extend(
                    (row, query, vec, none, cand, max(LONG.min, min(LONG.max, int(-score)))) for score, none, vec, cand in best
                )
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "nameless", "cand_row", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, slices: int = SLICES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for every query row of ``vectors``."""
    rows = checkpointed(whole_components(vectors, scale).withColumn("is_query", F.coalesce(is_query, F.lit(False))))
    count, asked, width = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.max(F.size("parts"))).first()
    if not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    slices = min(slices, width)
    shards, blocks = -(-count // SHARD_ROWS), -(-asked // BLOCK_ROWS)
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Names differ between the sides, as both come from the same rows.
    cands = (
        rows.select(
            F.col("row").alias("cand"),
            # A column with nulls would come to Python as doubles.
            F.coalesce("vec_id", F.lit(0)).alias("cand_id"),
            F.col("vec_id").isNull().alias("cand_nameless"),
            F.col("parts").alias("cand_parts"),
            number("row", shards).alias("cand_shard"),
        )
        .withColumn("cand_block", all_of(blocks))
        .groupBy("cand_block", "cand_shard")
    )
    queries = rows.filter("is_query").select(
        "row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "parts", number("row", blocks).alias("block")
    )

    def everywhere(side: DataFrame):
        return side.withColumn("shard", all_of(shards)).groupBy("block", "shard")

    lists = checkpointed(
        everywhere(queries).cogroup(cands).applyInPandas(first_lists(k, width, slices), FIRST_SCHEMA)
    )
    limits = cutoffs(lists, k, slices).withColumnRenamed("query_row", "row")
    entries = (
        everywhere(queries.join(limits, "row"))
        .cogroup(cands)
        .applyInPandas(last_entries(k, width, slices), LAST_SCHEMA)
    )
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "nameless", "vec_id", "cand_row")
    return (
        entries.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.when(~F.col("nameless"), F.col("vec_id")).alias("vec_id"), "score")
    )
