"""Embedding whitening: QR by blocks of rows, bidiagonal form, quotient-difference values, twisted vectors.

1. Entries become whole numbers, floor(64 c) + 1000000; a first scan counts the vectors and sums every
   dimension exactly.
2. Rows are centred as n x - S, a whole number, before they are divided by n. Every task folds its rows
   into a triangular factor block by block (QR); factors of ``FAN`` tasks are stacked and factored again
   in a shuffle, until one is left, of dimension by dimension. Its product with its transpose is n times
   the covariance, without the covariance ever being formed.
3. The driver reduces that small factor to bidiagonal form and finds singular values and right vectors
   (``bidiagonal``). Values whose root is below ``LEAST`` of the largest are none: nothing varies there.
4. A scan sums the products of whitened rows (components by components) for the error of their
   covariance, and a last one returns a row for every vector and component.

Cases: null vectors, empty ones, and those with a null or non-finite entry, or one beyond 2 ** 42, take
no part; nor do vectors of another length than the most frequent one (the longest of several). Repeated
rows and ids count and return each; null ids too. If fewer dimensions vary than components are asked
for, only those are returned, so that equal vectors, or a single one, return no rows; nor does an empty
table. Equal variances (ties) get any vectors at right angles, the same for all rows. A deviation beyond
the range of a long is null. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.llm.bidiagonal import right_vectors

COMPONENTS = 32
# Scale and offset of the whole numbers.
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = 2.0**42
# Factors that are stacked at once, bytes of rows folded at once.
FAN, BLOCK_BYTES = 8, 4 << 20
LEAST = 1e-10
MOST = 2**63


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, but for their length."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return own.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fine, F.lit(False)))


def blocks(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with floor(64 c) of their vectors as rows of whole numbers."""
    rows = max(1, BLOCK_BYTES // (8 * dimension))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            piece = batch.slice(start, rows)
            flat = piece["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield piece, np.floor(flat * SCALE).astype(np.int64).reshape(piece.num_rows, dimension)


def summed(dimension: int):
    """Sums of every dimension, and the number and the largest size of the entries, per block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.array(np.arange(dimension, dtype=np.int32))
        for piece, x in blocks(batches, dimension):
            if len(x):
                most = int(np.abs(x).max())
                yield pa.RecordBatch.from_arrays(
                    [place, pa.array(x.sum(axis=0)), pa.array([len(x)] * dimension, pa.int64()), pa.array([most] * dimension, pa.int64())],
                    names=["place", "total", "n", "most"],
                )

    return run


@dataclass(frozen=True)
class Fit:
    """What the fit list has: its size, its sums of floor(64 c), and the largest entry."""

    n: int
    sums: tuple[int, ...]
    most: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python's whole numbers where 64 bits do not do."""
        if 2 * self.most * self.n < MOST:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def squares(self, x: np.ndarray) -> pa.Array:
        """Sums over the dimensions of (n x - S) squared; null where a long does not hold them."""
        d = self.deviations(x)
        if len(self.sums) * (2 * self.most * self.n) ** 2 < MOST:
            return pa.array((d * d).sum(axis=1))
        exact = d.astype(object)
        return pa.array([v if v < MOST else None for v in (exact * exact).sum(axis=1)], pa.int64())


def padded(r: np.ndarray, dimension: int) -> np.ndarray:
    out = np.zeros((dimension, dimension))
    out[: len(r)] = r
    return out


def factored(fit: Fit):
    """All rows of a task to one triangular factor."""
    dimension = len(fit.sums)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for _, x in blocks(batches, dimension):
            r = np.linalg.qr(np.vstack([r, fit.centred(x)]), mode="r")
        if len(r):
            values = pa.array(padded(r, dimension).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=["r"])

    return run


def stacked(frame: pd.DataFrame) -> pd.DataFrame:
    """A few factors to one. Their order is fixed, so that a repeated task has the same result."""
    frame = frame.sort_values("part")
    size = int(round(len(frame["r"].iloc[0]) ** 0.5))
    r = np.zeros((0, size))
    for values in frame["r"]:
        r = np.linalg.qr(np.vstack([r, np.asarray(values).reshape(size, size)]), mode="r")
    return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // FAN], "r": [padded(r, size).ravel().tolist()]})


def factor(rows: DataFrame, fit: Fit) -> np.ndarray:
    """The triangular factor of all centred rows."""
    parts = rows.rdd.getNumPartitions()
    factors = rows.mapInArrow(factored(fit), "r array<double>").select(F.spark_partition_id().cast("long").alias("part"), "r")
    while parts > 1:
        factors = factors.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(stacked, "part long, r array<double>")
        parts = -(-parts // FAN)
    dimension = len(fit.sums)
    found = [np.array(r["r"]).reshape(dimension, dimension) for r in factors.sort("part").collect()]
    return padded(np.linalg.qr(np.vstack(found), mode="r"), dimension) if len(found) > 1 else found[0]


@dataclass(frozen=True)
class Whitening:
    fit: Fit
    directions: np.ndarray  # unit eigenvectors of the covariance as columns
    variances: np.ndarray  # falling
    explained: np.ndarray  # shares of the trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ (self.directions / np.sqrt(self.variances))


def fitted(rows: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """Directions and variances of all rows; None if nothing varies."""
    sums = (
        rows.mapInArrow(summed(dimension), "place int, total long, n long, most long")
        .groupBy("place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.max("most").alias("most"))
        .sort("place")
        .collect()
    )
    if not sums:
        return None
    fit = Fit(int(sums[0]["n"]), tuple(int(r["total"]) for r in sums), max(int(r["most"]) for r in sums))
    squares, directions, total = right_vectors(factor(rows, fit), components)
    kept = int((np.sqrt(squares) > LEAST * np.sqrt(squares[0])).sum()) if len(squares) else 0
    if not kept:
        return None
    return Whitening(fit, directions[:, :kept], squares[:kept] / fit.n, squares[:kept] / total)


def products(model: Whitening):
    """Sums of products of whitened components over a task's rows, and of the components themselves."""
    count = model.directions.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for _, x in blocks(batches, len(model.fit.sums)):
            w = model.apply(x)
            total[:count] += w.T @ w
            total[count] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["place", "total"]
        )

    return run


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    count, n = model.directions.shape[1], model.fit.n
    sums = rows.mapInArrow(products(model), "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    table = np.zeros((count + 1) * count)
    for row in sums.collect():
        table[row["place"]] = row["total"]
    table = table.reshape(count + 1, count)
    mean = table[count] / n
    return float(np.abs(table[:count] / n - np.outer(mean, mean) - np.eye(count)).max())


def whitener(model: Whitening, error: float):
    count = model.directions.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in blocks(batches, len(model.fit.sums)):
            rows = np.repeat(np.arange(len(x)), count)
            number = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    piece["vec_id"].take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(number, model.fit.n)),
                    model.fit.squares(x).take(pa.array(rows)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(number, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for every vector that takes part and every component; see the module."""
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("length")).count()
    usual = lengths.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    model = None
    if usual is not None:
        rows = rows.filter(F.size("embedding") == usual["length"])
        model = fitted(rows, usual["length"], components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(whitener(model, identity_error(rows, model)), RESULT)
