import math

import numpy as np
import pytest

from lendwell.llm import bidiagonal as b
from lendwell.llm import whitening as w
from lendwell.llm.common import table

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def matrices():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    single = np.zeros((5, 5))
    single[0, 0] = 3
    yield from (np.triu(rng.standard_normal((n, n))) for n in (1, 2, 3, 17, 64))
    yield from (np.eye(12), q, single, rng.standard_normal((30, 3)) @ rng.standard_normal((3, 30)))
    yield q @ np.diag([1.0] * 20 + [2.0] * 20) @ q.T
    yield q @ np.diag(1 + 1e-9 * np.arange(40)) @ q.T
    yield q @ np.diag(1 + 1e-5 * np.arange(40)) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(0, 10, 0.25)) @ q.T
    yield 1e-100 * np.triu(rng.standard_normal((9, 9)))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_values_and_vectors(matrix):
    squares, vectors, total = b.right_vectors(matrix, len(matrix))
    want = np.linalg.svd(matrix, compute_uv=False)
    assert np.abs(np.sqrt(squares) - want).max() <= 1e-14 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-11
    scaled = matrix / want[0]
    assert np.abs(scaled.T @ (scaled @ vectors) - vectors * (squares / want[0] / want[0])).max() < 1e-13
    assert total == pytest.approx((want**2).sum(), rel=1e-12)


def test_small_values_to_their_last_digits():
    """A graded bidiagonal matrix keeps relative accuracy, as sums of squares and roots would not."""
    diagonal, upper = 10.0 ** -np.arange(0, 24, 3.0), 10.0 ** -np.arange(1, 22, 3.0)
    got = b.squared_values(diagonal, upper)
    assert math.prod(got.tolist()) == pytest.approx(math.prod((diagonal**2).tolist()), rel=1e-13)


def by_hand(rows, components=32):
    """Covariance, eigenvectors and whitened rows with numpy alone."""
    x = np.floor(np.array([v for _, v in rows]) * 64.0).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = (n * x - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    whitened = centred @ vectors[:, order] / np.sqrt(values[order])
    return n, deviation, whitened, values[order] / values.sum()


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.5, 3) for r in rows], "vec_id long, embedding array<float>, r double, n int")


def checked(got, rows, components=32):
    assert got.columns == COLUMNS
    n, deviation, whitened, explained = by_hand(rows, components)
    found = got.toPandas()
    assert len(found) == whitened.size and (found["n"] == n).all() and (found["identity_error"] < 1e-9).all()
    assert found["identity_error"].nunique() == 1
    for component in range(1, whitened.shape[1] + 1):
        own = found[found["component"] == component].set_index("vec_id").loc[[v for v, _ in rows]]
        assert own["deviation"].tolist() == deviation.tolist()
        assert np.allclose(own["explained"], explained[component - 1], rtol=1e-9)
        values = own["whitened"].to_numpy()
        sign = np.sign(values @ whitened[:, component - 1])
        assert np.allclose(values * sign, whitened[:, component - 1], atol=1e-7)


def test_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got = w.whitened(vectors.repartition(19))
    checked(got, rows)


def test_unequal_dimensions_and_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    mix = rng.standard_normal((40, 40)) * (10.0 ** -np.arange(0, 4, 0.1))
    rows = [(i, (rng.standard_normal(40) @ mix * 30).astype(np.float32).tolist()) for i in range(600)]
    monkeypatch.setattr(w, "BLOCK_BYTES", 40 * 8 * 7)
    checked(w.whitened(frame(spark, rows).repartition(70)), rows)


def test_left_out_and_repeated(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(30)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    got = w.whitened(frame(spark, rows + [(100 + i, v) for i, v in enumerate(odd)]))
    checked(got, rows, 4)
    assert got.count() == 30 * 4
    again = w.whitened(frame(spark, rows + rows + [(None, rows[0][1])]), 3).collect()
    assert len(again) == 61 * 3 and sum(r["vec_id"] is None for r in again) == 3 and {r["n"] for r in again} == {61}


def test_fewer_varying_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    got = w.whitened(frame(spark, rows))
    checked(got, rows, 1)
    assert {r["component"] for r in got.collect()} == {1}
    assert w.whitened(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert w.whitened(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert w.whitened(frame(spark, [])).columns == COLUMNS
    assert w.whitened(frame(spark, [(1, None)])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [2.0**41 * (-1) ** i, float(i)]) for i in range(6)]
    got = {r["vec_id"]: r["deviation"] for r in w.whitened(frame(spark, rows)).collect()}
    assert set(got) == set(range(6)) and all(v is None for v in got.values())
    fit = w.Fit(10**9, (7 * 10**9 + 1, 0), 2**31)
    assert fit.squares(np.array([[7, 0], [8, 1]])).to_pylist() == [1, (10**9 - 1) ** 2 + 10**18]
