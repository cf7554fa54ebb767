import math
import random

import pytest
from pyspark.sql import functions as F

from lendwell.llm import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], SCHEMA)


def best_by_hand(rows, k, queries):
    usable = [
        (n, i, [math.floor(256 * x) for x in v])
        for n, (i, v) in enumerate(rows)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, q in usable:
        if i is None or i % queries:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, m) for m, j, c in usable if m != n)[:k]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j, _) in enumerate(scores)]
    return sorted(out, key=str)


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("shard", [16, 1024])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", shard)
    rng = random.Random(3)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(10)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(5, rows[5][1]), (50, [0.5, -0.25]), (400, None), (450, []), (500, [1.0, None]), (550, [float("nan")])]
    rows += [(600, [float("inf")]), (None, [1.0]), (None, [9.0] * 10), (650, [f32(1e6)] * 10), (700, [-1.0] * 10)]
    got = exact_topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == best_by_hand(rows, 5, 50)


def test_empty_vectors_and_null_ids_are_candidates(spark):
    rows = [(0, [-1.0, 0.5]), (1, []), (2, [1.0, 0.0]), (None, [-1.0, 0.5]), (None, []), (3, None)]
    got = exact_topk.top_k(frame(spark, rows), F.col("vec_id") == 0, k=9)
    assert [tuple(r)[1:] for r in got.orderBy("rank").collect()] == [
        (1, None, 256 * 256 + 128 * 128), (2, 1, 0), (3, None, 0), (4, 2, -256 * 256)
    ]
    empty = exact_topk.top_k(frame(spark, [(0, []), (1, [])]), F.col("vec_id") == 0, k=9).collect()
    assert [tuple(r) for r in empty] == [(0, 1, 1, 0)]


def test_few_rows_large_components_and_none(spark):
    rows = [(0, [f32(3e15), 1.0]), (1, [f32(2e15), -1.0]), (2, [1.0, 1.0])]
    got = exact_topk.top_k(frame(spark, rows), F.col("vec_id") == 0, k=5)
    want = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in best_by_hand(rows, 5, 10)]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert exact_topk.top_k(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert exact_topk.top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") == 0).count() == 0
