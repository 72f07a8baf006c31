"""Nearest neighbours against all distances."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import neighbours
from recordloom.llm.queries import ORACLES, QUERIES



def _slow(rows, is_query, k=10):
    best = {}
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok:
            best[i] = min(best.get(i, list(v)), list(v))
    dims = max(map(len, best.values()), default=0)
    full = {i: [*v, *[0.0] * (dims - len(v))] for i, v in best.items()}
    out = []
    for q in filter(is_query, full):
        far = []
        for i, v in full.items():
            total = 0.0
            for x, y in zip(full[q], v, strict=True):
                total += (x - y) * (x - y) if abs(x - y) < 1e154 else math.inf
            far.append((math.sqrt(total), i))
        out += [(q, n, i, d) for n, (d, i) in enumerate(sorted(p for p in far if p[1] != q)[:k], 1)]
    return sorted(out)


def test_equals_its_twin(spark, tiny):
    got = sorted(map(tuple, QUERIES["op12_nearest_neighbours"](spark, tiny).collect()))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    assert got == sorted(c.sql(ORACLES["op12_nearest_neighbours"]).fetchall())


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-9, 1e30])
def test_clusters_equal_all_distances(spark, spread, monkeypatch):
    """Dense clusters, down to what int8 codes can't tell apart."""
    monkeypatch.setattr(neighbours, "VECTOR_TILE", 37)
    monkeypatch.setattr(neighbours, "QUERY_TILE", 5)
    monkeypatch.setattr(neighbours, "STRIPE", 90)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 9))
    rows = [(i, (centre[i % 4] + spread * rng.normal(size=9)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == _slow(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (10, [1.0, 0.0]), (20, [1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
        (None, [1.0, 2.0]), (7, [1.0, 1.0]), (8, [1.0, -1.0]), (8, [1.0, -1.0]), (9, [3.0, 1.0]), (9, [1.0, 0.5]), (11, [0.0, 1e-320]), (12, [1e300, 1e300]), (13, [-1e300, 5.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, 1, "g") for i, v in rows], "vec_id long, embedding array<double>, class_id long, v long, g string")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == _slow(rows, lambda i: i % 10 == 0)
    assert [r[2] for r in got if r[0] == 0][:2] == [10, 20]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_whole_numbers_are_vectors_too(spark):
    df = spark.createDataFrame([(i, [i % 7, i % 5, 1]) for i in range(40)], "vec_id long, embedding array<int>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=3).collect()))
    assert got == _slow([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], lambda i: i % 10 == 0, 3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(900, 64)) * rng.uniform(0.01, 100, size=(900, 1))
    lower, upper = neighbours.bounds(neighbours.Coded(x), neighbours.Coded(y))
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (lower <= true).all() and (true <= upper).all()
    lists = neighbours.Lists(np.arange(50), x, 11)
    lists.add(np.arange(900), y)
    assert lists.recomputed < 50 * 900 / 20


def test_products_stay_exact_beyond_single_precision():
    x = np.full((2, 2000), 1.0)
    x[1, ::2] = -1.0
    lower, upper = neighbours.bounds(neighbours.Coded(x), neighbours.Coded(x))
    assert lower[0, 1] <= math.sqrt(4000) <= upper[0, 1] and upper[0, 1] - lower[0, 1] < 1e-3
