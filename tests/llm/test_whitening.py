"""Whitening against exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def exact(vectors):
    """n, the sums, the numbers, and the covariance as fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(row, s)] for row in x]
    d = len(s)
    v = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return n, s, x, v


def check(rows, vectors, components=8):
    """rows of the operator, by component, against exact covariance and its eigenvectors."""
    n, s, x, v = exact(vectors.values())
    d = len(s)
    values, basis = np.linalg.eigh(np.array(v, float))
    values, basis = values[::-1], basis[:, ::-1]
    got = {}
    for r in rows:
        got.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(got) == list(range(1, min(components, d) + 1))
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x])
    for k, of in got.items():
        assert len(of) == n
        w = centred @ basis[:, k - 1] / np.sqrt(values[k - 1])
        mine = np.array([of[i]["whitened"] for i in vectors])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-9 * max(1, np.abs(w).max())
        for i, row in zip(vectors, x):
            assert of[i]["n"] == n and of[i]["deviation"] == sum((n * a - b) ** 2 for a, b in zip(row, s))
            assert abs(of[i]["explained"] - values[k - 1] / values.sum()) < 1e-12
            assert of[i]["identity_error"] < 1e-10


def test_query_is_that_of_exact_arithmetic(spark):
    data = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    got = queries.op13_whitening(spark, FOLDER)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), data)


def test_covariance_has_the_precision_of_double_doubles(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(700, 6)) * [1e9, 1e6, 1e3, 1, 1e-2, 1e8] + [1e9, 0, 5, 7, 1, 1e11]).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    _, _, _, v = exact(data)
    high, low = whitening.covariances(df, "embedding", whitening.fit_sums(df, "embedding"))[6]
    for i in range(6):
        for j in range(6):
            size = math.sqrt(v[i][i] * v[j][j])
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - v[i][j]) < Fraction(size) * Fraction(1, 10**28)


@pytest.mark.parametrize("n", [1, 2, 5, 33, 120])
def test_eigen_solve(n):
    rng = np.random.default_rng(n)
    lap = np.diag(np.full(n, 2.0)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1)
    wilkinson = np.diag(np.abs(np.arange(n) - n / 2)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    x, low = rng.normal(size=(2 * n, n)), rng.normal(size=(max(1, n // 3), n))
    graded = x * 10.0 ** -np.arange(n)[None, :].clip(0, 30)
    for a in (x.T @ x, low.T @ low, graded.T @ graded, lap, wilkinson, np.eye(n), np.ones((n, n)), np.zeros((n, n)), np.diag(rng.integers(0, 3, n).astype(float)), -(x.T @ x)):
        values, q = whitening.eigen(a)
        size = max(np.abs(a).max(), 1e-300)
        assert (np.diff(values) <= 0).all()
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * n * size
        assert np.abs(a @ q - q * values).max() < 1e-13 * n * size
        assert np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n


def test_edges(spark):
    rng = np.random.default_rng(4)
    three = {i: rng.normal(size=3).tolist() for i in range(40)}
    three[40] = three[3]
    two = {100 + i: rng.normal(size=2).tolist() for i in range(7)}
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0]), (205, [1e30, 0.0])]
    df = spark.createDataFrame([*three.items(), *two.items(), *odd], "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("n", F.lit("x"))
    rows = whitening.whiten(df.repartition(3)).collect()
    assert {r["vec_id"] for r in rows} == three.keys() | two.keys()
    check([r for r in rows if r["vec_id"] < 100], three)
    check([r for r in rows if r["vec_id"] >= 100], two)
    assert whitening.whiten(df.limit(0)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id int, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in flat) == [(i, k, 0, 0.0, 0.0, 1.0) for i in (0, 1) for k in (1, 2)]
    far = whitening.whiten(spark.createDataFrame([(1, [2.0**40]), (2, [-(2.0**40)])], "vec_id int, embedding array<double>")).collect()
    assert [r["deviation"] for r in far] == [None, None] and sorted(r["whitened"] for r in far) == [-1.0, 1.0]
