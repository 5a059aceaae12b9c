"""Whitening against whole-number arithmetic, and eigenvectors of matrices whose solution is known."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stopwise.llm.whitening import RESULT, refined_eigenvectors, whiten

VECTORS = "vec_id long, embedding array<float>"


def brute_force(vectors, k):
    """n, deviations, and whitened up to sign, from covariances in fractions."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return n, [sum(c * c for c in r) for r in y], np.array(y, float) / n @ vecs / np.sqrt(values), values / np.trace(cov)


def some_vectors(n=300, d=12, seed=1):
    rnd = np.random.default_rng(seed)
    mix = rnd.normal(size=(d, d)) * np.linspace(0.5, 0.01, d)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rnd.normal(size=(n, d)) @ mix + 0.3)]


def test_whitening_equals_fractions(spark):
    rows = some_vectors()
    odd = [(900, None), (901, [0.1] * 11 + [None]), (902, [0.1] * 11 + [float("nan")]), (903, [float("inf")] + [0.0] * 11), (904, [0.5])]
    df = spark.createDataFrame(rows + odd, VECTORS).repartition(7).withColumns({c: F.lit("clash") for c in ("x", "dim", "at", "n", "whitened", "component", "deviation")})
    got = whiten(df).toPandas().sort_values(["component", "vec_id"])
    n, deviations, white, explained = brute_force(rows, 8)
    assert len(got) == 8 * n and set(got["n"]) == {n}
    one = got[got["component"] == 1]
    assert one["vec_id"].tolist() == list(range(n)) and one["deviation"].tolist() == deviations
    assert set(got["identity_error"]) == {got["identity_error"].iloc[0]} and got["identity_error"].iloc[0] < 1e-12
    for c in range(8):
        mine = got[got["component"] == c + 1]
        w = mine["whitened"].to_numpy()
        assert min(np.abs(w - white[:, c]).max(), np.abs(w + white[:, c]).max()) < 1e-9
        assert abs(mine["explained"].iloc[0] - explained[c]) < 1e-12


def test_repeated_rows_null_ids_and_few_dimensions(spark):
    rows = [(None, [0.1, 0.2]), (None, [0.1, 0.2]), (5, [0.3, 0.1]), (5, [0.3, 0.1]), (6, [0.0, 0.9])]
    got = whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert len(got) == 10 and set(got["component"]) == {1, 2} and got["vec_id"].isna().sum() == 4
    assert np.ptp(got[got["vec_id"] == 5].groupby("component")["whitened"].agg(np.ptp)) == 0


def test_no_variance_gives_null(spark):
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25])], VECTORS)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    line = whiten(spark.createDataFrame([(i, [i / 8, i / 4]) for i in range(5)], VECTORS)).toPandas()
    assert line[line["component"] == 2]["whitened"].isna().all() and line[line["component"] == 1]["whitened"].notna().all()
    assert (line["identity_error"] < 1e-12).all()


def test_empty_table_and_empty_vectors(spark):
    assert whiten(spark.createDataFrame([], VECTORS)).collect() == []
    out = whiten(spark.createDataFrame([(1, []), (2, None)], VECTORS))
    assert out.collect() == [] and out.schema == spark.createDataFrame([], RESULT).schema


def test_very_large_components_are_exact_or_null(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3e5, 4.0])]
    got = whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert got[got["vec_id"] == 0]["deviation"].isna().all()
    rows = [(0, [3e5, 1.0]), (1, [-3e5, 2.0]), (2, [1e5, 4.0])]
    got = whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert got[got["component"] == 1].sort_values("vec_id")["deviation"].tolist() == brute_force(rows, 2)[1]
    assert (got["identity_error"] < 1e-9).all()


@pytest.mark.parametrize("gap", [1e-3, 1e-7, 1e-10, 1e-13, 0.0])
def test_clustered_eigenvalues(gap):
    d = 24
    rnd = np.random.default_rng(4)
    q = np.linalg.qr(rnd.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))  # orthonormal in extended precision
    true = np.array([1.0 - gap * i for i in range(5)] + [0.5, 0.5 - gap] + [0.3 / (i + 1) for i in range(d - 7)], np.longdouble)
    true = np.sort(true)[::-1]
    a = (q * true) @ q.T
    a = (a + a.T) / 2
    values, x = refined_eigenvectors(a * 1e9)
    assert np.abs(values / 1e9 - true).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * (values / 1e9)).max() < 1e-17
    if gap == 1e-3:
        start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
        assert np.abs(np.abs((start * q[:, np.argsort(-true)]).sum(axis=0)) - 1).max() > 1e-13  # what the correction gains


@pytest.mark.parametrize("gap", [1e-12, 1e-13, 3e-14])
def test_vectors_of_close_eigenvalues_are_orthogonal_for_any_start(gap):
    d = 24
    for seed in range(12):
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
        for _ in range(3):
            q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
        true = np.array([1.0 - gap * i for i in range(5)] + [0.5, 0.5 - gap] + [0.3 / (i + 1) for i in range(d - 7)], np.longdouble)
        a = (q * true) @ q.T
        a = (a + a.T) / 2
        values, x = refined_eigenvectors(a)
        assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
        assert np.abs(a @ x - x * values).max() < 1e-17
