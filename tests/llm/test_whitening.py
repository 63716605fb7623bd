import math

import numpy as np
import pytest

from bondwise.llm import whitening
from bondwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n string, component double, x int"


def by_hand(vectors):
    """n, exact sums and covariance of the distinct integer vectors."""
    xs = sorted({tuple(int(math.floor(64 * float(c))) + 1000000 for c in v) for v in vectors})
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in xs])
    return n, sums, z.T @ z / n


def test_query_matches_a_dense_solver(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = QUERIES["op11_whitening"](spark, SF).toPandas()
    n, sums, v = by_hand(table["embedding"])
    values, vectors = np.linalg.eigh(v)
    assert len(got) == 16 * len(table) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    own = dict(zip(table["vec_id"], table["embedding"]))
    for c, rows in got.groupby("component"):
        assert np.allclose(rows["explained"], values[-c] / np.trace(v), rtol=1e-11)
        x = np.array([[math.floor(64 * float(e)) + 1000000 for e in own[i]] for i in rows["vec_id"]])
        want = (x - np.array(sums) / n) @ vectors[:, -c] / np.sqrt(values[-c])
        assert min(np.abs(rows["whitened"] - want).max(), np.abs(rows["whitened"] + want).max()) < 1e-6
        assert rows["deviation"].tolist() == [sum((n * int(e) - s) ** 2 for e, s in zip(one, sums)) for one in x]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, -1.0], [0.5, 0.25], None, [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0]]
    rows = [(k, v, 0, "n", 0.5, 1) for k, v in enumerate(vectors)] + [(None, [0.0, 0.0], 0, "n", 0.5, 1), (0, [1.0, 2.0], 0, "n", 0.5, 1)]
    got = whitening.whitened_table(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got if r["vec_id"] is not None) == sorted((k, c) for k in (0, 0, 1, 2, 3) for c in (1, 2))
    n, sums, v = by_hand([[1, 2], [3, -1], [0.5, 0.25], [0, 0]])
    assert {r["n"] for r in got} == {4} and len(got) == 12 and got[0]["identity_error"] < 1e-12
    assert abs(sum(r["explained"] for r in got if r["vec_id"] == 2) - 1) < 1e-12
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened_table(empty).collect() == []
    alike = spark.createDataFrame([(k, [1.0, 1.0], 0, "n", 0.5, 1) for k in range(3)], SCHEMA)
    assert whitening.whitened_table(alike).collect() == []
    huge = spark.createDataFrame([(k, [1e30 * k, 1.0 * k], 0, "n", 0.5, 1) for k in range(3)], SCHEMA)
    assert {r["vec_id"] for r in whitening.whitened_table(huge).collect()} == {0, 1, 2}


def test_vectors_of_low_rank_keep_only_components_with_variance(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-50, 50, (3, 24)) / 64
    rows = [(k, [float(e) for e in rng.integers(-3, 4, 3) @ base], 0, "n", 0.5, 1) for k in range(60)]
    got = whitening.whitened_table(spark.createDataFrame(rows, SCHEMA))
    assert {r["component"] for r in got.collect()} == {1, 2, 3} and got.first()["identity_error"] < 1e-9


@pytest.mark.parametrize("spectrum", ["even", "repeated", "clustered", "wide"])
def test_slicing_finds_every_eigenvalue(spark, spectrum):
    rng, d = np.random.default_rng(3), 40
    values = {
        "even": np.arange(1, d + 1.0), "repeated": np.repeat([1.0, 5.0, 9.0, 9.5], 10), "clustered": 7 + 1e-7 * np.arange(d), "wide": 10.0 ** np.linspace(-9, 3, d),
    }[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.eigenpairs(spark, v, 16)
    assert np.allclose(found, np.sort(values)[::-1][:16], rtol=1e-9, atol=1e-12 * values.max())
    assert np.abs(v @ vectors.T - vectors.T * found).max() < 1e-10 * values.max()
    assert np.abs(vectors @ vectors.T - np.eye(16)).max() < 1e-6
    tri = whitening.tridiagonal(v)
    for shift in (0.5 * (found[3] + found[4]) if found[3] - found[4] > 1e-6 else found[-1] * 2,):
        assert whitening.inertia(tri, shift) == (np.linalg.eigvalsh(v) < shift).sum()


def test_a_missed_eigenvalue_is_an_error(spark, monkeypatch):
    whole = whitening.solve_interval
    monkeypatch.setattr(whitening, "solve_interval", lambda *a: tuple(x[..., 1:] for x in whole(*a)))
    with pytest.raises(Exception, match="inertia counts tell"):
        whitening.eigenpairs(spark, np.diag(np.arange(1.0, 9)), 4)
