"""Whitening against numpy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from tessera.llm import queries
from tessera.llm.whitening import principal_components, whiten

SF = "/root/testdata/sf0.001"


def brute(vectors, k=8):
    """(x, n, deviations, projections up to their sign, shares) of usable vectors."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    z = np.array(off, float) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [sum(c * c for c in o) for o in off], z @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(got, ids, vectors, k=8):
    n, deviations, want, shares = brute(vectors, k)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(ids) * k
    assert all(rows[i, 1]["deviation"] == d and rows[i, 1]["n"] == n for i, d in zip(ids, deviations, strict=True))
    have = np.array([[rows[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.allclose(have * np.sign((have * want).sum(0)), want, atol=1e-8)
    assert np.allclose([rows[ids[0], c + 1]["explained"] for c in range(k)], shares, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op12_whitening(spark, SF).collect(), *zip(*table, strict=True))


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=3) * [3, 2, 1]).tolist()) for i in range(50)]
    good += [(50, good[3][1]), (51, [0.5, -0.25]), (52, []), (53, [1e-30, -1e-30, 2.0])]
    bad = [(60, None), (61, [1.0, None, 2.0]), (62, [1.0, math.nan, 2.0]), (63, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in good + bad], "vec_id long, embedding array<double>, component string, n int").repartition(3)
    check(whiten(df).collect(), [i for i, _ in good], [[*v, *[0.0] * (3 - len(v))] for _, v in good], k=3)
    assert whiten(df.limit(0)).collect() == [] and whiten(df.filter("vec_id >= 60")).collect() == []
    same = whiten(df.filter("vec_id in (3, 50)")).collect()
    assert len(same) == 6 and {r["whitened"] for r in same} == {None} and {r["deviation"] for r in same} == {0} and {r["explained"] for r in same} == {0}
    twice = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(twice) == 6 and sum(r["whitened"] is None for r in twice) == 3
    with pytest.raises(ValueError, match="must not be called"):
        whiten(df.withColumnRenamed("vec_id", "N"), id_col="N")


def test_large_values(spark):
    rows = [(i, [float(i) * 2.0**29, 1.0]) for i in (-1, 0, 1, 2)]
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r["component"] == 1}
    x = {i: math.floor(1024 * v[0]) + 100_000 for i, v in rows}
    want = {i: (4 * x[i] - sum(x.values())) ** 2 for i, _ in rows}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}


@pytest.mark.parametrize("gap", [0.5, 0.99])
def test_range_finder(spark, gap):
    """A steep spectrum is found with the first basis, a flat one by widening it: the same eigenvectors either way."""
    rng = np.random.default_rng(2)
    scales = 5000 * gap ** np.arange(40)
    x = np.rint(rng.normal(size=(400, 40)) * scales @ np.linalg.qr(rng.normal(size=(40, 40)))[0]).astype(int)
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(4)
    e, v = principal_components(rows, 400, x.sum(0).tolist(), 5)
    z = x - x.mean(0)
    want_e, want_v = np.linalg.eigh(z.T @ z / 400)
    assert np.allclose(e, want_e[::-1][:5], rtol=1e-10) and np.allclose(np.abs((v * want_v[:, ::-1][:, :5]).sum(0)), 1, atol=1e-10)
