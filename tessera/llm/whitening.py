"""Whitened principal components by a randomised range finder (operator 12).

Vectors become integers, so that sums and deviations are exact. A random basis, with some directions more than are asked
for, is multiplied by the covariance again and again: each pass reads all centred rows, adds up Z'(Z Q) in every task and
sums the tasks' cells in Spark, so the covariance itself is never formed. After each pass a Rayleigh-Ritz step turns the
basis into approximate eigenvectors; where their residuals stay too large the basis doubles, in the end to the full
dimension, at which the step is exact. Only tables of dimension times basis reach the driver, whatever the rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Integers of a vector's entries: floor(SCALE * c) + SHIFT, held within MOST.
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 40
#: Directions beyond those asked for, passes before the basis grows, and the largest residual as a share of the first eigenvalue.
OVERSAMPLE, POWERS, TOLERANCE = 8, 4, 1e-13
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integers(c: Column) -> Column:
    """The vector's integers; null where the vector is null or holds a null, NaN or infinite entry."""
    c = c.cast("array<double>")
    good = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))).cast("long") + SHIFT
    return F.when(good, F.transform(c, whole))


def _matrix(lists: pa.Array, d: int) -> np.ndarray:
    """One row for each list, filled up with the integer of a zero entry."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    ends = ends - ends[0]
    if np.all(np.diff(ends) == d):
        return flat.reshape(len(lists), d)
    out = np.full((len(lists), d), SHIFT, np.int64)
    for i in range(len(lists)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _off(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: as 64-bit integers where they fit, as Python's beyond."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
    small = n * most < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61
    return n * x - np.array(sums, np.int64) if small else n * x.astype(object) - np.array(sums, object)


def _deviations(off: np.ndarray) -> list[int | None]:
    """The sums of squares; null where a long does not hold them."""
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(1).tolist()
    whole = [sum(v * v for v in row) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in whole]


def _cells(values: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(values, np.float64).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["cell", "v"])


def _summed(rows: DataFrame, shape: tuple[int, int], part, d: int) -> np.ndarray:
    """The sum over all rows of part(x), a table of that shape: added up in each task, then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = part(_matrix(b.column(0), d))
                total = got if total is None else total + got
        if total is not None:
            yield _cells(total)

    out = np.zeros(shape[0] * shape[1])
    # No more rows than the table has cells, whatever the input.
    for r in rows.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r["cell"]] = r["v"]
    return out.reshape(shape)


def _times(rows: DataFrame, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """Covariance times q."""

    def part(x):
        z = _off(x, n, sums).astype(np.float64) / n
        return z.T @ (z @ q)

    return _summed(rows, q.shape, part, len(sums)) / n


def principal_components(rows: DataFrame, n: int, sums: list[int], k: int, oversample: int = OVERSAMPLE, powers: int = POWERS, tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the covariance of rows (x), the k largest, falling."""
    d = len(sums)
    k, rng = min(k, d), np.random.default_rng(seed)
    size = min(d, k + oversample)
    q = np.linalg.qr(rng.standard_normal((d, size)))[0]
    while True:
        for _ in range(powers):
            y = _times(rows, n, sums, q)
            h = q.T @ y
            e, u = np.linalg.eigh((h + h.T) / 2)
            e, u = e[::-1], u[:, ::-1]
            vectors = q @ u
            residual = np.linalg.norm(y @ u - vectors * e, axis=0)[:k]
            if size == d or residual.max(initial=0) <= tolerance * e[0]:
                vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
                return np.maximum(e[:k], 0), vectors
            q = np.linalg.qr(y)[0]
        wider = min(d, 2 * size)
        q, size = np.linalg.qr(np.hstack([q, rng.standard_normal((d, wider - size))]))[0], wider


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first k components.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out; all others are fitted and projected,
    repeated ones each time, null ids as they are. Shorter vectors count as filled up with zeros; entries beyond 2^30 in
    size are held there. A table without usable rows gives none, and one whose vectors have fewer than k entries as many
    components as entries. Components without variance (equal rows, or fewer rows than dimensions) have a null whitened
    value, as there is nothing to divide by, and take no part in identity_error. deviation is exact, null where a long
    cannot hold it. Other columns are not read; the id must not be called as one of the result's columns.
    """
    if id_col.lower() in OUT:
        raise ValueError(f"the id column must not be called {id_col}")
    rows = df.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).filter(F.col("x").isNotNull())
    rows = written(rows, "whitening")
    id_type = rows.schema["id"].dataType.simpleString()
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for b in batches:
            if b.num_rows:
                total += _matrix(b.column(0), d).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int64()), pa.array([str(v) for v in total], pa.string())], ["cell", "v"])

    exact = rows.select("x").mapInArrow(added, "cell long, v string").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = [0] * d
    for r in exact.collect():  # one row for each dimension
        sums[r["cell"]] = int(r["v"])
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not d:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    values, vectors = principal_components(rows, n, sums, k)
    trace = float(_summed(rows, (1, 1), lambda x: np.array([[np.square(_off(x, n, sums).astype(np.float64) / n).sum()]]), d)[0, 0]) / n
    has = values > d * np.finfo(float).eps * max(values[0], 0)
    axes = np.where(has, vectors / np.sqrt(np.where(has, values, 1)), 0)
    explained = values / trace if trace else np.zeros(len(values))

    def squares(x):
        w = _off(x, n, sums).astype(np.float64) / n @ axes
        return w.T @ w

    identity = _summed(rows, (len(values), len(values)), squares, d) / n - np.eye(len(values))
    error = float(np.abs(identity[has][:, has]).max(initial=0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = len(values)
        for b in batches:
            if not b.num_rows:
                continue
            off = _off(_matrix(b.column(1), d), n, sums)
            w = off.astype(np.float64) / n @ axes
            deviation, take = pa.array(_deviations(off), pa.int64()), pa.array(np.repeat(np.arange(b.num_rows), each))
            whole = lambda v, kind: pa.array(np.tile(v, b.num_rows), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(take), whole(np.arange(1, each + 1, dtype=np.int32), pa.int32()), whole(np.full(each, n), pa.int64()), deviation.take(take),
                pa.array(w.ravel(), pa.float64(), mask=np.tile(~has, b.num_rows)), whole(explained, pa.float64()), whole(np.full(each, error), pa.float64()),
            ], ["id", *OUT])

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_col)
