"""Tridiagonal systems that are too long for one task: elimination by blocks, the system of the blocks' ends, and back substitution."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.names import hidden


def _block(low: list[float], mid: list[float], high: list[float], r: list[float]) -> tuple[list[float], ...]:
    """The block's unknowns as p + q * (the one before it) + s * (the one behind it)."""
    n = len(r)
    # Elimination along the bands, of three right sides: the given one, and what the neighbours on either side weigh.
    q, s, mid, p = [-low[0], *[0.0] * (n - 1)], [*[0.0] * (n - 1), -high[-1]], [*mid], [*r]
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        p[i] -= f * p[i - 1]
        q[i] -= f * q[i - 1]
    p[-1], q[-1], s[-1] = p[-1] / mid[-1], q[-1] / mid[-1], s[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        p[i], q[i], s[i] = ((v[i] - high[i] * v[i + 1]) / mid[i] for v in (p, q, s))
    return p, q, s


def eliminated(rows: DataFrame, by: tuple[str, ...], block: str, place: str, bands: tuple[str, str, str, str]) -> DataFrame:
    """rows (one for each equation: below, on and above the diagonal, right side), with the bands' columns replaced.

    The first three then give the unknown by those beside its block: p + q * (the one before) + s * (the one behind), so
    within a series an equation's neighbours are those of the places around it.
    """
    head, = hidden(rows, "head")
    w = Window.partitionBy(block, *by).orderBy(place)
    rows = rows.withColumn(head, F.lag(F.lit(1)).over(w).isNull()).sortWithinPartitions(block, *by, place)
    out = T.StructType([f for f in rows.schema.fields if f.name not in (bands[3], head)])
    schema = to_arrow_schema(out)

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(table.column(head).to_numpy())
            columns = [table.column(c).to_pylist() for c in bands]
            got: list[list[float]] = [[], [], []]
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                for all_, part in zip(got, _block(*(c[a:b] for c in columns)), strict=True):
                    all_ += part
            for c, values in zip(bands, got, strict=False):
                table = table.set_column(table.schema.get_field_index(c), c, pa.array(values, pa.float64()))
            yield from table.select(schema.names).cast(schema).to_batches()

        for b in batches:
            starts = np.flatnonzero(b.column(b.schema.get_field_index(head)).to_numpy(zero_copy_only=False))
            if held and len(starts):  # the last block may go on in the next batch
                yield from done(pa.Table.from_batches([*held, b.slice(0, starts[-1])]))
                held = []
                b = b.slice(starts[-1])
            held.append(b)
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.mapInArrow(whole_blocks, out)


def solved(rows: DataFrame, by: tuple[str, ...], block: str, place: str, parts: tuple[str, str, str], name: str) -> DataFrame:
    """Eliminated rows with the unknown as a column. Only blocks that depend on others meet, two rows' figures each, one series in a task."""
    p, q, s = parts
    side = lambda f, c: f(F.col(c), F.col(place))
    ends = rows.groupBy(block, *by).agg(*(side(f, c).alias(f"{e}{i}") for e, f in (("first", F.min_by), ("last", F.max_by)) for i, c in enumerate(parts)))
    linked = ends.filter("first1 <> 0 or last1 <> 0 or first2 <> 0 or last2 <> 0")
    keys = hidden(rows, *(f"key{i}" for i in range(len(by))))
    of, before, behind = hidden(rows, "of", "before", "behind")
    linked = linked.select(F.col(block).alias(of), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(f"{e}{i}" for e in ("first", "last") for i in range(3)))
    kinds = ", ".join([f"`{of}` bigint", *(f"`{k}` {linked.schema[k].dataType.simpleString()}" for k in keys), f"`{before}` double", f"`{behind}` double"])

    def system(table: pa.Table) -> pa.Table:
        table = table.sort_by(of)
        rows = list(zip(*(table.column(f"{e}{i}").to_pylist() for e in ("first", "last") for i in range(3)), strict=True))
        # From the left: a block's last unknown, and its first one, by the first unknown of the next block.
        steps, p0, q0 = [], 0.0, 0.0
        for fp, fq, fs, lp, lq, ls in rows:
            by_self = 1 - fq * q0
            a, c = (fp + fq * p0) / by_self, fs / by_self
            p0, q0 = lp + lq * (p0 + q0 * a), lq * q0 * c + ls
            steps.append((a, c, p0, q0))
        firsts, lasts = [0.0] * (len(rows) + 1), [0.0] * (len(rows) + 1)
        for i in range(len(rows) - 1, -1, -1):
            a, c, p1, q1 = steps[i]
            firsts[i], lasts[i + 1] = a + c * firsts[i + 1], p1 + q1 * firsts[i + 1]
        return pa.table({of: table.column(of), **{k: table.column(k) for k in keys}, before: pa.array(lasts[:-1], pa.float64()), behind: pa.array(firsts[1:], pa.float64())})

    sides = linked.groupBy(*keys).applyInArrow(lambda t: system(t), kinds)
    on = F.col(block) == F.col(of)
    for c, k in zip(by, keys, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(k))
    out = rows.join(sides, on, "left")
    return out.withColumn(name, F.col(p) + F.coalesce(F.col(q) * F.col(before), F.lit(0.0)) + F.coalesce(F.col(s) * F.col(behind), F.lit(0.0))).drop(of, *keys, before, behind)
