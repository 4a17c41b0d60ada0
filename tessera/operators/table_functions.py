"""Functions with a state over the ordered rows of each key: Arrow table functions, fed batches and not rows."""

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: step(state, batch) gives the new state and the output rows, None for none.
Step = Callable[[Any, pa.RecordBatch], tuple[Any, pa.Table | None]]


def map_ordered(df: DataFrame, by: list[str], order: list, step: Step, schema: str, start: Callable[[], Any] = lambda: None, end: Callable[[Any], pa.Table | None] | None = None) -> DataFrame:
    """Rows of the schema from a function that reads each key's rows in order, a batch at a time, and carries a state from one to the next.

    start gives a key's first state, end the rows that are left over at its end. A key's rows pass through one task in
    batches, so memory holds a batch and the state; nulls are a key. For what windows and folds cannot state.
    """

    class Run:
        def __init__(self):
            self.state = start()

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.state, out = step(self.state, rows)
            if out is not None and out.num_rows:
                yield out

        def terminate(self) -> Iterator[pa.Table]:
            out = end(self.state) if end else None
            if out is not None and out.num_rows:
                yield out

    return F.arrow_udtf(Run, returnType=schema)(df.asTable().partitionBy(*by).orderBy(*order))
