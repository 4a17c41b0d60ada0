"""Windows over series that are too long for one task: segmented prefix scans over equal blocks of rows.

A window without a partition key, or with a hot one, moves a whole series into one task. Here the rows are sorted by range
over all tasks and numbered; a block is so many consecutive numbers, whatever the keys. What looks a bounded way back or
ahead is computed in each block after the rows beside it are copied in. What looks back to the start (running sums, the last
known value) is computed in each block from one row more, which carries what the blocks before it sum up to. The carried
rows are a scan over one row for each block and series in it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.names import hidden
from tessera.operators.relational import dense, sorted_rows

#: Rows of a block.
SIZE = 1 << 17
#: A task reads so many blocks on average. The number of tasks follows from the rows and not from settings, so what a task holds does not grow with a table.
BLOCKS_EACH = 4
#: What a running column can be: the function over a frame, which also sums up a block and what is carried.
KINDS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


class Blocks:
    """The rows of df in blocks, by series key and order. Rows are sorted and written once; each step then moves them once."""

    def __init__(self, df: DataFrame, by: tuple[str, ...], order: list, size: int = SIZE, _made: tuple | None = None):
        self.by, self.size = tuple(by), size
        if _made:
            self.rows, self.columns, self.place, self.block, self.gaps, self.tasks = _made
            return
        self.columns = df.columns
        self.place, self.block = hidden(df, "place", "block")
        # Places rise with the order; they have gaps between partitions until near() counts them.
        self.rows, self.gaps = self._cut(sorted_rows(df, *self.by, *order, place=self.place)), True
        self.tasks = self.rows.count() // (BLOCKS_EACH * size) + 1

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by block, as the windows need them."""
        return rows.repartition(self.tasks, self.block)

    def _cut(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.block, F.floor(F.col(self.place) / self.size))

    def _with(self, rows: DataFrame, names: list[str], gaps: bool) -> "Blocks":
        columns = [*(c for c in self.columns if c not in names), *names]
        return Blocks(rows, self.by, [], self.size, (rows.select(*columns, self.place, self.block), columns, self.place, self.block, gaps, self.tasks))

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def _window(self, falling: bool = False) -> WindowSpec:
        return Window.partitionBy(self.block, *self.by).orderBy(F.col(self.place).desc() if falling else F.col(self.place))

    def near(self, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> "Blocks":
        """Adds columns over a window of the series that looks at most so many rows back and ahead: name -> function of the window.

        A function may read columns named before it. Rows near a block's edge are copied to the blocks that see them.
        """
        own, = hidden(self.rows, "own")
        given = self._cut(dense(self.rows, self.place, self.place)) if self.gaps else self.rows
        place, block = F.col(self.place), F.col(self.block)
        first, last = F.floor(F.greatest(place - after, F.lit(0)) / self.size), F.floor((place + before) / self.size)
        rows = self._dealt(given.withColumn(own, block).withColumn(self.block, F.explode(F.sequence(first, last))))
        for name, function in columns.items():
            rows = rows.withColumn(name, function(self._window()))
        return self._with(rows.filter(F.col(self.block) == F.col(own)).drop(own), list(columns), False)

    def running(self, columns: dict[str, tuple[str, Column]], back: dict[str, tuple[str, Column]] | None = None) -> "Blocks":
        """Adds running columns: name -> (sum, min, max or last, value); last is the last value that is not null. back: the same from the end of the series back."""
        ways = [(n, kind, c, False) for n, (kind, c) in columns.items()] + [(n, kind, c, True) for n, (kind, c) in (back or {}).items()]
        names = hidden(self.rows, *(f"given{i}" for i in range(len(ways))))
        rows = self.rows.withColumns({g: c for g, (_, _, c, _) in zip(names, ways, strict=True)})
        place = F.col(self.place)
        latest = lambda g, falling: F.max(F.when(F.col(g).isNotNull(), F.struct((-place if falling else place).alias("at"), F.col(g).alias("v"))))["v"]
        sums = rows.groupBy(self.block, *self.by).agg(*((latest(g, falling) if kind == "last" else KINDS[kind](F.col(g))).alias(g) for g, (_, kind, _, falling) in zip(names, ways, strict=True)))
        both, edges = rows, {False: -1, True: (1 << 63) - 1}
        for way, edge in edges.items():
            # What the blocks before sum up to is one row more, at the block's edge; columns of the other way are null there.
            upto = Window.partitionBy(*self.by).orderBy(F.col(self.block).desc() if way else F.col(self.block)).rowsBetween(Window.unboundedPreceding, -1)
            mine = [KINDS[kind](F.col(g)).over(upto).alias(g) for g, (_, kind, _, falling) in zip(names, ways, strict=True) if falling == way]
            if mine:
                both = both.unionByName(sums.select(self.block, *self.by, *mine, F.lit(edge).cast("long").alias(self.place)), allowMissingColumns=True)
        frame = lambda falling: self._window(falling).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = self._dealt(both).withColumns({n: KINDS[kind](F.col(g)).over(frame(falling)) for g, (n, kind, _, falling) in zip(names, ways, strict=True)})
        return self._with(both.filter(~place.isin(*edges.values())), [n for n, *_ in ways], self.gaps)


def runs(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = (), name: str = "run", size: int = SIZE) -> DataFrame:
    """Numbers the runs of consecutive equal keys, as relational.run_id does, for series of any length."""
    blocks, new = _changes(df, keys, order, by, size)
    return blocks.running({name: ("sum", F.col(new).cast("long"))}).df.drop(new)


def uniq(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Drops rows whose keys equal those of the row before, as relational.uniq does, for series of any length."""
    blocks, new = _changes(df, keys, order, by, size)
    return blocks.df.filter(F.col(new)).drop(new)


def _changes(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...], size: int) -> tuple[Blocks, str]:
    new, = hidden(df, "new")
    same = lambda w: F.lag(F.struct(*keys)).over(w).eqNullSafe(F.struct(*keys))  # noqa: E731  a row before is a struct, so it is never null
    return Blocks(df, by, order, size).near(1, 0, {new: lambda w: ~same(w)}), new


def group_runs(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = (), size: int = SIZE, **aggregates: Column) -> DataFrame:
    """One row for each run of consecutive equal keys: by, keys, its number (from 1, as column run) and the aggregates, such as n=F.count(F.lit(1))."""
    return runs(df, keys, order, by, size=size).groupBy(*dict.fromkeys([*by, "run", *keys])).agg(*(c.alias(n) for n, c in aggregates.items()))
