"""Time series as DataFrames: a series key (any columns, maybe none), an order column and a value.

A series whose rows fit a task is a window partitioned by the series key. One that does not (any without a key, and hot
ones, by split=True) is cut into blocks of equal size; see tessera.operators.scan. Both give the same rows. Null keys are
a series like any other.
"""

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.dates import date_to_int, year_decimal
from tessera.functions.numeric import is_local_extreme, lift
from tessera.names import free, hidden
from tessera.operators.scan import SIZE, Blocks
from tessera.operators.tridiagonal import eliminated, solved
from tessera.shared import written


class Series:
    """Names the columns of a series: by (the series key), order and value. split: rows of a series need not fit a task; block: rows of a block then."""

    def __init__(self, df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), split: bool | None = None, block: int = SIZE):
        self.df, self.order, self.value, self.by = df, order, value, tuple(by)
        self.split, self.block = not self.by if split is None else split, block

    def with_df(self, df: DataFrame) -> "Series":
        return Series(df, self.order, self.value, self.by, self.split, self.block)

    @property
    def window(self):
        return Window.partitionBy(*self.by).orderBy(self.order)

    def _near(self, before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
        """Adds columns that look at most so many rows back and ahead; later ones may read earlier ones."""
        if self.split:
            return Blocks(self.df, self.by, [self.order], self.block).near(before, after, columns).df
        out = self.df
        for name, function in columns.items():
            out = out.withColumn(name, function(self.window))
        return out

    def _numbered(self, name: str, falling: bool = False) -> DataFrame:
        """Adds the row's number in its series, from 1; falling: from the end."""
        if self.split:
            blocks, number = Blocks(self.df, self.by, [self.order], self.block), {name: ("sum", F.lit(1))}
            return (blocks.running({}, number) if falling else blocks.running(number)).df
        return self.df.withColumn(name, F.row_number().over(Window.partitionBy(*self.by).orderBy(F.col(self.order).desc()) if falling else self.window))

    def _facts(self, **aggregates: Column) -> DataFrame:
        """The rows with aggregates of their series: combined before they move, and joined."""
        return _joined(self.df, self.df.groupBy(*self.by).agg(*(c.alias(n) for n, c in aggregates.items())), self.by)

    def _shifted(self, offset: int, w: WindowSpec) -> Column:
        v = F.col(self.value)
        return F.lag(v, -offset).over(w) if offset < 0 else F.lead(v, offset).over(w) if offset else v

    # Neighbours

    def sliding(self, offsets: tuple[int, ...] = (-1, 0, 1), name: str = "window", wrap: bool = False) -> DataFrame:
        """The values at the offsets as an array, null beyond the ends; wrap: places before the first row count from the end."""
        reach = _reach(offsets)
        if not wrap or not reach[0]:
            return self._near(*reach, {name: lambda w: F.array(*(self._shifted(o, w) for o in offsets))})
        n, ends, at, v = hidden(self.df, "n", "ends", "at", "v")
        last = self._numbered(at, falling=True).filter(F.col(at) <= reach[0])
        tails = last.groupBy(*self.by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at), F.struct(F.col(self.value).alias(v))))).alias(ends))
        rows = _joined(self.with_df(self._numbered(n)), tails, self.by)

        def value(o: int, w: WindowSpec) -> Column:
            got = self._shifted(o, w)
            for k in range(1, 1 - o):  # the first rows see the last ones
                got = F.when(F.col(n) == k, F.try_element_at(ends, F.lit(1 - k - o).cast(dict(tails.dtypes)[ends][4:].split(",")[0]))[v]).otherwise(got)
            return got

        return self.with_df(rows)._near(*reach, {name: lambda w: F.array(*(value(o, w) for o in offsets))}).drop(n, ends)

    def apply_window(self, function: Callable[[Column], Column], offsets: tuple[int, ...] = (-1, 0, 1), name: str = "applied") -> DataFrame:
        w, = hidden(self.df, "w")
        return self.sliding(offsets, w).withColumn(name, function(F.col(w))).drop(w)

    def smooth(self, offsets: tuple[int, ...] = (-1, 0, 1), name: str = "smoothed") -> DataFrame:
        """The mean of the defined values at the offsets."""
        return self._near(*_reach(offsets), {name: lambda w: self._mean(offsets, w)})

    def _mean(self, offsets: tuple[int, ...], w: WindowSpec) -> Column:
        if tuple(offsets) == tuple(range(min(offsets), max(offsets) + 1)):
            return F.avg(self.value).over(w.rowsBetween(min(offsets), max(offsets)))
        parts = [self._shifted(o, w) for o in offsets]
        total, n = (reduce(lambda a, b: a + b, (f(p) for p in parts)) for f in (lambda p: F.coalesce(p, F.lit(0.0)), lambda p: p.isNotNull().cast("int")))
        return F.when(n > 0, total / n)

    def smooth_simple(self, size: int = 3, exclude_center: bool = False, name: str = "smoothed") -> DataFrame:
        """The centred moving average; where the window does not fit the value stays. size is odd."""
        c, v = size // 2, F.col(self.value)

        def smoothed(w: WindowSpec) -> Column:
            total = F.sum(self.value).over(w.rowsBetween(-c, c))
            return F.when(_inside(c, c, w), (total - v) / (size - 1) if exclude_center else total / size).otherwise(v)

        return self._near(c, c, {name: smoothed})

    def smooth_multiple(self, sizes: list[int], name: str = "smoothed") -> DataFrame:
        out = self.df.withColumn(name, F.col(self.value))
        for s in sizes:
            out = Series(out, self.order, name, self.by, self.split, self.block).smooth_simple(s, name=name)
        return out

    def deviation(self, offsets: tuple[int, ...] = (-1, 0), relative: bool = False, name: str = "deviation") -> DataFrame:
        return self._near(*_reach(offsets), {name: lambda w: self._deviation(offsets, relative, w)})

    def _deviation(self, offsets: tuple[int, ...], relative: bool, w: WindowSpec) -> Column:
        mean = self._mean(offsets, w)
        d = F.col(self.value) - mean
        return F.when(mean != 0, d / mean) if relative else d

    def mark_extremes(self, local_min: bool = True, local_max: bool = True, name: str = "extreme") -> DataFrame:
        """True at local extremes; the ends are none."""
        return self._near(1, 1, {name: lambda w: self._extreme(local_min, local_max, w)})

    def _extreme(self, local_min: bool, local_max: bool, w: WindowSpec) -> Column:
        got = is_local_extreme(F.lag(self.value).over(w), F.col(self.value), F.lead(self.value).over(w), local_min, local_max)
        return F.coalesce(got, F.lit(False))

    def mark_spikes(self, threshold: float, offsets: tuple[int, ...] = (-2, -1, 1, 2), local_min: bool = False, local_max: bool = True, name: str = "spike") -> DataFrame:
        """Local extremes that deviate from their neighbours' mean by more than the threshold, relative to it."""
        return self._near(*_reach((-1, 1, *offsets)), {name: lambda w: self._spike(threshold, offsets, local_min, local_max, w)})

    def _spike(self, threshold: float, offsets: tuple[int, ...], local_min: bool, local_max: bool, w: WindowSpec) -> Column:
        return self._extreme(local_min, local_max, w) & F.coalesce(F.abs(self._deviation(offsets, True, w)) > threshold, F.lit(False))

    def smooth_spikes(self, threshold: float, offsets: tuple[int, ...] = (-2, -1, 1, 2), local_min: bool = False, local_max: bool = True, name: str = "smoothed") -> DataFrame:
        smoothed = lambda w: F.when(self._spike(threshold, offsets, local_min, local_max, w), self._mean(offsets, w)).otherwise(F.col(self.value))
        return self._near(*_reach((-1, 1, *offsets)), {name: smoothed})

    def derivative(self, by_order: bool = False, name: str = "derivative") -> DataFrame:
        """v - next v (or that over the order's difference); the last row has none."""
        gap = lambda c, w: F.col(c) - F.lead(c).over(w)
        return self._near(0, 1, {name: lambda w: gap(self.value, w) / gap(self.order, w) if by_order else gap(self.value, w)})

    def shift(self, n: int, default=None, name: str = "shifted") -> DataFrame:
        return self._near(max(n, 0), max(-n, 0), {name: lambda w: F.lag(self.value, n, default).over(w)})

    # Whole series

    def norm(self, rate: float | None = None, name: str = "normed") -> DataFrame:
        if rate is not None:
            return self.df.withColumn(name, F.col(self.value) / rate)
        mean, = hidden(self.df, "mean")
        return self._facts(**{mean: F.avg(self.value)}).withColumn(name, F.col(self.value) / F.col(mean)).drop(mean)

    def cumulated(self, name: str = "cumulated") -> DataFrame:
        if self.split:
            return Blocks(self.df, self.by, [self.order], self.block).running({name: ("sum", F.col(self.value))}).df
        return self.df.withColumn(name, F.sum(self.value).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))

    def combine(self, other: "Series", function: Callable[[Column, Column], Column], name: str = "combined") -> DataFrame:
        """function of the values at equal places of two series of equal keys."""
        n, value = hidden([self.df, other.df], "n", "value")
        its = other._numbered(n).select(*(F.col(c).alias(m) for c, m in zip(other.by, self.by, strict=True)), n, F.col(other.value).alias(value))
        both = _joined(self._numbered(n), its, (*self.by, n))
        return both.select(*self.by, self.order, function(F.col(self.value), F.col(value)).alias(name))

    def borders(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.min(self.order).alias("first"), F.max(self.order).alias("last"))

    def arg_extremes(self) -> DataFrame:
        """The orders of the first minimum and the first maximum."""
        v, o = F.col(self.value), F.col(self.order)
        low = F.min(F.struct(v.alias("v"), o.alias("o")))["o"]
        high = F.min(F.struct((-v).alias("v"), o.alias("o")))["o"]
        return self.df.groupBy(*self.by).agg(low.alias("arg_min"), high.alias("arg_max"))

    def is_sorted(self, value: bool = True) -> DataFrame:
        """One row for each series: whether its values never fall."""
        ok, = hidden(self.df, "ok")
        rows = self._near(1, 0, {ok: lambda w: F.coalesce(F.lag(self.value).over(w) <= F.col(self.value), F.lit(True))})
        return rows.groupBy(*self.by).agg(F.bool_and(ok).alias("is_sorted"))

    def span(self, low, high, inside: bool = True) -> DataFrame:
        got = F.col(self.order).between(low, high)
        return self.df.filter(got if inside else ~got)

    def crop(self, left: int, right: int) -> DataFrame:
        """Without the first and the last rows."""
        ok, = hidden(self.df, "ok")
        return self._near(left, right, {ok: lambda w: _inside(left, right, w)}).filter(F.col(ok)).drop(ok)

    def by_order(self, how: str = "mean") -> DataFrame:
        """One row for each order: the mean, the sum or the list of its values."""
        f = {"mean": F.avg, "sum": F.sum, "list": lambda c: F.sort_array(F.collect_list(c))}[how]
        return self.df.groupBy(*self.by, self.order).agg(f(self.value).alias(self.value))

    def drop_row(self, n: int) -> DataFrame:
        """Without the row of place n (from 0)."""
        number, = hidden(self.df, "number")
        return self._numbered(number).filter(F.col(number) != n + 1).drop(number)

    def intersect(self, other: "Series") -> DataFrame:
        """As many first rows as the other series has."""
        n, size = hidden(self.df, "n", "size")
        sizes = other.df.groupBy(*(F.col(c).alias(m) for c, m in zip(other.by, self.by, strict=True))).agg(F.count(F.lit(1)).alias(size))
        return _joined(self._numbered(n), sizes, self.by).filter(F.col(n) <= F.col(size)).drop(n, size)

    def mutual_borders(self, other: "Series") -> DataFrame:
        """(first, last) of the keys that both series reach over; no row where they do not overlap."""
        ends = lambda s: s.df.groupBy(*s.by).agg(F.min(s.order).alias("first"), F.max(s.order).alias("last"))
        both = ends(self).unionByName(ends(other)).groupBy(*self.by).agg(F.count(F.lit(1)).alias("__n"), F.max("first").alias("first"), F.min("last").alias("last"))
        return both.filter((F.col("__n") == 2) & (F.col("first") < F.col("last"))).drop("__n")

    def distance(self, to, absolute: bool = True, name: str = "distance") -> DataFrame:
        """(series key, order, distance): from a fixed key, or from the nearest key of another series."""
        dates = dict(self.df.dtypes)[self.order] == "date"
        if not isinstance(to, Series):
            got = _gap(F.col(self.order), F.lit(to), dates)
            return self.df.select(*self.by, self.order, (F.abs(got) if absolute else got).alias(name))
        got = nearest(to._ones(), self.df.select(*self.by, self.order), self.order)
        signed = _gap(F.col("nearest_key"), F.col(self.order), dates)
        return got.select(*self.by, self.order, (F.abs(signed) if absolute else signed).alias(name))

    # Dates

    def first_year(self) -> DataFrame:
        return self._within(lambda low, high: F.col(self.order) <= F.add_months(low, 12))

    def last_year(self) -> DataFrame:
        return self._within(lambda low, high: F.col(self.order) >= F.add_months(high, -12))

    def crop_days(self, left: int, right: int) -> DataFrame:
        return self._within(lambda low, high: F.col(self.order).between(F.date_add(low, left), F.date_sub(high, right)))

    def shift_dates(self, days: int) -> DataFrame:
        return self.df.withColumn(self.order, F.date_add(self.order, days))

    def yearly_shift(self, step: int = 1) -> DataFrame:
        """Each date a year later (or step years)."""
        return self.df.withColumn(self.order, F.add_months(self.order, 12 * step))

    def to_int(self, scale: str) -> DataFrame:
        """Dates as absolute numbers of the scale."""
        return self.df.withColumn(self.order, date_to_int(self.order, scale))

    def to_years(self, decimal: bool = True) -> DataFrame:
        return self.df.withColumn(self.order, year_decimal(self.order) if decimal else F.year(self.order))

    def _within(self, condition) -> DataFrame:
        low, high = hidden(self.df, "low", "high")
        ends = self._facts(**{low: F.min(self.order), high: F.max(self.order)})
        return ends.filter(condition(F.col(low), F.col(high))).drop(low, high)

    def _ones(self) -> "Series":
        """The series' keys, each with a value."""
        one, = hidden(self.df, "one")
        return Series(self.df.withColumn(one, F.lit(1.0)), self.order, one, self.by, self.split, self.block)

    def smooth_days(self, days: int, name: str = "smoothed") -> DataFrame:
        """The mean over a range of days around each date: days // 2 before, and one more after where days is odd."""
        day, block, total, n = hidden(self.df, "day", "block", "total", "n")
        back, ahead = days // 2, days // 2 + days % 2
        rows = self.df.withColumn(day, F.unix_date(F.col(self.order)))
        # Days are summed first, so a window holds one row a day; a block is so many days, and sees those around it.
        sums = rows.groupBy(*self.by, day).agg(F.sum(self.value).alias(total), F.count(self.value).alias(n))
        width = max(days, 366)
        seen = F.sequence(F.floor((F.col(day) - ahead) / width), F.floor((F.col(day) + back) / width))
        window = Window.partitionBy(*self.by, block).orderBy(day).rangeBetween(-back, ahead)
        means = sums.withColumn(block, F.explode(F.coalesce(seen, F.array(F.lit(None).cast("long"))))).withColumn(name, F.sum(total).over(window) / F.sum(n).over(window))
        own = means.filter(F.col(block).eqNullSafe(F.floor(F.col(day) / width))).select(*self.by, day, name)
        return _joined(rows, own, (*self.by, day)).drop(day)

    def round_to(self, scale: str) -> DataFrame:
        return self.df.withColumn(self.order, F.trunc(self.order, scale)).groupBy(*self.by, self.order).agg(F.avg(self.value).alias(self.value))

    def yoy(self, name: str = "yoy") -> DataFrame:
        """The relative change against the (interpolated) value of a year before; null where there is none."""
        earlier, before = hidden(self.df, "earlier", "before")
        asked = self.df.select(*self.by, self.order, self.value, F.add_months(self.order, -12).alias(earlier))
        got = interpolate(self, asked, earlier, before, outside=False)
        return got.select(*self.by, self.order, self.value, lift(before, self.value).alias(name))


def _reach(offsets: tuple[int, ...]) -> tuple[int, int]:
    return max(0, *(-o for o in offsets), 0), max(0, *offsets, 0)


def _inside(before: int, after: int, w: WindowSpec) -> Column:
    """Whether so many rows of the series stand before and behind a row."""
    return F.lag(F.lit(1), before).over(w).isNotNull() & F.lead(F.lit(1), after).over(w).isNotNull()


def _joined(rows: "DataFrame | Series", facts: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """rows with the facts of their series, nulls matching nulls: one row for each series key, one in all without a key."""
    rows = rows.df if isinstance(rows, Series) else rows
    if by:
        keys = hidden([rows, facts], *(f"key{i}" for i in range(len(by))))
        facts = facts.withColumnsRenamed(dict(zip(by, keys, strict=True)))
        return rows.join(facts, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True))), how).drop(*keys)
    one, = hidden([rows, facts], "one")
    return rows.withColumn(one, F.lit(1)).join(F.broadcast(facts.withColumn(one, F.lit(1))), one, how).drop(one)


def _around(series: Series, known: DataFrame, payload: Column, asked: DataFrame, at: str) -> tuple[DataFrame, Column, Column]:
    """asked, with the payloads of the known rows at or before, and at or after, each `at`: two columns, which the caller selects from and leaves out.

    An as-of join without a join: both sides' keys are sorted together, and the last and the next known row carry over.
    Each side moves once; no pairs are made.
    """
    key, kind, row, ask, before, after = hidden([known, asked], "key", "kind", "row", "ask", "before", "after")
    known = known.filter(F.col(series.order).isNotNull()).select(*series.by, F.col(series.order).alias(key), F.lit(0).alias(kind), F.struct(F.col(series.order).alias("k"), payload.alias("of")).alias(row))
    wanted = asked.select(*series.by, F.col(at).alias(key), F.lit(1).alias(kind), F.struct(*asked.columns).alias(ask))
    both = known.unionByName(wanted, allowMissingColumns=True)
    order = [key, kind, row]  # known rows before asked ones of the same key
    if series.split:
        out = Blocks(both, series.by, order, series.block).running({before: ("last", F.col(row))}, {after: ("last", F.col(row))}).df
    else:
        # Both frames grow from one end, so a row costs the same however long the series: the next row is the last one of the falling order.
        last = lambda o: F.last(row, ignorenulls=True).over(Window.partitionBy(*series.by).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = both.withColumn(before, last([F.col(c).asc() for c in order])).withColumn(after, last([F.col(c).desc() for c in order]))
    hit = F.col(f"{before}.k") == F.col(key)
    out = out.filter(F.col(kind) == 1).withColumn(after, F.when(hit, F.col(before)).when(F.col(key).isNotNull(), F.col(after)))
    return out.select(f"{ask}.*", before, after), F.col(before), F.col(after)


def brackets(series: Series, asked: DataFrame, at: str, names: tuple[str, str, str, str] = ("k0", "v0", "k1", "v1")) -> DataFrame:
    """asked, with the series' rows around each `at`: k0, v0 (at or before) and k1, v1 (at or after), or by other names.

    Rows without a value or an order are not known; of known rows of equal order the last one by value stands before, the
    first one behind. A null `at` has no neighbours. All rows asked for stay, repeated ones too.
    """
    free(asked, *names)
    out, before, after = _around(series, series.df.filter(F.col(series.value).isNotNull()), F.col(series.value), asked, at)
    return out.select(*asked.columns, before["k"].alias(names[0]), before["of"].alias(names[1]), after["k"].alias(names[2]), after["of"].alias(names[3]))


def _gap(a: Column, b: Column, dates: bool) -> Column:
    return F.datediff(a, b) if dates else a - b


def nearest(series: Series, asked: DataFrame, at: str) -> DataFrame:
    """asked, with the nearest known row (nearest_key, nearest_value) and its distance; of two equally near ones the earlier."""
    free(asked, "nearest_key", "nearest_value", "distance")
    dates, names = dict(series.df.dtypes)[series.order] == "date", hidden(asked, "k0", "v0", "k1", "v1")
    b = brackets(series, asked, at, tuple(names))
    k0, v0, k1, v1 = map(F.col, names)
    d0, d1 = _gap(F.col(at), k0, dates), _gap(k1, F.col(at), dates)
    low = k1.isNull() | F.coalesce(d0 <= d1, F.lit(False))
    pick = lambda x, y: F.when(low, x).otherwise(y)
    return b.select(*asked.columns, pick(k0, k1).alias("nearest_key"), pick(v0, v1).alias("nearest_value"), pick(d0, d1).alias("distance"))


def interpolate(series: Series, asked: DataFrame, at: str, name: str = "value", outside: bool = True) -> DataFrame:
    """asked, with the linearly interpolated value; outside the known keys the nearest end's, or null."""
    free(asked, name)
    dates, names = dict(series.df.dtypes)[series.order] == "date", hidden(asked, "k0", "v0", "k1", "v1")
    b = brackets(series, asked, at, tuple(names))
    k0, v0, k1, v1 = map(F.col, names)
    inner = v0 + (v1 - v0) * _gap(F.col(at), k0, dates) / _gap(k1, k0, dates)
    ends = F.coalesce(v0, v1) if outside else F.lit(None)
    got = F.when(k0.isNull() | k1.isNull(), ends).when(k0 == k1, v0).otherwise(inner)
    return b.select(*asked.columns, got.alias(name))


def value_at(series: Series, asked: DataFrame, at: str, name: str = "value") -> DataFrame:
    """asked, with the value of an equal key, or else the linearly interpolated one."""
    return interpolate(series, asked, at, name)


def _marked(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, written: equal rows stay apart, and no later plan numbers them again."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def base_dates(series: Series, asked: DataFrame, at: str, within: int = 31, name: str = "base", fallback: bool = True, anniversary: bool = False, increment: str | None = None) -> DataFrame:
    """asked, with the series' date that lies nearest to a yearly anniversary of `at`, the fewest years away.

    An anniversary counts if it lies inside the series and within so many days of one of its dates; if none does, fallback
    takes the nearest one of any distance. anniversary: that day itself and not the series' date; increment: names a column
    for the whole years from it to `at`. Null where `at` is null or no anniversary lies inside. All rows asked for stay.
    """
    free(asked, name, *([increment] if increment else []))
    mark, first, last, day, best = hidden([series.df, asked], "mark", "first", "last", "day", "best")
    ends = series.df.groupBy(*series.by).agg(F.min(series.order).alias(first), F.max(series.order).alias(last))
    marked = _marked(asked, mark)
    years = F.sequence(F.year(first) - F.year(at), F.year(last) - F.year(at))
    days = F.filter(F.transform(years, lambda y: F.add_months(F.col(at), (12 * y).cast("int"))), lambda d: d.between(F.col(first), F.col(last)))
    candidates = _joined(marked, ends, series.by, "left").select(*series.by, mark, F.col(at).alias(best), F.explode(days).alias(day))
    got = nearest(series._ones(), candidates, day)
    far, away = F.col("distance") > within, F.abs(F.datediff(day, best))
    choice = F.struct(far.alias("far"), away.alias("away"), F.col("nearest_key").alias("key"), F.col(day).alias("day"))
    got = got.groupBy(mark).agg(F.min(choice if fallback else F.when(~far, choice)).alias(best))
    base = F.col(best)["day" if anniversary else "key"]
    out = _joined(marked, got, (mark,), "left")
    return out.select(*asked.columns, base.alias(name), *([F.round(F.datediff(at, base) / 365).cast("int").alias(increment)] if increment else []))


def interpolated_windows(series: Series, days: list[int], function: Callable[[Column], Column], name: str = "value", full: bool = False) -> DataFrame:
    """(series key, order, value) for each row: function of the array of interpolated values so many days around its date; full: only dates whose window lies inside the series."""
    s = series.with_df(series._within(lambda low, high: F.col(series.order).between(F.date_add(low, max(0, -min(days))), F.date_sub(high, max(0, max(days)))))) if full else series
    mark, place, i, d, v = hidden(s.df, "mark", "place", "i", "d", "v")
    rows = _marked(s.df.select(*s.by, s.order), mark)
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("i"), F.date_add(F.col(s.order), x).alias("d")) for n, x in enumerate(days)))).alias(place)
    asked = rows.select(*s.by, s.order, mark, places).select(*s.by, s.order, mark, F.col(f"{place}.i").alias(i), F.col(f"{place}.d").alias(d))
    got = interpolate(series, asked, d, v).groupBy(*s.by, s.order, mark).agg(F.transform(F.sort_array(F.collect_list(F.struct(i, v))), lambda x: x[v]).alias(v))  # len(days) values
    return got.select(*s.by, s.order, function(F.col(v)).alias(name))


def weighted_interpolation(series: Series, benchmark: Series, asked: DataFrame, at: str, name: str = "value") -> DataFrame:
    """Linear interpolation, times the benchmark's value on the day over the benchmark's interpolation between the series' own dates.

    The primary series says how much, the benchmark says when within the year.
    """
    free(asked, name)
    level, linear, day, base = hidden([series.df, asked], "level", "linear", "day", "base")
    own = interpolate(benchmark, series.df.filter(F.col(series.value).isNotNull()).select(*series.by, series.order), series.order, level)
    rows = interpolate(benchmark, interpolate(series, asked, at, linear), at, day)
    got = interpolate(Series(own, series.order, level, series.by, series.split, series.block), rows, at, base)
    return got.select(*asked.columns, F.when(F.col(base) != 0, F.col(linear) * F.col(day) / F.col(base)).alias(name))


def date_grid(series: Series, scale: str = "day", step: int = 1) -> DataFrame:
    """Each date of the scale between a series' first and last, as column `order`."""
    ends = series.borders()
    return ends.select(*series.by, F.explode(F.sequence(F.trunc("first", scale) if scale != "day" else F.col("first"), F.col("last"), F.expr(f"interval {step} {scale}"))).alias(series.order))


def resample(series: Series, scale: str = "day") -> DataFrame:
    return interpolate(series, date_grid(series, scale), series.order, series.value)


def extrapolate_by_yoy(series: Series, growth: float, until: datetime.date, scale: str = "month") -> DataFrame:
    """Dates after the last one up to `until`: the value a whole number of years before, times (1 + growth) to that number."""
    ends = series.borders()
    grid = ends.select(*series.by, "first", "last", F.explode(F.sequence(F.trunc("last", scale), F.lit(until), F.expr(f"interval 1 {scale}"))).alias(series.order)).filter(F.col(series.order) > F.col("last"))
    years = F.ceil(F.months_between(series.order, "last") / 12).cast("int")
    asked = grid.withColumn("years", F.greatest(years, F.lit(1))).withColumn("__base", F.add_months(series.order, -12 * F.col("years")))
    got = interpolate(series, asked, "__base", "__v")
    return got.select(*series.by, series.order, (F.col("__v") * F.pow(F.lit(1 + growth), F.col("years"))).alias(series.value))


def _number(df: DataFrame, c: str) -> Column:
    """An order as a number: dates in days, times in seconds, all others as they are."""
    kind = dict(df.dtypes)[c]
    return (F.unix_date(c) if kind == "date" else F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(c)).cast("double")


def spline(series: Series, asked: DataFrame, at: str, name: str = "value") -> DataFrame:
    """asked, with the value of the cubic not-a-knot spline through the series; linear below four known rows, null outside.

    The second derivatives solve a tridiagonal system over all knots of a series. Each block of knots is eliminated by
    itself, up to the two values beside it; a small system of two unknowns a block, solved for each series, gives these,
    and each block is completed from them. So a series of any length takes as many tasks as it has blocks, and only its
    blocks' ends meet in one. Of knots of equal order the least value counts.
    """
    free(asked, name)
    x, y, h0, h1, x0, x3, ends, m = hidden([series.df, asked], "x", "y", "h0", "h1", "x0", "x3", "ends", "m")
    by, order, a, b, c, r = series.by, series.order, *hidden([series.df, asked], "a", "b", "c", "r")
    known = series.df.filter(F.col(series.value).isNotNull() & F.col(order).isNotNull())
    knots = known.groupBy(*by, order).agg(F.min(series.value).cast("double").alias(y)).withColumn(x, _number(known, order))
    gap = lambda u, v: F.col(u) - F.col(v)
    blocks = Blocks(knots, by, [order], series.block).near(2, 2, {
        h0: lambda w: F.col(x) - F.lag(x).over(w), h1: lambda w: F.lead(x).over(w) - F.col(x), x0: lambda w: F.lag(x, 2).over(w), x3: lambda w: F.lead(x, 2).over(w),
        r: lambda w: 6 * ((F.lead(y).over(w) - F.col(y)) / F.col(h1) - (F.col(y) - F.lag(y).over(w)) / F.col(h0)),
    })
    first, last, low, high = F.col(x0).isNull(), F.col(x3).isNull(), F.col(h0), F.col(h1)
    three, both = first & last, low + high
    # The ends' conditions leave the first and the last unknown out of their neighbours' equations; three knots make a line.
    band = {
        a: F.when(first, 0.0).when(last, low - high * high / low).otherwise(low),
        b: F.when(three, 1.0).otherwise(2 * both + F.when(first, low * both / high).otherwise(0.0) + F.when(last, high * both / low).otherwise(0.0)),
        c: F.when(last, 0.0).when(first, high - low * low / high).otherwise(high),
        r: F.when(three, 0.0).otherwise(F.col(r)),
    }
    inner = blocks.rows.filter(F.col(h0).isNotNull() & F.col(h1).isNotNull()).select(*by, order, x, y, blocks.place, blocks.block, *(v.alias(k) for k, v in band.items()))
    inner = written(eliminated(inner, by, blocks.block, blocks.place, (a, b, c, r)), "eliminated")
    inner = solved(inner, by, blocks.block, blocks.place, (a, b, c), m).select(*by, order, m)
    # The first and the last second derivative follow from the two beside them.
    known = _joined(blocks.rows.select(*by, order, x, y), inner, (*by, order), "left")

    def end(w: WindowSpec) -> Column:
        near, further = lambda f: f(m, 1).over(w), lambda f: f(m, 2).over(w)
        g0, g1 = F.lead(x).over(w) - F.col(x), F.lead(x, 2).over(w) - F.lead(x).over(w)
        e1, e0 = F.col(x) - F.lag(x).over(w), F.lag(x).over(w) - F.lag(x, 2).over(w)
        begin = ((g0 + g1) * near(F.lead) - g0 * further(F.lead)) / g1
        close = ((e0 + e1) * near(F.lag) - e1 * further(F.lag)) / e0
        return F.coalesce(F.col(m), F.when(F.lag(x).over(w).isNull(), begin).otherwise(close), F.lit(0.0))

    known = Blocks(known, by, [order], series.block).near(2, 2, {ends: end}).df
    whole = Series(known, order, y, by, True, series.block)
    out, before, after = _around(whole, known, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(ends).alias("m")), asked, at)
    p, q, here = before["of"], after["of"], _number(asked, at)
    h, t, u = q["x"] - p["x"], here - p["x"], q["x"] - here
    got = (p["m"] * u * u * u + q["m"] * t * t * t) / (6 * h) + (p["y"] / h - p["m"] * h / 6) * u + (q["y"] / h - q["m"] * h / 6) * t
    return out.select(*asked.columns, F.when(p.isNull() | q.isNull(), None).when(h == 0, p["y"]).otherwise(got).alias(name))
