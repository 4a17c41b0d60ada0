"""Projection, filters, joins, grouping, order and set operators."""

from collections.abc import Callable
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.basic import equal, truthy
from tessera.names import hidden
from tessera.shared import settings, written

#: Right sides of up to so many bytes, by Spark's estimate, may be broadcast when a caller asks for a map-side join.
BROADCAST_BYTES = 64 << 20
#: A sort of a whole table by range: shuffled bytes of a task, and the least number of ranges that are joined up to them (beyond 200 Spark's tasks that deal the rows out hold them in memory).
SORT_BYTES, SORT_RANGES = 16 << 20, 200
#: In joins that match nulls, rows without a key are one hot key: they are dealt to so many parts on each side of an inner join.
NULL_PARTS = 8
#: An inner join makes their pairs from packs of up to so many rows of a side, which are numbered within so many buckets.
PACK, PACK_BUCKETS = 256, 64


def _inputs(description) -> tuple[Callable | None, list[str]]:
    """A description as (function, input fields): a name, (function, *fields) or (*fields, function)."""
    if isinstance(description, str):
        return None, [description]
    if isinstance(description, (tuple, list)):
        functions = [x for x in description if callable(x) and not isinstance(x, Column)]
        return (functions[0] if functions else None), [x for x in description if isinstance(x, str)]
    return None, []


def _column(target: str, description) -> Column:
    if isinstance(description, Column):
        return description
    function, fields = (description, [target]) if callable(description) else _inputs(description)
    if function is None:
        return F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    return function(*fields)


def expression_order(expressions: dict[str, Any]) -> list[str]:
    """Names in an order in which every expression follows those it reads; cycles keep the order given."""
    graph = {name: {f for f in _inputs(d)[1] if f in expressions and f != name} for name, d in expressions.items()}
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError:
        return list(expressions)


def select(df: DataFrame, *fields: str, **expressions) -> DataFrame:
    """Fields ("*" for all, "-name" to leave one out), then expressions, which may read one another's results.

    Spark resolves a name of one select to the input's column, so dependent expressions are a chain of withColumn.
    """
    order = expression_order(expressions)
    out = df
    for name in order:
        out = out.withColumn(name, _column(name, expressions[name]))
    gone = {f[1:] for f in fields if f.startswith("-")}
    names: list[str] = []
    for f in fields or (() if expressions else ("*",)):
        names += df.columns if f == "*" else [] if f.startswith("-") else [f]
    if gone and not names:
        names = list(df.columns)
    names = [n for n in dict.fromkeys([*names, *order]) if n not in gone]
    return out.select(*names)


def where(df: DataFrame, *conditions, **expressions) -> DataFrame:
    """Rows for which all hold: columns, bare fields (truth), field=literal (equal) or field=function."""
    kinds = dict(df.dtypes)
    parts = [c if isinstance(c, Column) else truthy(c, kinds[c] == "string") for c in conditions]
    parts += [v(k) if callable(v) else equal(k, v) for k, v in expressions.items()]
    return df.filter(reduce(lambda a, b: a & b, parts)) if parts else df


def enumerate_rows(df: DataFrame, *order: str, field: str = "#", first: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a row number from `first` by the given order, within groups if `by` is given.

    Without groups the number is global and needs no single task: partitions are sorted by range, counted, and each adds
    the counts before it. The sorted rows are written to the shared folder with their partition and place as one column:
    a plan that reads them twice could choose other ranges for the counts than for the rows.
    """
    if by:
        return df.withColumn(field, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + first)
    return dense(sorted_rows(df, *order, place="__place"), "__place", field, first).select(*dict.fromkeys([*df.columns, field]))


def sorted_rows(df: DataFrame, *order, place: str) -> DataFrame:
    """df sorted by range and written, with a column that rises with the order: the partition's number and, in the low 33 bits, the row's place in it.

    Ranges are many and small, and Spark joins neighbours up to SORT_BYTES: a task sorts no more rows where the table grows.
    """
    spark = df.sparkSession
    size, ranges = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    bytes_ = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)))
    most = max(SORT_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(ranges, None) or 0))
    with settings(spark, {size: str(min(bytes_, SORT_BYTES)), ranges: str(most)}):
        return written(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()), "sorted")


def dense(rows: DataFrame, place: str, field: str, first: int = 0) -> DataFrame:
    """sorted_rows with numbers without gaps in the column `field`."""
    at = "__partition"
    rows = rows.withColumn(at, F.shiftright(place, 33))
    counts = rows.groupBy(at).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    # Broadcast: one row for each partition, however many rows there are.
    out = rows.join(F.broadcast(counts.select(at, before.alias("__before"))), at)
    return out.withColumn(field, F.col(place).bitwiseAND((1 << 33) - 1) + F.col("__before") + first).drop(at, "__before")


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _cells(df: DataFrame, keys: list[str], mine: int, its: int, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """df with a column __cell: rows with a null key are dealt to `mine` parts by their values and copied to each of the other side's `its` parts; all others stay in cell 0."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    hashed = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    part = F.pmod(F.xxhash64(*(F.col(c) for c in hashed)), F.lit(mine)) if mine > 1 else F.lit(0).cast("long")
    cells = F.array(*(cell(part, F.lit(i).cast("long")) for i in range(its)))
    zero = F.lit(0).cast("long")
    return df.withColumn("__cell", F.explode(F.when(null, cells).otherwise(F.array(zero))) if its > 1 else F.when(null, cells[0]).otherwise(zero))


def _packs(df: DataFrame, keys: list[str], name: str, cell: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of df with a null key as lists `name` of up to PACK rows of equal keys. Each list is dealt to one of NULL_PARTS parts and copied to the other side's; {name}_at hashes its keys and cell."""
    # A list holds the same rows whenever it is made again: rows of equal hashes are equal.
    plain = lambda c, t: F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c)
    given, copies = [f"__k{i}" for i in range(len(keys))], F.sequence(F.lit(0), F.lit(NULL_PARTS - 1))
    rows = df.filter(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys)))
    rows = rows.select(*(F.col(k).alias(g) for k, g in zip(keys, given, strict=True)), F.xxhash64(*(plain(c, t) for c, t in df.dtypes)).alias("__hash"), F.struct(*df.columns).alias("__row"))
    rows = rows.withColumn("__bucket", F.pmod("__hash", F.lit(PACK_BUCKETS)).cast("int"))
    place = F.row_number().over(Window.partitionBy(*given, "__bucket").orderBy("__hash"))
    rows = rows.withColumn("__pack", F.floor((place - 1) / PACK)).groupBy(*given, "__bucket", "__pack").agg(F.collect_list("__row").alias(name))
    part = F.pmod(F.col("__bucket") + F.col("__pack"), F.lit(NULL_PARTS))
    return rows.select(*given, name, part.alias("__part"), F.explode(copies).alias("__copy")).select(F.xxhash64(*given, cell(F.col("__part"), F.col("__copy"))).alias(f"{name}_at"), name)


def _null_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join, nulls matching nulls, of the rows with a null key alone; the right side's columns begin with __r_.

    Two lists of rows give all their pairs one after another: of the columns of one side a value stays for up to PACK rows,
    and those of the other come again after as many, so that files of the pairs take little room whichever way Spark joins the lists.
    """
    l = _packs(left, keys, "__l_rows", lambda mine, its: mine * NULL_PARTS + its)  # noqa: E741
    r = _packs(right, [f"__r_{k}" for k in keys], "__r_rows", lambda mine, its: its * NULL_PARTS + mine)
    # By number: Spark would join small partitions to few, though each makes many rows.
    l, r = (df.repartition(3 * NULL_PARTS * NULL_PARTS, at) for df, at in ((l, "__l_rows_at"), (r, "__r_rows_at")))  # noqa: E741
    # Hashes may agree by chance, so the keys are compared as well; in a form that Spark does not take for keys of the join, which it would deal rows by anew.
    mine, its = (lambda k: F.col("__l_rows")[0][k]), (lambda k: F.col("__r_rows")[0][f"__r_{k}"])
    on = reduce(lambda a, b: a & b, (F.coalesce(mine(k) == its(k), mine(k).isNull() & its(k).isNull()) for k in keys))
    lists = l.join(r, (F.col("__l_rows_at") == F.col("__r_rows_at")) & on)
    return lists.select(F.explode("__l_rows").alias("__l"), "__r_rows").select("__l.*", F.explode("__r_rows").alias("__r")).select(*left.columns, "__r.*")


def join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", right_is_uniq: bool = False, last_by: str | None = None, null_safe: bool = True, map_side: bool = False, right_is_distinct: bool = False) -> DataFrame:
    """An equi-join in which nulls match nulls and the right side's columns overwrite the left's of the same name.

    how: left, inner, right, full, outer (as left), or xor (rows of either side that the other lacks).
    right_is_uniq: one row of the right side for each key, the last by last_by; else equal right rows count once.
    right_is_distinct: the caller knows that no two right rows are equal, which saves a shuffle of the right side.
    map_side: broadcast the right side if Spark's estimate stays below BROADCAST_BYTES; otherwise Spark chooses.
    All left rows without a key meet all such right rows. Inner, left and right joins deal these pairs to 64 or 16 parts, so that no task makes them all; full and xor do not.
    Inner joins make these pairs apart from all others, list by list (see _null_pairs), and so read each side twice; where the sides' keys differ in type, or are collated, they deal rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in right.columns if c not in keys]
    if right_is_uniq and others:
        # The last row is kept by an aggregate, which combines rows before they move; nulls of last_by come first.
        rank = F.struct(F.col(last_by).isNotNull().alias("a"), F.col(last_by).alias("b"), *(F.col(c) for c in others)) if last_by else F.struct(*right.columns)
        right = right.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("__v")).select(*(F.col(c) if c in keys else F.col(f"__v.{c}") for c in right.columns))
    elif not right_is_distinct:
        right = right.distinct()
    r = right.select(*(F.col(c).alias(f"__r_{c}") for c in right.columns), F.lit(True).alias("__right"))
    l = left.withColumn("__left", F.lit(True))  # noqa: E741
    sent = map_side and how in ("left", "outer", "inner") and _estimated_bytes(right) <= BROADCAST_BYTES
    parts = {"inner": (NULL_PARTS, NULL_PARTS), "left": (2 * NULL_PARTS, 1), "outer": (2 * NULL_PARTS, 1), "right": (1, 2 * NULL_PARTS)}.get(how)
    dealt = null_safe and parts and not sent and any(left.schema[k].nullable and right.schema[k].nullable for k in keys)
    packed = dealt and how == "inner" and all(left.schema[k].dataType == right.schema[k].dataType and "collate" not in left.schema[k].dataType.simpleString() for k in keys)
    apart = _null_pairs(l, r, keys) if packed else None
    if dealt and not packed:
        # The rows of an outer side are never copied, so that each is kept once where it matches nothing.
        l = _cells(l, keys, parts[0], parts[1], lambda mine, its: mine * parts[1] + its)  # noqa: E741
        r = _cells(r, [f"__r_{k}" for k in keys], parts[1], parts[0], lambda mine, its: its * parts[1] + mine).withColumnRenamed("__cell", "__r_cell")
    on = reduce(lambda a, b: a & b, (l[k].eqNullSafe(r[f"__r_{k}"]) if null_safe and not packed else l[k] == r[f"__r_{k}"] for k in keys))
    if dealt and not packed:
        on = on & (l["__cell"] == r["__r_cell"])
    if sent:
        r = F.broadcast(r)
    joined = l.join(r, on, {"outer": "left", "xor": "full"}.get(how, how))
    if packed:
        joined = joined.unionByName(apart)
    if how == "xor":
        joined = joined.filter("__left is null or __right is null")
    out = []
    for c in left.columns:
        if c in right.columns:
            mine, its = F.col(c), F.col(f"__r_{c}")
            out.append(F.when(F.col("__right").isNull(), mine).otherwise(its).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"__r_{c}").alias(c) for c in right.columns if c not in left.columns]
    return joined.select(*out)


def semi(left: DataFrame, right: DataFrame, key: str | list[str], anti: bool = False) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    r = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys))
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys))
    return left.join(r, on, "left_anti" if anti else "left_semi")


def group_fold(df: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """One row for each key, each value column a list in the given order, nulls kept."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *values)))
    out = df.groupBy(*keys).agg(rows.alias("__rows"))
    return out.select(*keys, *(F.col("__rows")[v].alias(v) for v in values))


def group_fold_parts(df: DataFrame, keys: list[str], values: list[str], order: str, size: int = 1 << 12, part: str = "part") -> DataFrame:
    """group_fold in parts: a row for each `size` rows of a key, in the given order, numbered from 0. No row holds a hot key's whole list, and no task its rows."""
    from tessera.names import free
    from tessera.operators.scan import Blocks

    free(df, part)
    n, rows = hidden(df, "n", "rows")
    numbered = Blocks(df.select(*dict.fromkeys([*keys, order, *values])), tuple(keys), [order]).running({n: ("sum", F.lit(1).cast("long"))}).df
    numbered = numbered.withColumn(part, F.floor((F.col(n) - 1) / size))
    out = numbered.groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct(n, *values))).alias(rows))  # at most `size` values
    return out.select(*keys, part, *(F.col(rows)[v].alias(v) for v in values))


def unfold_parts(df: DataFrame, lists: list[str], number: str = "n", part: str = "part", size: int = 1 << 12) -> DataFrame:
    """The rows of group_fold_parts, numbered through a key's parts from 0. size as it was for the fold."""
    out = unfold(df, lists, number)
    return out.withColumn(number, F.col(part) * size + F.col(number)).drop(part)


def unfold(df: DataFrame, lists: list[str], number: str = "n", default=0) -> DataFrame:
    """A row for each place of the parallel lists, with its number; shorter lists are filled up with the default."""
    size = F.greatest(*(F.size(c) for c in lists)) if len(lists) > 1 else F.size(lists[0])
    filled = [F.concat(F.col(c), F.array_repeat(F.lit(default).cast(dict(df.dtypes)[c][6:-1]), size - F.size(c))).alias(c) for c in lists]
    rest = [c for c in df.columns if c not in lists]
    out = df.select(*rest, *filled).select(*rest, F.posexplode(F.arrays_zip(*lists)).alias(number, "__x"))
    return out.select(*rest, number, *(F.col("__x")[c].alias(c) for c in lists))


def run_id(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = (), name: str = "run") -> DataFrame:
    """Numbers the runs of consecutive equal keys in the given order, within groups; without groups in blocks, so that no task holds all rows."""
    if not by:
        from tessera.operators.scan import runs

        return runs(df, keys, order, name=name)
    w = Window.partitionBy(*by).orderBy(*order)
    changed = reduce(lambda a, b: a | b, (~F.col(k).eqNullSafe(F.lag(k).over(w)) for k in keys)) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", changed.cast("int")).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def uniq(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = (), everywhere: bool = False) -> DataFrame:
    """Drops rows whose keys equal those of the row before (without groups in blocks); with everywhere=True all but the first row of each key."""
    if everywhere:
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    if not by:
        from tessera.operators import scan

        return scan.uniq(df, keys, order)
    w = Window.partitionBy(*by).orderBy(*order)
    changed = reduce(lambda a, b: a | b, (~F.col(k).eqNullSafe(F.lag(k).over(w)) for k in keys)) | (F.row_number().over(w) == 1)
    return df.withColumn("__new", changed).filter("__new").drop("__new")


def sum_by_keys(df: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counters))


def first_values(df: DataFrame, fields: list[str], order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The first value of each field, in the given order, that is neither null nor zero nor empty."""
    kinds = dict(df.dtypes)
    best = [F.min_by(F.col(f), F.when(truthy(f, kinds[f] == "string"), F.col(order))).alias(f) for f in fields]
    ok = [F.max(truthy(f, kinds[f] == "string")) for f in fields]
    return df.groupBy(*keys).agg(*(F.when(o, b).alias(f) for o, b, f in zip(ok, best, fields, strict=True)))


def sort(df: DataFrame, *keys: str, reverse: bool = False) -> DataFrame:
    return df.orderBy(*(F.col(k).desc() if reverse else F.col(k).asc() for k in keys))


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of the order, or the last -n."""
    return df.orderBy(*order).limit(n) if n >= 0 else df.orderBy(*(F.col(o).desc() for o in order)).limit(-n)


def skip(df: DataFrame, n: int, *order: str) -> DataFrame:
    """All but the first n rows of the order, in that order. Rows are numbered as by enumerate_rows: an offset would bring them all to one task."""
    number, = hidden(df, "number")
    return enumerate_rows(df, *order, field=number).filter(F.col(number) >= n).orderBy(number).drop(number)


def top_n_by(df: DataFrame, field: str, by: str | None = None, n: int = 10) -> DataFrame:
    """The n values of field with the largest sum of `by` (or the most rows), ties by value."""
    total = F.sum(by) if by else F.count(F.lit(1))
    return df.groupBy(field).agg(total.alias("total")).orderBy(F.col("total").desc(), field).limit(n)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack(frames: "list[DataFrame] | dict[int | str, DataFrame]", name: str = "dataset") -> DataFrame:
    """All rows of all frames with the frame's name (of a list: its place, from 0); columns that a frame lacks are 0 or empty there. Its own nulls stay."""
    frames = frames if isinstance(frames, dict) else dict(enumerate(frames))
    kinds = {c: t for f in reversed(frames.values()) for c, t in f.dtypes}
    empty = lambda t: F.lit("") if t == "string" else F.lit(0).cast(t) if t in _NUMBERS or t.startswith("decimal") else F.lit(None).cast(t)
    return union(*(f.withColumns({c: empty(t) for c, t in kinds.items() if c not in f.columns}).withColumn(name, F.lit(k)) for k, f in frames.items()))


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def split_by_positions(df: DataFrame, positions: list[int], *order: str, number: str = "#") -> list[DataFrame]:
    rows, edges = enumerate_rows(df, *order, field=number), [0, *positions, None]
    return [rows.filter((F.col(number) >= a) & (F.col(number) < b) if b is not None else F.col(number) >= a) for a, b in zip(edges, edges[1:], strict=False)]


def split_by_condition(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which it does not hold, rows for which it does); nulls do not hold."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(~holds), df.filter(holds)


def split_by_number(df: DataFrame, number: Column, n: int) -> list[DataFrame]:
    return [df.filter(number == i) for i in range(n)]


def chunks(df: DataFrame, step: int, *order: str, field: str = "chunk") -> DataFrame:
    """Adds the number of the row's chunk of `step` consecutive rows."""
    return enumerate_rows(df, *order, field="__at").withColumn(field, F.floor(F.col("__at") / step)).drop("__at")


def add_sum_share(df: DataFrame, measure: str, by: list[str]) -> DataFrame:
    """Adds the group's sum and the row's share of it. Sums are combined before the shuffle and joined, so a hot group is no hot task; null keys are a group."""
    names = [f"__k{i}" for i in range(len(by))]
    sums = df.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.sum(measure).alias(f"{measure}_sum"))
    out = df.join(sums, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True))), "left").drop(*names)
    return out.withColumn(f"{measure}_share", F.when(F.col(f"{measure}_sum") != 0, F.col(measure) / F.col(f"{measure}_sum")))


def flat_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function(dict) gives any number of dicts. A slow path, for functions that no column expression can state."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([r for row in b.to_pylist() for r in function(row)], kind)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function(Arrow batch) gives a batch or table of the schema: for functions that no column expression can state but that work on whole columns."""

    def run(batches):
        for b in batches:
            out = function(b)
            yield from out.to_batches() if hasattr(out, "to_batches") else [out]

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return flat_map(df, lambda row: [function(row)], schema)


def transposed(df: DataFrame, *fields: str, order: str) -> DataFrame:
    """One row with the list of each field's values, in order: a report over few rows, as the lists are one row."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), *(F.col(c) for c in fields)))).alias("r"))
    return rows.select(*(F.col(f"r.{c}").alias(c) for c in fields))


def pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of each row."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value"))


def safe_apply(c: Column, default=None) -> Column:
    """The expression, or the default where it is null: Spark's try_ functions give null in place of an error."""
    return F.coalesce(c, F.lit(default))


def having_columns(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {', '.join(missing)}")
    return df


def dictionary(df: DataFrame, key: str, value: str, of_lists: bool = False) -> DataFrame:
    """(key, value), the largest value of each key, or the sorted list of them."""
    return df.groupBy(key).agg((F.sort_array(F.collect_list(value)) if of_lists else F.max(value)).alias(value))


