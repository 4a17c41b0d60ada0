"""Array functions."""

from pyspark.sql import functions as F

from tessera.functions.basic import col, value


def uniq(a):
    """Distinct elements in order of their first place."""
    return F.array_distinct(col(a))


def elem_no(a, n: int, default=None):
    """By place from 0; negative places count from the end."""
    got = F.get(col(a), F.lit(n) if n >= 0 else F.size(col(a)) + n)
    return got if default is None else F.coalesce(got, F.lit(default))


def first(a, n: int | None = None):
    return elem_no(a, 0) if n is None else F.slice(col(a), 1, n)


def second(a):
    return elem_no(a, 1)


def last(a, n: int | None = None):
    return elem_no(a, -1) if n is None else F.slice(col(a), F.greatest(F.size(col(a)) - n + 1, F.lit(1)), F.lit(n))


def subsequence(a, start: int = 0, end: int | None = None):
    size = F.size(col(a))
    stop = size if end is None else F.least(F.lit(end), size) if end >= 0 else size + end
    return F.slice(col(a), F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def values_not_none(a):
    return F.filter(col(a), lambda x: x.isNotNull())


def nonzero_values(a):
    return F.filter(col(a), lambda x: x.isNotNull() & (x != 0))


def numeric_values(a):
    """The elements that are numbers, or texts of numbers, as numbers; NaN is none."""
    got = F.transform(col(a), lambda x: x.try_cast("double"))
    return F.filter(got, lambda x: x.isNotNull() & ~F.isnan(x))


def list_minus(a, b):
    """The elements of a that b lacks, with repeats, in order."""
    return F.filter(col(a), lambda x: ~F.array_contains(col(b), x))


def compare_lists(a, b):
    """(a_only, b_only, common) as a struct; repeats and order stay."""
    return F.struct(list_minus(a, b).alias("a_only"), list_minus(b, a).alias("b_only"), F.filter(col(a), lambda x: F.array_contains(col(b), x)).alias("common"))


def shift_right(a, n: int, default=None):
    """All elements n places later (earlier for negative n), filled with the default."""
    fill, a = F.array_repeat(value(default), abs(n)), col(a)
    if n >= 0:
        return F.slice(F.concat(fill, a), F.lit(1), F.size(a))
    return F.slice(F.concat(a, fill), F.lit(1 - n), F.size(a))


def shifted(a, b, function, shifts: range):
    """function(a, b shifted by d) for each d, as an array."""
    return F.array(*(function(col(a), shift_right(b, d)) for d in shifts))


def array_sum(a):
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_mean(a):
    kept = values_not_none(a)
    return F.when(F.size(kept) > 0, array_sum(kept) / F.size(kept))


def hist_of(a):
    """Value to count, in ascending order of the values, as an array of structs."""
    return F.transform(F.array_sort(F.array_distinct(col(a))), lambda v: F.struct(v.alias("value"), F.size(F.filter(col(a), lambda x: x.eqNullSafe(v))).cast("bigint").alias("count")))


def top(a, n: int = 10):
    """The n values that occur most often, ties by value."""
    by = F.array_sort(hist_of(a), lambda x, y: F.when(x["count"] != y["count"], (y["count"] - x["count"]).cast("int")).when(x["value"] < y["value"], -1).when(x["value"] > y["value"], 1).otherwise(0))
    return F.transform(F.slice(by, 1, n), lambda x: x["value"])
