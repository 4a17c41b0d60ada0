"""Arithmetic with the library's null rules, and statistics."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.basic import col, value


def sign(c, plus=1, minus=-1, zero=0):
    return F.when(col(c) > 0, F.lit(plus)).when(col(c) < 0, F.lit(minus)).when(col(c) == 0, F.lit(zero))


def round_py(c, digits: int = 0, least: float | None = None):
    """Half to even."""
    got = F.bround(col(c), digits)
    return got if least is None else F.greatest(got, F.lit(least))


def round_to(c, step):
    """The multiple of step next towards zero."""
    return (col(c) / value(step)).cast("bigint") * value(step)


def is_numeric(c):
    """Whether the value is a number or the text of one; null is none."""
    return F.coalesce(col(c).try_cast("double").isNotNull(), F.lit(False))


def diff(a, b, absolute: bool = False, default=None):
    got = col(a) - value(b)
    got = F.abs(got) if absolute else got
    return got if default is None else F.coalesce(got, F.lit(default))


def increment(a, b, default=None):
    got = value(b) - col(a)
    return got if default is None else F.coalesce(got, F.lit(default))


def div(a, b, default=None):
    return F.when(col(b) != 0, F.coalesce(col(a), F.lit(0)) / col(b)).otherwise(F.lit(default))


def lift(a, b, default=None):
    """The relative change from a to b; the default where a is null or zero, or b is null or zero."""
    return F.when((col(a) != 0) & (col(b) != 0), (col(b) - col(a)) / col(a)).otherwise(F.lit(default))


def mult(a, b):
    return col(a) * value(b)


def sqrt(c, default=None):
    return F.when(col(c) >= 0, F.sqrt(col(c))).otherwise(F.lit(default))


def log(c, base: float = math.e, shift: float = 0, default=None):
    x = col(c) + shift
    return F.when(x > 0, F.log(x) if base == math.e else F.log(float(base), x)).otherwise(F.lit(default))


def is_local_extreme(before, now, after, local_min: bool = True, local_max: bool = True):
    b, n, a = col(before), col(now), col(after)
    top, low = (n > b) & (n >= a), (n < b) & (n <= a)
    return top | low if local_min and local_max else top if local_max else low


def corr(a, b):
    """Pearson's, over the pairs whose values are both defined and no zero."""
    both = (col(a) != 0) & (col(b) != 0)
    return F.corr(F.when(both, col(a)), F.when(both, col(b)))


def count_uniq(c):
    """Distinct values, null among them."""
    return F.count_distinct(col(c)) + F.max(F.when(col(c).isNull(), 1).otherwise(0))


def median(c, accuracy: int | None = None):
    """Exact, or by a sketch of that accuracy, whose memory does not grow with a group's values."""
    return F.median(col(c)) if accuracy is None else F.percentile_approx(col(c), 0.5, accuracy)


def mean(c, digits: int | None = None, default=None):
    got = F.avg(col(c)) if digits is None else F.bround(F.avg(col(c)), digits)
    return got if default is None else F.coalesce(got, F.lit(default))


def var(c, default=0):
    return F.coalesce(F.var_pop(col(c)), F.lit(float(default)))


def t_statistic(c, mu: float = 0):
    """An aggregate: Student's t of one sample; null for fewer than two values or no spread."""
    s = F.stddev_samp(col(c))
    return F.when(s > 0, (F.avg(col(c)) - mu) / (s / F.sqrt(F.count(col(c)))))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def two_sided_p(t: float, df: float) -> float:
    """The p-value of Student's t."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(t, n):
    """The two-sided p-value of a t statistic over n values, as an Arrow-batched function of aggregated rows."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(x, k - 1) if k > 1 and not np.isnan(x) else None for x, k in zip(t, n, strict=True)], dtype="float64")

    return p(col(t), col(n))


def p_log_sign(p, t, default: float = -10.0):
    """log10 of a p-value, at least the default, with the statistic's sign."""
    return F.greatest(F.when(col(p) > 0, F.log10(col(p))).otherwise(F.lit(default)), F.lit(default)) * F.signum(col(t))
