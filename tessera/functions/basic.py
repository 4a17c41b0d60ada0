"""Predicates, constants, casts and logic."""

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as zero beside 0 and null.
ZERO_TEXTS = ("None", "", "-")
#: Texts that count as false.
FALSE_TEXTS = ("false", "no", "0", "0.0", "none", "null", "", "-")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def same(c):
    return col(c)


def const(v):
    return F.lit(v)


def defined(c):
    return col(c).isNotNull()


def is_none(c, floating: bool = False):
    """Null, or NaN for floating columns."""
    return col(c).isNull() | F.isnan(col(c)) if floating else col(c).isNull()


def not_none(c, floating: bool = False):
    return ~is_none(c, floating)


def nonzero(c, text: bool = False):
    """Defined and no zero value; never null."""
    zero = col(c).isin(*ZERO_TEXTS) if text else col(c) == 0
    return F.coalesce(~zero, F.lit(False))


def truthy(c, text: bool = False):
    return F.coalesce(col(c) != "", F.lit(False)) if text else nonzero(c)


def equal(c, v):
    return col(c).eqNullSafe(value(v))


def not_equal(c, v):
    return ~equal(c, v)


def less_than(c, v, including: bool = False):
    return col(c) <= value(v) if including else col(c) < value(v)


def more_than(c, v, including: bool = False):
    return col(c) >= value(v) if including else col(c) > value(v)


def at_least(c, v):
    return col(c) >= value(v)


def safe_more_than(c, v, including: bool = False):
    """A comparison that is false where a side is null."""
    return F.coalesce(more_than(c, v, including), F.lit(False))


def is_ordered(a, b, reverse: bool = False, including: bool = True):
    a, b = (col(b), col(a)) if reverse else (col(a), col(b))
    return a <= b if including else a < b


def between(c, low, high, including: bool = False):
    """Exclusive by default."""
    return col(c).between(value(low), value(high)) if including else (col(c) > value(low)) & (col(c) < value(high))


def not_between(c, low, high, including: bool = False):
    return ~between(c, low, high, including)


def is_in(c, values):
    return col(c).isin(*values)


def not_in(c, values):
    return ~col(c).isin(*values)


def apply_dict(c, known: dict, default=None):
    """The dictionary's value for the column's; for large dictionaries join a table instead."""
    pairs = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, col(c)), F.lit(default))


def acquire(*cs, text: bool = False):
    """The first value that is no zero value."""
    return F.coalesce(*(F.when(nonzero(c, text), col(c)) for c in cs))


def maybe(*conditions):
    return reduce(lambda a, b: a | b, conditions)


def always(*conditions):
    return reduce(lambda a, b: a & b, conditions)


def never(*conditions):
    return ~maybe(*conditions)


def cast(c, kind: str, default=None):
    """A cast that gives the default (0 for numbers if none is named) where the text is no such value."""
    if default is None and kind in ("int", "integer", "long", "bigint", "float", "double"):
        default = 0
    got = col(c).try_cast(kind)
    return got if default is None else F.coalesce(got, F.lit(default).cast(kind))


def percent(c, digits: int = 1, text: bool = False):
    got = F.round(col(c) * 100, digits)
    return F.concat(got.cast("string"), F.lit("%")) if text else got


def number(c, digits: int = 3):
    """The number with a suffix K, M, G or T and so many decimals."""
    x = col(c).cast("double")
    out = F.format_string(f"%.{digits}f", x)
    for limit, suffix in ((1e3, "K"), (1e6, "M"), (1e9, "G"), (1e12, "T")):
        out = F.when(F.abs(x) >= limit, F.format_string(f"%.{digits}f{suffix}", x / limit)).otherwise(out)
    return out


def str_to_bool(c):
    return ~F.lower(F.trim(col(c))).isin(*FALSE_TEXTS)


def any_to_bool(c):
    return F.coalesce(str_to_bool(col(c).cast("string")), F.lit(False))


def pair_filter(a, b, condition):
    """Of two equally long arrays the pairs for which the condition holds for both elements."""
    return F.filter(F.arrays_zip(col(a).alias("a"), col(b).alias("b")), lambda p: condition(p["a"]) & condition(p["b"]))


def pair_stat(a, b, function, condition=None):
    """function of two equally long arrays, of the pairs for which the condition holds for both if one is given."""
    kept = pair_filter(a, b, condition or (lambda _: F.lit(True)))
    return function(F.transform(kept, lambda p: p["a"]), F.transform(kept, lambda p: p["b"]))


def number_text(c, digits: int = 2, plus: bool = False, width: int = 0, convert: float = 1.0, suffix: str = ""):
    """A number as a text: converted, with so many decimals, a plus sign if asked, right-aligned to the width."""
    sign = "+" if plus else ""
    out = F.concat(F.format_string(f"%{sign}.{digits}f", col(c).cast("double") * convert), F.lit(suffix))
    return F.lpad(out, width, " ") if width else out


def parse_number(c, suffix: str = "", convert: float = 1.0, default=None):
    """The number of such a text; the default where it is none."""
    got = F.trim(col(c))
    got = F.when(F.endswith(got, F.lit(suffix)), F.substring(got, F.lit(1), F.length(got) - len(suffix))).otherwise(got) if suffix else got
    out = got.try_cast("double") / convert
    return out if default is None else F.coalesce(out, F.lit(default))


def bool_text(c, true: str = "Yes", false: str = "No", none: str = "-"):
    return F.when(col(c).isNull(), F.lit(none)).when(col(c), F.lit(true)).otherwise(F.lit(false))


def aligned(c, width: int, right: bool = False, crop_to: str = ".."):
    """The text cut to the width (with a mark) and filled with spaces."""
    t = col(c).cast("string")
    t = F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - len(crop_to)), F.lit(crop_to))).otherwise(t)
    return F.lpad(t, width, " ") if right else F.rpad(t, width, " ")


def joined(a, delimiter: str = ", ", default: str = ""):
    """An array as one text."""
    return F.coalesce(F.array_join(F.transform(col(a), lambda x: x.cast("string")), delimiter), F.lit(default))


def in_sample(c, buckets: int, bucket: int = 0, hashed=F.xxhash64):
    """Whether a stable hash (by default XXH64; any function to a whole number) puts the value in one of so many buckets."""
    return F.pmod(hashed(col(c)), F.lit(buckets)) == bucket


def md5_number(c):
    """The first 32 bits of the MD5 of a value's text: a hash that other databases have too."""
    return F.conv(F.substring(F.md5(col(c).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def detect_group(c, groups: dict[str, list], default: str = "other"):
    out = F.lit(default)
    for name, members in reversed(groups.items()):
        out = F.when(col(c).isin(*members), name).otherwise(out)
    return out
