"""Dates by scale: day, week, month or year. Weeks are the library's own: numbered from 0, the first begins on the Monday on or before January 1."""

import datetime

from pyspark.sql import functions as F

from tessera.functions.basic import col, value

#: The first year of absolute numbers, and the Monday on or before its first day.
MIN_YEAR = 2010
SCALES = ("day", "week", "month", "year")
DAYS = {"day": 1, "week": 7, "month": 31, "year": 365}


def scale_of(name: str) -> str:
    found = [s for s in SCALES if s.startswith(name.lower().removesuffix("s")) or name.lower().startswith(s)]
    if not found:
        raise ValueError(f"no scale {name}")
    return found[0]


def epoch() -> datetime.date:
    first = datetime.date(MIN_YEAR, 1, 1)
    return first - datetime.timedelta(days=first.weekday())


def to_date(c):
    return F.to_date(col(c))


def is_iso_date(c):
    return F.coalesce(F.rlike(col(c), F.lit(r"^\d{4}-\d{2}-\d{2}")), F.lit(False))


def is_gost_date(c):
    return F.coalesce(F.rlike(col(c), F.lit(r"^\d{2}\.\d{2}\.\d{2,4}$")), F.lit(False))


def from_gost(c):
    long = F.length(col(c)) > 8
    return F.coalesce(F.when(long, F.try_to_date(col(c), "dd.MM.yyyy")), F.when(~long, F.try_to_date(col(c), "dd.MM.yy")))


def to_gost(c):
    return F.date_format(col(c), "dd.MM.yyyy")


def parse_date(c):
    return F.coalesce(F.when(is_iso_date(c), F.try_to_date(F.substring(col(c), 1, 10), "yyyy-MM-dd")), from_gost(c))


def iso(c):
    return F.date_format(col(c), "yyyy-MM-dd")


def round_date(c, scale: str):
    scale = scale_of(scale)
    return F.to_date(col(c)) if scale == "day" else F.trunc(col(c), scale)


def year_start_monday(c):
    return F.trunc(F.trunc(col(c), "year"), "week")


def next_date(c, scale: str, step: int = 1):
    scale = scale_of(scale)
    if scale in ("day", "week"):
        return F.date_add(F.to_date(col(c)), step * DAYS[scale])
    return F.add_months(F.to_date(col(c)), step * (12 if scale == "year" else 1))


def next_year_date(c, step: int = 1, to_monday: bool = False):
    got = next_date(c, "year", step)
    return F.trunc(got, "week") if to_monday else got


def date_range(low, high, scale: str, step: int = 1):
    """The grid of the scale over both ends' range, as an array of dates; it begins at the scale's first date on or before low."""
    return F.sequence(round_date(low, scale), F.to_date(col(high)), F.expr(f"interval {step} {scale_of(scale)}"))


def yearly_dates(c, low, high):
    """The same day of each year within the range, as an array."""
    years = F.sequence(F.year(value(low)), F.year(value(high)))
    days = F.transform(years, lambda y: F.add_months(F.to_date(col(c)), ((y - F.year(col(c))) * 12).cast("int")))
    return F.filter(days, lambda d: (d >= value(low)) & (d <= value(high)))


def days_between(a, b):
    return F.datediff(col(b), col(a))


def int_between(a, b, scale: str):
    scale = scale_of(scale)
    return (days_between(a, b) / {"day": 1, "week": 7, "month": 30, "year": 365}[scale]).cast("int")


def days_in_month(c):
    """Of a year that is no leap year."""
    m = F.month(col(c))
    return F.when(m == 2, 28).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def year_and_week(c):
    """(year, week) as a struct; a 53rd week is week 0 of the next year."""
    week = F.floor(F.datediff(col(c), year_start_monday(c)) / 7).cast("int")
    year = F.year(col(c))
    return F.struct(F.when(week >= 52, year + 1).otherwise(year).alias("year"), F.when(week >= 52, 0).otherwise(week).alias("week"))


def week_no(c):
    return year_and_week(c)["week"]


def date_from_year_and_week(year, week):
    return F.date_add(F.trunc(F.make_date(value(year), F.lit(1), F.lit(1)), "week"), (value(week) * 7).cast("int"))


def date_from_year_and_month(year, month):
    return F.make_date(value(year), value(month), F.lit(1))


def is_date(c, gost: bool = False):
    """Whether the text is an ISO date, or one of dd.mm.yyyy if gost."""
    return is_iso_date(c) | is_gost_date(c) if gost else is_iso_date(c)


def days_in_scale(scale: str) -> int:
    return DAYS[scale_of(scale)]


def week_abs_of(year, week):
    return (value(year) - MIN_YEAR) * 52 + value(week)


def year_of_week_abs(n):
    return (col(n) / 52).cast("int") + MIN_YEAR


def week_of_week_abs(n):
    return col(n) - (col(n) / 52).cast("int") * 52


def year_and_week_of_abs(n):
    return F.struct(year_of_week_abs(n).alias("year"), week_of_week_abs(n).alias("week"))


def day_abs(c):
    return F.datediff(col(c), F.lit(epoch()))


def week_abs(c):
    yw = year_and_week(c)
    return (yw["year"] - MIN_YEAR) * 52 + yw["week"]


def month_abs(c):
    return (F.year(col(c)) - MIN_YEAR) * 12 + F.month(col(c))


def year_abs(c):
    return F.year(col(c)) - MIN_YEAR


def date_to_int(c, scale: str):
    return {"day": day_abs, "week": week_abs, "month": month_abs, "year": year_abs}[scale_of(scale)](c)


def int_to_date(c, scale: str):
    """The first date of the unit with that absolute number."""
    n = col(c)
    scale = scale_of(scale)
    if scale == "day":
        return F.date_add(F.lit(epoch()), n.cast("int"))
    if scale == "week":
        return date_from_year_and_week((F.floor(n / 52) + MIN_YEAR).cast("int"), F.pmod(n, F.lit(52)))
    if scale == "month":
        return F.add_months(F.lit(datetime.date(MIN_YEAR - 1, 12, 1)), n.cast("int"))
    return F.make_date((n + MIN_YEAR).cast("int"), F.lit(1), F.lit(1))


def year_decimal(c):
    return F.year(col(c)) + (F.dayofyear(col(c)) - 1) / 365


def date_from_year(c):
    """The date of a decimal year."""
    y = F.floor(col(c)).cast("int")
    return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), F.round((col(c) - y) * 365).cast("int"))


def formatted_datetime(c):
    return F.date_format(col(c), "yyyy-MM-dd HH:mm")


def interval_text(seconds):
    """Seconds as a short text: 3W, 4D, 5h, 6m or 7s, in whole units of the largest that fits."""
    s = col(seconds)
    out = F.concat(s.cast("bigint").cast("string"), F.lit("s"))
    for size, unit in ((60, "m"), (3600, "h"), (86400, "D"), (7 * 86400, "W"), (30 * 86400, "M"), (365 * 86400, "Y")):
        out = F.when(s >= size, F.concat((s / size).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def date_fields(c, prefix: str = "") -> dict:
    """The usual parts of a date, by name."""
    return {f"{prefix}{k}": v for k, v in {"year": F.year(col(c)), "month": F.month(col(c)), "week": week_no(c), "weekday": F.weekday(col(c)), "day": F.dayofmonth(col(c))}.items()}
