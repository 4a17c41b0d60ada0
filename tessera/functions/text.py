"""Text functions."""

from pyspark.sql import functions as F

from tessera.functions.basic import col, value


def startswith(c, s):
    return F.startswith(col(c), value(s))


def endswith(c, s):
    return F.endswith(col(c), value(s))


def contains(c, s):
    return F.contains(col(c), value(s))


def remove_extra_spaces(c):
    """Newlines and runs of spaces become one space; edges are trimmed."""
    return F.trim(F.regexp_replace(F.translate(col(c), "\n", " "), " {2,}", " "))


def norm_text(c):
    """Lower-case Latin and Cyrillic letters and single spaces; all else goes."""
    # What is left after the first pass holds no newline: one pass for runs of spaces is enough.
    low = F.translate(F.lower(col(c)), "\tё", " е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-zа-я ]+", ""), " {2,}", " "))


def crop(c, size: int, suffix: str = ".."):
    """The text cut to size characters, the suffix included."""
    return F.when(F.length(col(c)) > size, F.concat(F.substring(col(c), 1, size - len(suffix)), F.lit(suffix))).otherwise(col(c))


def split_csv_row(c, columns: int, delimiter: str = ","):
    """One CSV line as an array of texts; quoted fields may hold the delimiter."""
    names = [f"c{i}" for i in range(columns)]
    row = F.from_csv(col(c), ", ".join(f"{n} string" for n in names), {"sep": delimiter})
    return F.array(*(row[n] for n in names))


def csv_dumps(*cs, delimiter: str = "\t"):
    return F.concat_ws(delimiter, *(F.coalesce(col(c).cast("string"), F.lit("None")) for c in cs))


def json_loads(c, schema: str, default=None):
    """JSON text by a schema; the default (or null) where it is none."""
    got = F.from_json(col(c), schema)
    return got if default is None else F.coalesce(got, value(default))


def json_dumps(c):
    return F.to_json(col(c))
