"""Schemas: types from column names, checks, and casts that keep bad rows apart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types by a part of a column's name; the first part listed here that the name holds decides.
PART_TYPES = {
    "hist": "map<string,double>",
    "names": "array<string>",
    "ids": "array<string>",
    "id": "int",
    "hits": "int",
    "count": "int",
    "sum": "double",
    "avg": "double",
    "mean": "double",
    "share": "double",
    "norm": "double",
    "weight": "double",
    "value": "double",
    "score": "double",
    "rate": "double",
    "coef": "double",
    "abs": "double",
    "rel": "double",
    "pos": "int",
    "no": "int",
    "is": "boolean",
    "has": "boolean",
}


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def type_by_name(name: str) -> str:
    parts = name.split("_")
    return next((kind for part, kind in PART_TYPES.items() if part in parts), "string")


def from_text(c: str, kind: T.DataType) -> Column:
    """A text column by its type, null where it is no such value; lists and maps are JSON."""
    return F.from_json(c, kind.simpleString()) if isinstance(kind, (T.ArrayType, T.MapType)) else F.col(c).try_cast(kind)


def schema_by_names(names: list[str]) -> T.StructType:
    return _schema(", ".join(f"`{n}` {type_by_name(n)}" for n in names))


def cast_to(df: DataFrame, schema: str, errors: str | None = None) -> DataFrame:
    """Columns of the schema, null where a value does not cast; with `errors` an array column of the names that failed."""
    fields = _schema(schema).fields
    out = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields]
    if errors:
        bad = F.filter(F.array(*(F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in fields)), lambda x: x.isNotNull())
        out.append(bad.alias(errors))
    return df.select(*out)


def differences(df: DataFrame, schema: str) -> dict[str, list[str]]:
    """Names that the frame lacks, has beyond the schema, and has with another type."""
    want = {f.name: f.dataType.simpleString() for f in _schema(schema).fields}
    have = dict(df.dtypes)
    return {"missing": [n for n in want if n not in have], "unexpected": [n for n in have if n not in want], "types": [n for n in want if n in have and want[n] != have[n]]}


def comparison(df: DataFrame, schema: str) -> DataFrame:
    """A row for each column of the frame or the schema: its state (same, other type, missing, unexpected), both types, and the share of defined values."""
    want, have = ({n: k for n, k in kinds} for kinds in ([(f.name, f.dataType.simpleString()) for f in _schema(schema).fields], df.dtypes))
    state = lambda n: "missing" if n not in have else "unexpected" if n not in want else "same" if want[n] == have[n] else "other type"
    names = [*want, *(n for n in have if n not in want)]
    text = lambda v: F.lit(v).cast("string")
    rows = F.explode(F.array(*(F.struct(text(n).alias("column"), text(state(n)).alias("state"), text(want.get(n)).alias("wanted"), text(have.get(n)).alias("type")) for n in names))).alias("r")
    known = summary(df).select("column", "defined_share")
    return df.sparkSession.range(1).select(rows).select("r.*").join(known, "column", "left")


def summary(df: DataFrame) -> DataFrame:
    """A row for each column: its name, type, and share of defined values."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.when(F.col("n") > 0, F.col(f"c{i}") / F.col("n")).alias("defined_share")) for i, (c, t) in enumerate(df.dtypes)))).alias("r")
    return one.select(rows).select("r.*")
