"""Terms: named dimensions with fields by role, dictionaries, levels and relations between them."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.names import hidden

#: Column types by role.
ROLE_TYPES = {"id": "bigint", "name": "string", "key": "string", "repr": "string", "ids": "array<bigint>", "count": "bigint", "share": "double", "value": "double", "mean": "double"}


@dataclass
class Term:
    """A dimension. levels: the roles' columns of a hierarchical key, from the top."""

    name: str
    levels: tuple[str, ...] = ()
    relations: dict[str, str] = field(default_factory=dict)

    def column(self, role: str) -> str:
        return f"{self.name}_{role}"

    def kind(self, role: str) -> str:
        return ROLE_TYPES.get(role, "string")

    def relate(self, other: "Term", kind: str, reverse: str) -> "Term":
        self.relations[other.name] = kind
        other.relations[self.name] = reverse
        return self

    def lookup(self, df: DataFrame, dictionary: DataFrame, role: str, into: str, default=None, last_by: str | None = None) -> DataFrame:
        """Adds the column of role `into` from a dictionary table of both columns; unknown values get the default. A null key is a key.

        Of several values of a key the last one by last_by counts, or the largest.
        """
        a, b = self.column(role), self.column(into)
        k, v = hidden([df, dictionary], "k", "v")
        value = F.max_by(b, F.struct(F.col(last_by), F.col(b))) if last_by else F.max(b)
        known = dictionary.groupBy(F.col(a).alias(k)).agg(value.alias(v))
        return df.join(known, F.col(a).eqNullSafe(F.col(k)), "left").withColumn(b, F.coalesce(v, F.lit(default))).drop(k, v)

    def add_key(self, df: DataFrame, delimiter: str = ".") -> DataFrame:
        """The key of a hierarchical term: its levels' ids, joined."""
        return df.withColumn(self.column("key"), F.concat_ws(delimiter, *(F.col(c).cast("string") for c in self.levels)))

    def level_id(self, level: int, delimiter: str = "."):
        return F.split(F.col(self.column("key")), rf"\{delimiter}")[level]


def entity_records(terms: list[Term]) -> list[dict]:
    """A record for each term: its name, levels and relations, for a table of the dimensions."""
    return [{"name": t.name, "levels": list(t.levels), "relations": dict(t.relations)} for t in terms]


def edges(df: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct directed edges with their counts."""
    return df.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(node, n_in, n_out), counted in one pass."""
    ends = edge_rows.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))
