"""Column types of views, and the flags that change what a filter on a column means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Document-store type names and the Spark types that hold all their values (fixed values).
SPARK_TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "uint": T.LongType(),
    "long": T.LongType(),
    "guid": T.StringType(),
    "string": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "decimal": T.DecimalType(28, 6),
    "short": T.ShortType(),
    "ushort": T.IntegerType(),
    "float": T.FloatType(),
    "byte": T.ShortType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "enum": T.StringType(),
    "binary": T.BinaryType(),
    "timespan": T.DayTimeIntervalType(),
}


@dataclass(frozen=True)
class Column:
    """A view column: its name, its type name, and how it is searched."""

    name: str
    kind: str = "string"
    fulltext: bool = False
    nocase: bool = False
    noindex: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.kind]

    def field(self) -> T.StructField:
        flags = {k: True for k in ("fulltext", "nocase", "noindex") if getattr(self, k)}
        return T.StructField(self.name, self.spark_type, True, {"kind": self.kind, **flags})


def column_of(field: T.StructField) -> Column:
    """The column that a field with metadata describes; without metadata it is plain."""
    found = next((k for k, t in SPARK_TYPES.items() if t == field.dataType), "decimal" if isinstance(field.dataType, T.DecimalType) else "string")
    meta = field.metadata or {}
    return Column(field.name, meta.get("kind", found), *(bool(meta.get(k)) for k in ("fulltext", "nocase", "noindex")))
