"""Type names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The type names that count as numeric, and the widenings that count as safe (old, new).
NUMERIC = ("INTEGER", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "NUMERIC")
SAFE_WIDENINGS = frozenset(
    {
        ("INTEGER", "BIGINT"), ("INT", "BIGINT"), ("FLOAT", "DOUBLE"), ("REAL", "DOUBLE"),
        ("SMALLINT", "INTEGER"), ("SMALLINT", "INT"), ("SMALLINT", "BIGINT"),
        ("TINYINT", "SMALLINT"), ("TINYINT", "INTEGER"), ("TINYINT", "INT"), ("TINYINT", "BIGINT"),
        ("VARCHAR", "TEXT"), ("STRING", "TEXT"),
    }
)

_NAMES = {
    T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
    T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
    T.DateType: "DATE", T.BinaryType: "BLOB", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE",
}
_PART = r"[A-Za-z_][A-Za-z0-9_]*"
_IDENTIFIER = re.compile(rf"{_PART}(\.{_PART}){{0,2}}")


def canonical_type(kind: T.DataType) -> str:
    """One name per type, the same that DuckDB uses."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return canonical_type(kind.elementType) + "[]"
    if isinstance(kind, T.MapType):
        return f"MAP({canonical_type(kind.keyType)}, {canonical_type(kind.valueType)})"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {canonical_type(f.dataType)}" for f in kind.fields) + ")"
    return _NAMES.get(type(kind), kind.simpleString().upper())


def is_numeric(kind: str) -> bool:
    """Precision does not count; the small integers, which the list leaves out, are numeric too."""
    return kind.upper().split("(")[0].strip() in (*NUMERIC, "SMALLINT", "TINYINT")


def is_safe_widening(old: str, new: str) -> bool:
    """Only the listed pairs; the relation is not transitive."""
    return (old.upper(), new.upper()) in SAFE_WIDENINGS


def columns_of(df: DataFrame) -> list[dict]:
    return [{"column_name": f.name, "column_type": canonical_type(f.dataType)} for f in df.schema.fields]


def check_identifier(name: str, what: str = "identifier") -> str:
    """One to three dotted names; anything else raises ValueError."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"Invalid {what}: {name!r}")
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def two_part(name: str) -> str:
    """catalog.schema.table -> schema.table; shorter names stay."""
    return ".".join(name.split(".")[-2:])
