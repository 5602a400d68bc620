"""The table registry: names of the form schema.table, each a DataFrame that is built when asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import check_identifier, columns_of

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


class Catalog:
    """Tables by name.  Schemas exist as far as tables are in them, unless declared."""

    def __init__(self, spark: SparkSession, default_schema: str = "main"):
        self.spark, self.default_schema = spark, default_schema
        self._tables: dict[str, Callable[[], DataFrame]] = {}
        self._schemas: set[str] = set()
        self._paths: dict[str, str] = {}

    @classmethod
    def from_directory(cls, spark: SparkSession, folder: str, tables: Iterable[str], schema: str = "main") -> Catalog:
        """One Parquet file or folder per table; a path of any store that Spark reads."""
        found = cls(spark, schema)
        for name in tables:
            found.register(f"{schema}.{name}", lambda path=f"{folder}/{name}.parquet": spark.read.parquet(path))
            found._paths[f"{schema}.{name}"] = f"{folder}/{name}.parquet"
        return found

    @classmethod
    def from_session(cls, spark: SparkSession, schema: str | None = None) -> Catalog:
        """The tables of the session's catalog, of one schema or of all."""
        found = cls(spark, schema or "default")
        for db in [schema] if schema else [d.name for d in spark.catalog.listDatabases()]:
            for t in spark.catalog.listTables(db):
                if not t.isTemporary:
                    found.register(f"{db}.{t.name}", lambda name=f"{db}.{t.name}": spark.table(name))
        return found

    def full_name(self, table: str) -> str:
        check_identifier(table, "table name")
        return table if "." in table else f"{self.default_schema}.{table}"

    def create_schema(self, schema: str) -> None:
        self._schemas.add(check_identifier(schema, "schema name"))

    def register(self, table: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """Adds or replaces a table."""
        self._paths.pop(self.full_name(table), None)
        self._tables[self.full_name(table)] = df if callable(df) and not isinstance(df, DataFrame) else lambda: df

    def drop(self, table: str) -> None:
        self._tables.pop(self.full_name(table), None)
        self._paths.pop(self.full_name(table), None)

    def path(self, table: str) -> str | None:
        """Where the Parquet files of a table lie, if it is one of files."""
        return self._paths.get(self.full_name(table))

    def exists(self, table: str) -> bool:
        return self.full_name(table) in self._tables

    def table(self, table: str) -> DataFrame:
        name = self.full_name(table)
        if name not in self._tables:
            raise LookupError(f"Table not found: {table}")
        return self._tables[name]()

    def listing(self) -> DataFrame:
        """table_schema, table_name of all tables outside system schemas."""
        rows = [tuple(n.rsplit(".", 1)) for n in self._tables]
        return self.spark.createDataFrame(rows, "table_schema string, table_name string").filter(~F.col("table_schema").isin(*SYSTEM_SCHEMAS))

    def schemas(self, with_empty: bool = False) -> list[str]:
        found = [r[0] for r in self.listing().select("table_schema").distinct().orderBy("table_schema").collect()]
        return sorted({*found, *self._schemas}) if with_empty else found

    def tables(self, schema: str | None = None) -> list[dict]:
        rows = self.listing()
        if schema is not None:
            rows = rows.filter(F.col("table_schema") == check_identifier(schema, "schema name"))
        return [r.asDict() for r in rows.orderBy("table_schema", "table_name").collect()]

    def columns(self, table: str) -> list[dict]:
        return columns_of(self.table(table))

    def column_listing(self, tables: Iterable[str] | None = None) -> DataFrame:
        """table_name, column_name, column_type, ordinal: schemas only, no data is read."""
        rows = [
            (name.split(".")[-1], c["column_name"], c["column_type"], n)
            for name in (tables or self._tables) for n, c in enumerate(self.columns(name), 1)
        ]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, column_type string, ordinal int")

    def row_counts(self, tables: Iterable[str] | None = None) -> DataFrame:
        """table_name, row_count, in one job for all tables."""
        parts = [self.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n.split(".")[-1]).alias("table_name"), "row_count") for n in (tables or self._tables)]
        if not parts:
            return self.spark.createDataFrame([], "table_name string, row_count long")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def resolve(self, parts: tuple[str, ...]) -> str:
        """The registered table that a name in a query means: with its schema, or in the default schema, or in the only schema that has it."""
        wanted = ".".join(parts).lower()
        fits = [n for n in self._tables if n.lower() == wanted] if len(parts) > 1 else []
        if len(parts) == 1:
            fits = [n for n in self._tables if n.lower() == f"{self.default_schema}.{wanted}".lower()] or [n for n in self._tables if n.rsplit(".", 1)[-1].lower() == wanted]
        if not fits:
            raise LookupError(f"Table not found: {'.'.join(parts)}")
        if len(fits) > 1:
            raise LookupError(f"Ambiguous table name: {'.'.join(parts)} is in {', '.join(sorted(n.rsplit('.', 1)[0] for n in fits))}")
        return fits[0]

    def as_views(self) -> None:
        """Temp views for SQL under each table's bare name."""
        for name in self._tables:
            self.table(name).createOrReplaceTempView(name.split(".")[-1])
