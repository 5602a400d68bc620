"""Exact distinct counts that merge: what has been seen is kept, so added files alone are read.

One scan stacks the values of all columns and makes them distinct.  Whole numbers that lie close together are kept as
bitmaps, 32,768 neighbours in 4 KB; other values as themselves, in the text that stands for one value only.  Either merges
with that of other rows: bitmaps by ``or``, values by ``distinct``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..functions.types import quoted

SCHEMA = "column_name string, bucket long, bitmap binary, value string"
#: A column is kept as bitmaps if it has a value for each so many numbers of its range at least.
SPARSEST = 64


def dense_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The whole-number columns whose values lie close together, by one aggregate."""
    whole = [c for c in columns if isinstance(df.schema[c].dataType, (ByteType, ShortType, IntegerType, LongType))]
    if not whole:
        return []
    of = lambda c: F.col(quoted(c)).cast("decimal(20,0)")
    row = df.agg(*[F.struct(F.count(quoted(c)).alias("n"), (F.max(of(c)) - F.min(of(c))).alias("range")).alias(f"c{i}") for i, c in enumerate(whole)]).first()
    return [c for i, c in enumerate(whole) if row[i]["n"] and row[i]["range"] <= SPARSEST * row[i]["n"]]


def _text(df: DataFrame, column: str) -> Column:
    """One text for each value; both zeros are one value, as all NaN are."""
    col = F.col(quoted(column))
    return (col + F.lit(0.0)).cast("string") if isinstance(df.schema[column].dataType, (FloatType, DoubleType)) else col.cast("string")


def distinct_state(df: DataFrame, columns: list[str] | None = None, dense: list[str] | None = None) -> DataFrame:
    """column_name, bucket, bitmap, value: all values of the columns but null, in one scan."""
    columns = columns or df.columns
    dense = dense_columns(df, columns) if dense is None else dense
    none = lambda kind: F.lit(None).cast(kind)
    items = []
    for c in columns:
        number = F.col(quoted(c)).cast("long") if c in dense else none("long")
        items.append(F.struct(F.lit(c).alias("column_name"), number.alias("number"), (none("string") if c in dense else _text(df, c)).alias("value")))
    seen = df.select(F.explode(F.array(*items)).alias("x")).select("x.*").filter("number is not null or value is not null").distinct()
    maps = seen.filter("number is not null").groupBy("column_name", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap"))
    return maps.select("column_name", "bucket", "bitmap", none("string").alias("value")).unionByName(seen.filter("number is null").select("column_name", none("long").alias("bucket"), none("binary").alias("bitmap"), "value"))


def merged(state: DataFrame) -> DataFrame:
    """A state with each bucket and each value once.  A column may have been dense in some parts only; its numbers then count as values."""
    maps = state.filter("bitmap is not null").groupBy("column_name", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    values = state.filter("bitmap is null").select("column_name", "value").distinct()
    mixed = maps.select("column_name").distinct().join(values.select("column_name").distinct(), "column_name")
    # Bits of mixed columns: byte n of a bitmap holds numbers 8 n to 8 n + 7 of its bucket, whose first is (bucket - 1) * 32768 + 1 (0 and below: likewise).
    bits = maps.join(F.broadcast(mixed), "column_name").select("column_name", "bucket", F.posexplode(F.split(F.regexp_replace(F.hex("bitmap"), "(..)", "$1 "), " ")).alias("byte", "pair")).filter("pair <> '' and pair <> '00'")
    each = bits.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7)))).filter(F.shiftright(F.conv("pair", 16, 10).cast("int"), 0).bitwiseAND(F.expr("shiftleft(1, bit)")) != 0)
    place = F.col("byte") * 8 + F.col("bit")
    number = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + 1 + place).otherwise(-(-F.col("bucket") * 32768 + place))
    values = values.unionByName(each.select("column_name", number.cast("string").alias("value"))).distinct()
    maps = maps.join(F.broadcast(mixed), "column_name", "left_anti")
    none = F.lit(None)
    return maps.select("column_name", "bucket", "bitmap", none.cast("string").alias("value")).unionByName(values.select("column_name", none.cast("long").alias("bucket"), none.cast("binary").alias("bitmap"), "value"))


def distinct_counts(state: DataFrame) -> DataFrame:
    """column_name, distinct_count of each column that has any value."""
    one = merged(state).select("column_name", F.when(F.col("bitmap").isNotNull(), F.bitmap_count("bitmap")).otherwise(1).alias("n"))
    return one.groupBy("column_name").agg(F.sum("n").alias("distinct_count"))


class DistinctStore:
    """States of files in a folder.  A batch counts once its list of files is written, so a lost one leaves nothing behind that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing has been added yet
            return self.spark.createDataFrame([], f"{schema}, batch string")

    def files(self) -> list[str]:
        return sorted(r["file"] for r in self._read("files", "file string").select("file").distinct().collect())

    def add(self, files: list[str], columns: list[str] | None = None) -> list[str]:
        """Reads the files that the store does not know yet, and no others; returns these."""
        new = sorted(set(files) - set(self.files()))
        if new:
            batch = uuid.uuid4().hex
            distinct_state(self.spark.read.parquet(*new), columns).write.parquet(f"{self.path}/state/batch={batch}")
            self.spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.parquet(f"{self.path}/files/batch={batch}")
        return new

    def counts(self) -> DataFrame:
        listed = self._read("files", "file string").select("batch").distinct()
        return distinct_counts(self._read("state", SCHEMA).join(F.broadcast(listed), "batch", "left_semi").drop("batch"))
