"""Counts, nulls, least and greatest values from Parquet footers, without reading a row.

Spark answers ``count``, ``min`` and ``max`` of plain columns from the statistics of the files' footers, if the DSv2 reader may push
aggregates down.  These settings belong to a session of their own here, so other queries keep theirs.  Where a file
has no statistics of a column the reader refuses; that is tried once, with the footers alone, and the same aggregate then scans.

Least and greatest values come from footers for integers, booleans and dates.  Texts and times are not pushed (their
statistics may be cut or ambiguous), nor are floats by default, whose footers leave out NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..functions.types import quoted

_SETTINGS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
_RANGED = (BooleanType, ByteType, ShortType, IntegerType, LongType, DateType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session over the same cluster whose Parquet reads may push aggregates down."""
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(key, spark.conf.get(key))
    for key, value in _SETTINGS.items():
        session.conf.set(key, value)
    return session


def _ranged(kind: DataType, floats: bool) -> bool:
    return isinstance(kind, _RANGED) or floats and isinstance(kind, (FloatType, DoubleType))


def _aggregate(df: DataFrame, columns: list[str], ranged: list[str]) -> DataFrame:
    of = lambda c: F.col(quoted(c))
    counts = [F.count(of(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    ranges = [x for i, c in enumerate(ranged) for x in (F.min(of(c)).alias(f"lo{i}"), F.max(of(c)).alias(f"hi{i}"))]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts, *ranges)


def pushed(df: DataFrame) -> bool:
    """Whether the plan takes its aggregate from the footers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [" in plan and "PushedAggregation: []" not in plan


def footer_aggregate(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, floats: bool = False) -> tuple[DataFrame, list[str], list[str], bool]:
    """One row with rows, n{i} (values that are not null) of each column and lo{i}, hi{i} of each ranged one; the two lists of columns;
    and whether it comes from footers."""
    session = footer_session(spark)
    df = session.read.parquet(*([path] if isinstance(path, str) else path))
    flat = [f.name for f in df.schema.fields if not hasattr(f.dataType, "fields") and f.dataType.typeName() not in ("array", "map", "variant")]
    columns = [c for c in columns or flat if c in flat]
    ranged = [c for c in columns if _ranged(df.schema[c].dataType, floats)]
    found = _aggregate(df, columns, ranged)
    if pushed(found):
        try:
            found.collect()
            return found, columns, ranged, True
        except Exception as error:  # a file without statistics
            if "footer" not in str(error).lower() and "statistic" not in str(error).lower() and "aggregate" not in str(error).lower():
                raise
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return _aggregate(df, columns, ranged), columns, ranged, False


def footer_profile(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, floats: bool = False) -> DataFrame:
    """column_name, row_count, null_count, min_value, max_value (as text; null for columns without a range)."""
    one, columns, ranged, _ = footer_aggregate(spark, path, columns, floats)
    none = F.lit(None).cast("string")

    def of(i: int, c: str):
        low, high = (F.col(f"{end}{ranged.index(c)}").cast("string") if c in ranged else none for end in ("lo", "hi"))
        return F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), (F.col("rows") - F.col(f"n{i}")).alias("null_count"), low.alias("min_value"), high.alias("max_value"))

    return one.select(F.explode(F.array(*[of(i, c) for i, c in enumerate(columns)])).alias("x")).select("x.*")


def null_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """column_name, null_count, null_pct and status as of ``quality.null_profile``, from footers where these tell."""
    rows = footer_profile(spark, path)
    pct = F.when(F.col("row_count") > 0, 100 * F.col("null_count") / F.col("row_count")).otherwise(0.0)
    return rows.select("column_name", "null_count", F.round(pct, 2).alias("null_pct"), F.when(pct < 5, "OK").when(pct < 50, "WARNING").otherwise("CRITICAL").alias("status"))
