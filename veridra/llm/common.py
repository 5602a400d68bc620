"""Helpers shared by the operators: tables, staging, and code that must travel to executors."""

from __future__ import annotations

import functools
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this package: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Executors need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="veridra-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one only where none is set on a single machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = _temporary()
    return where.rstrip("/")


#: What this process has staged and not deleted.
_written: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def written() -> set[str]:
    """The paths that operators have staged and not deleted."""
    return set(_written)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Deletes all that operators have staged but for the paths to keep, also what results still read: call it when these have been written."""
    for path in written() - keep:
        delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made from them has been written since."""
    for df in tables:
        delete(df.sparkSession, df.staged_path)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task, as its Python process waits for others."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
    pa.default_memory_pool().release_unused()


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn labels from; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2
