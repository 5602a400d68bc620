"""Tables between the steps of an operator, in the folder that all machines share.

Writing and rereading cuts lineage and survives lost executors.  ``spark.checkpoint.dir`` names the folder; only where it
is unset and the master is local may a temporary one stand in.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="veridra-")


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        where = _temporary()
    return where.rstrip("/")


#: What this process has written and not deleted.
_written: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    _written.add(path)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.staged_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have staged; call it when their results have been written or collected."""
    for path in list(_written):
        delete(spark, path)
