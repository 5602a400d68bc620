"""Steps as tables: written in buckets, so that later steps need no shuffle; or audited while they are written.

A bucketed table holds each key in one bucket, sorted; grouping by the keys and joining tables of equal buckets then plan without an
exchange.  A key that holds a large share of the rows would make one bucket, and so one task, of that size; such a table is
written without buckets, and later steps shuffle it as usual.

An audited write takes the counts of rows, nulls and violated rules from the write job itself (``DataFrame.observe``).  Its rows are a new
version, which is published, in one file that appears when its job commits, only if no rule is violated; readers take the newest
published version.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.types import quoted
from ..operators.staging import delete, new_path

#: The largest share of a bucket's mean size that one key may have.
HOT = 4


def has_hot_key(df: DataFrame, keys: list[str], buckets: int) -> bool:
    """Whether one key has more rows than HOT mean buckets."""
    row = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    return (row["most"] or 0) * buckets > HOT * (row["total"] or 0)


def write_bucketed(df: DataFrame, keys: list[str], buckets: int, table: str | None = None, path: str | None = None) -> DataFrame:
    """The rows as a table in buckets of the keys (without, if one key is hot); the table's DataFrame."""
    spark, name = df.sparkSession, table or f"veridra_{uuid.uuid4().hex}"
    writer = df.write
    if not has_hot_key(df, keys, buckets):
        writer = df.repartition(buckets, *map(quoted, keys)).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.format("parquet").mode("overwrite").option("path", path or new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def write_audited(df: DataFrame, path: str, rules: list[str]) -> dict:
    """Writes a new version and publishes it if no rule is violated; a row violates a rule if NOT (rule) is true.

    Gives status (PUBLISHED or REJECTED), version, rows, nulls by column and violations by rule, all from the one write job.
    """
    spark, version, seen = df.sparkSession, uuid.uuid4().hex, Observation()
    nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    failed = [F.count_if(~F.expr(f"({r})")).alias(f"v{i}") for i, r in enumerate(rules)]
    data = f"{path}/data/version={version}"
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls, *failed).write.parquet(data)
    got = seen.get
    report = {
        "version": version, "rows": got["rows"], "nulls": {c: got[f"n{i}"] for i, c in enumerate(df.columns)},
        "violations": {r: got[f"v{i}"] for i, r in enumerate(rules)},
    }
    if any(report["violations"].values()):
        delete(spark, data)
        return {"status": "REJECTED", **report}
    number = max((r["number"] for r in versions(spark, path).collect()), default=0) + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{path}/published")
    return {"status": "PUBLISHED", **report}


def versions(spark: SparkSession, path: str) -> DataFrame:
    """number, version of what has been published."""
    try:
        return spark.read.schema("number long, version string").parquet(f"{path}/published")
    except AnalysisException:
        return spark.createDataFrame([], "number long, version string")


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest published version."""
    newest = versions(spark, path).orderBy(F.desc("number"), "version").first()
    if newest is None:
        raise LookupError(f"Nothing is published in {path}")
    return spark.read.parquet(f"{path}/data/version={newest['version']}")


def audit_rows(spark: SparkSession, report: dict) -> DataFrame:
    """kind (rows, nulls or violations), name and n of a report."""
    listed = [("rows", None, report["rows"])] + [(kind, name, n) for kind in ("nulls", "violations") for name, n in report[kind].items()]
    return spark.createDataFrame(listed, "kind string, name string, n long")
