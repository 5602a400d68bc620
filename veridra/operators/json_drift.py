"""Drift inside JSON columns: which paths and types each period's values have, and what changed from one period to the next.

Values become VARIANT, and one aggregate (``schema_of_variant_agg``, partial in each task) merges their types by period; only
the schemas, one row a period, are taken apart into paths.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is told of a type (fixed values); other names of types stay.
KINDS = {"BIGINT": "INTEGER", "DOUBLE": "NUMBER", "FLOAT": "NUMBER", "DECIMAL": "NUMBER", "STRING": "TEXT", "VOID": "NULL", "VARIANT": "MIXED"}
_TOKEN = re.compile(r"\s*(`(?:[^`]|``)*`|[A-Za-z_][\w]*(?:\(\s*\d+\s*,\s*\d+\s*\))?|[<>:,]|[^\s<>:,`]+)")


def paths_of(schema: str) -> list[tuple[str, str]]:
    """(path, kind) of each value in a schema of a variant, such as ``OBJECT<a: BIGINT, b: ARRAY<STRING>>``; ``[]`` stands for elements."""
    tokens, found, at = _TOKEN.findall(schema), [], 0

    def read(path: str) -> None:
        nonlocal at
        word = tokens[at]
        at += 1
        if word in ("OBJECT", "ARRAY"):
            found.append((path, word))
            if at < len(tokens) and tokens[at] == "<":
                at += 1
                while tokens[at] != ">":
                    if word == "ARRAY":
                        read(f"{path}[]")
                    else:
                        name = tokens[at].strip("`").replace("``", "`")
                        at += 2  # the name and its colon
                        read(f"{path}.{name}")
                    at += tokens[at] == ","
                at += 1
            return
        found.append((path, KINDS.get(word.split("(")[0], word)))

    read("$")
    return found


def json_paths(df: DataFrame, column: str, period: Column) -> DataFrame:
    """period, path, kind: what the values of each period hold.  Null values do not count, texts that are no JSON are of the kind INVALID."""
    value = F.try_parse_json(F.col(column))
    rows = df.select(period.alias("period"), value.alias("value"), (value.isNull() & F.col(column).isNotNull()).alias("broken"))
    each = rows.groupBy("period").agg(F.schema_of_variant_agg("value").alias("schema"), F.count("value").alias("n"), F.max("broken").alias("broken"))

    @F.pandas_udf("array<struct<path: string, kind: string>>")
    def parsed(schemas: pd.Series) -> pd.Series:
        return schemas.map(lambda s: [{"path": p, "kind": k} for p, k in paths_of(s)])

    found = each.filter("n > 0").select("period", F.explode(parsed("schema")).alias("x")).select("period", "x.path", "x.kind")
    return found.unionByName(each.filter("broken").select("period", F.lit("$").alias("path"), F.lit("INVALID").alias("kind")))


def json_drift(df: DataFrame, column: str, period: Column) -> DataFrame:
    """period, path, change (ADDED, REMOVED, CHANGED), old_kind, new_kind: each period against the one before it that has rows."""
    paths = json_paths(df, column, period).filter("kind <> 'INVALID'")
    # One row a period, not a row of data, goes through the window.
    periods = paths.select("period").distinct().withColumn("next", F.lead("period").over(Window.orderBy("period")))
    before = paths.join(F.broadcast(periods), "period").filter("next is not null").select(F.col("next").alias("period"), "path", F.col("kind").alias("old_kind"))
    first = paths.agg(F.min("period").alias("first"))
    after = paths.join(F.broadcast(first), F.col("period") > F.col("first")).select("period", "path", F.col("kind").alias("new_kind"))
    both = before.join(after, ["period", "path"], "full").filter(~F.col("old_kind").eqNullSafe(F.col("new_kind")))
    change = F.when(F.col("old_kind").isNull(), "ADDED").when(F.col("new_kind").isNull(), "REMOVED").otherwise("CHANGED")
    return both.select("period", "path", change.alias("change"), "old_kind", "new_kind")
