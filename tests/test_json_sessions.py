from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridra.operators import json_drift as J
from veridra.streaming import sessions as S

START = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "schema, paths",
    [
        ("BIGINT", [("$", "INTEGER")]),
        ("OBJECT<>", [("$", "OBJECT")]),
        ("OBJECT<a: DECIMAL(3,1), b: OBJECT<`x y`: STRING>, c: ARRAY<OBJECT<d: VARIANT>>>", [("$", "OBJECT"), ("$.a", "NUMBER"), ("$.b", "OBJECT"), ("$.b.x y", "TEXT"), ("$.c", "ARRAY"), ("$.c[]", "OBJECT"), ("$.c[].d", "MIXED")]),
        ("ARRAY<BOOLEAN>", [("$", "ARRAY"), ("$[]", "BOOLEAN")]),
    ],
)
def test_paths_of_schemas(schema, paths):
    assert J.paths_of(schema) == paths


def test_drift_by_period(spark):
    rows = [
        (1, '{"a": 1, "b": "x", "o": {"p": true}}'), (1, '{"a": 2}'), (1, None), (2, '{"a": 1.5, "b": 3}'), (2, '{"b": "y", "n e w": [1]}'), (2, "no json"), (4, '{"a": 1}'), (5, None),
    ]
    df = spark.createDataFrame(rows, "day int, j string")
    found = sorted(map(tuple, J.json_drift(df, "j", F.col("day")).collect()))
    assert found == [
        (2, "$.a", "CHANGED", "INTEGER", "NUMBER"), (2, "$.b", "CHANGED", "TEXT", "MIXED"), (2, "$.n e w", "ADDED", None, "ARRAY"), (2, "$.n e w[]", "ADDED", None, "INTEGER"),
        (2, "$.o", "REMOVED", "OBJECT", None), (2, "$.o.p", "REMOVED", "BOOLEAN", None),
        (4, "$.a", "CHANGED", "NUMBER", "INTEGER"), (4, "$.b", "REMOVED", "MIXED", None), (4, "$.n e w", "REMOVED", "ARRAY", None), (4, "$.n e w[]", "REMOVED", "INTEGER", None),
    ]
    assert [tuple(r) for r in J.json_paths(df, "j", F.col("day")).filter("kind = 'INVALID'").collect()] == [(2, "$", "INVALID")]
    assert J.json_drift(df.limit(0), "j", F.col("day")).count() == 0


def events(spark, path, rows):
    spark.createDataFrame([(i, u, START + timedelta(minutes=m)) for i, u, m in rows], "event_id long, user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def run(spark, folder):
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{folder}/in")
    once = S.without_repeats(stream, ["event_id"], "ts", "60 minutes")
    S.write_sessions(S.sessions(once, "user_id", "ts", "30 minutes"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    at = lambda t: int((t - START).total_seconds() // 60)
    return sorted((r["user_id"], at(r["session_start"]), at(r["session_end"]), r["n_events"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_sessions_survive_restarts_and_late_rows_go(spark, tmp_path):
    events(spark, f"{tmp_path}/in", [(1, 7, 0), (1, 7, 0), (2, 7, 20), (3, 7, 60), (4, 8, 300)])
    assert run(spark, tmp_path) == [(7, 0, 50, 2), (7, 60, 90, 1)]  # user 8's is still open
    # The watermark stands at 240: the first row is late and goes, the repeat goes, the others go on with user 8's session.
    events(spark, f"{tmp_path}/in", [(9, 7, 61), (4, 8, 300), (5, 8, 320), (6, 8, 600)])
    assert run(spark, tmp_path) == [(7, 0, 50, 2), (7, 60, 90, 1), (8, 300, 350, 2)]
    assert run(spark, tmp_path) == [(7, 0, 50, 2), (7, 60, 90, 1), (8, 300, 350, 2)]  # nothing new, nothing told twice
