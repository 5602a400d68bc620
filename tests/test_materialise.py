import pytest
from pyspark.sql import functions as F

from veridra.plans import materialise as W
from veridra.scale_queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_steps_need_no_exchange(spark):
    df = QUERIES["bucketed_customer_summary"](spark, SF)
    assert "Exchange" not in plan_of(df) and "SortMergeJoin" in plan_of(df) and df.count() == spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().count()


def test_a_hot_key_is_not_bucketed(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    assert W.has_hot_key(df, ["k"], 16) and not W.has_hot_key(df.filter("k is not null"), ["k"], 16) and not W.has_hot_key(df.limit(0), ["k"], 16)
    hot, even = W.write_bucketed(df, ["k"], 16), W.write_bucketed(df.filter("k is not null"), ["k"], 16)
    assert "Exchange" in plan_of(hot.groupBy("k").count()) and "Exchange" not in plan_of(even.groupBy("k").count())
    assert hot.count() == 1000 and even.count() == 600


def test_only_sound_versions_are_published(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(LookupError):
        W.published(spark, path)
    first = spark.createDataFrame([(1, "a"), (2, None)], "k int, `v.x` string")
    told = W.write_audited(first, path, ["k > 0", "`v.x` <> 'z'"])
    assert told["status"] == "PUBLISHED" and told["rows"] == 2 and told["nulls"] == {"k": 0, "v.x": 1} and told["violations"] == {"k > 0": 0, "`v.x` <> 'z'": 0}
    bad = W.write_audited(first.unionByName(spark.createDataFrame([(-1, "z")], first.schema)), path, ["k > 0"])
    assert bad["status"] == "REJECTED" and bad["violations"] == {"k > 0": 1} and W.published(spark, path).count() == 2
    assert [p.name for p in (tmp_path / "t" / "data").glob("version=*")] == [f"version={told['version']}"]
    assert W.write_audited(first.limit(1), path, [])["status"] == "PUBLISHED" and W.published(spark, path).count() == 1
    assert W.write_audited(first.limit(0), path, ["k > 0"])["rows"] == 0 and W.published(spark, path).count() == 0
