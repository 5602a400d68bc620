import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veridra.api import Engine
from veridra.operators import lineage as L
from veridra.operators import quality as Q
from veridra.operators import staging
from veridra.sources.catalog import Catalog


def plan_of(df):
    return df._jdf.queryExecution().toString()


def wide(spark, n=400):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, "a", "b"]), rng.choice([0.0, -0.0, float("nan"), 1.5, None]), rng.randrange(40), "x" * rng.randrange(3), rng.choice([None, [1, None], [1]])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "a string, b string, d double, i int, `t.x` string, l array<int>").repartition(4)


def grouped(rows, key):
    same = lambda v: "nan" if v != v else v + 0.0 if isinstance(v, float) else v
    counts = Counter(str(tuple(same(r[k]) for k in key)) for r in rows)
    return {k: n for k, n in counts.items() if n > 1}


@pytest.mark.parametrize("broadcast, bits", [(500_000, 26), (0, 26), (0, 3)])
def test_digest_first_duplicates_equal_brute_force(spark, broadcast, bits):
    rows, df = wide(spark)
    kept = Q.repeated_candidates(df, df.columns, broadcast, bits)
    got = {str(tuple("nan" if v != v else v + 0.0 if isinstance(v, float) else v for v in r[:-1])): r[-1] for r in kept.groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").collect()}
    assert got == grouped(rows, range(6)) and kept.columns == df.columns
    groups = Q.duplicate_groups(df)
    assert sum(r["duplicate_count"] for r in groups.collect()) == sum(grouped(rows, range(6)).values())


def test_only_digests_and_candidates_are_shuffled(spark):
    df = spark.range(20_000).selectExpr("id", *[f"concat('some text {i} ', id) as t{i}" for i in range(8)])
    groups = Q.duplicate_groups(df.unionByName(df.filter("id % 1000 = 0")))
    assert "BroadcastHashJoin" in plan_of(groups) and groups.count() == 20
    tracker = groups._jdf.queryExecution().executedPlan().toString()
    assert tracker.count("Exchange hashpartitioning") == 1  # the candidates' own; digests were grouped before


def test_rows_kept_by_a_bitmap_do_not_move(spark):
    """More repeated digests than go to all tasks: the words of the bitmap are shuffled, and no row of the table."""
    df = spark.range(20_000).selectExpr("id", *[f"concat('some text {i} ', id) as t{i}" for i in range(8)])
    kept = Q.repeated_candidates(df.unionByName(df.filter("id % 10 = 0")), df.columns, broadcast=0)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # of the words
    assert 4_000 <= kept.count() < 8_000
    assert kept.groupBy("id").count().filter("count > 1").count() == 2_000


def test_no_duplicates_and_empty_tables(spark):
    df = spark.range(100).selectExpr("id", *[f"cast(id as string) as t{i}" for i in range(5)])
    assert Q.duplicate_groups(df).count() == 0 and Q.duplicate_groups(df.limit(0)).columns == [*df.columns, "duplicate_count"]


def test_evidence_tells_copies_from_fan_out(spark):
    rows = [(1, "p", None), (1, "p", "x"), (2, "q", "y"), (2, "q", "y"), (3, "r", "z")]
    df = spark.createDataFrame(rows, "k int, same string, other string")
    assert {r["column_name"]: (r["varying_groups"], r["groups"]) for r in Q.duplicate_evidence(df, ["k"]).collect()} == {"same": (0, 2), "other": (1, 2)}
    catalog = Catalog(spark)
    catalog.register("t", df)
    told = Engine(spark, catalog).detect_duplicates("t", "k")["explanation"]
    assert "other (1 of 2 groups)" in told and "same (" not in told
    catalog.register("u", df.filter("k = 2"))
    assert "they are copies" in Engine(spark, catalog).detect_duplicates("u", "k")["explanation"]


def test_rule_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as place", "map('a', id) as m", "named_struct('z', id) as s")
    rules = ["id < 500", "place <> 3", "id >= 0"]
    got = sorted((r[0], r[1], r[2]) for r in Q.rule_samples(df.drop("m"), rules, [F.desc("id")], 3).collect())
    assert got == [("id < 500", 1, 999), ("id < 500", 2, 998), ("id < 500", 3, 997), ("place <> 3", 1, 997), ("place <> 3", 2, 990), ("place <> 3", 3, 983)]
    assert "WindowGroupLimit" in plan_of(Q.rule_samples(df, rules, [F.desc("id")], 3))
    catalog = Catalog(spark)
    catalog.register("t", df.drop("m"))
    found = {r["rule"]: r for r in Engine(spark, catalog).validate_business_rules("t", rules)["results"]}
    assert [x["id"] for x in found["id < 500"]["sample"]] == [500, 501, 502, 503, 504] and found["id < 500"]["sample"][0]["s"] == {"z": 500}
    assert [x["id"] for x in found["place <> 3"]["sample"]] == [3, 10, 17, 24, 31] and "sample" not in found["id >= 0"]


def test_typed_texts(spark):
    df = spark.createDataFrame([("2024-01-01", "1", "x", None), ("2024-02-01 10:00:00", "-22", "2", None), (None, "+3", "1.5", None)], "d string, n string, mixed string, empty string")
    assert Q.typed_texts(df) == [{"column_name": "d", "issue": "date stored as text"}, {"column_name": "n", "issue": "integer stored as text"}]
    assert Q.text_forms(df.select(F.lit(1).alias("i"))).count() == 0
    assert [i["column_name"] for i in Q.analyze(df)["typed_texts"]] == ["d", "n"]


def test_all_definitions_are_counted(spark):
    facts = spark.range(150).selectExpr("'s.t' as target_table", "'c' as target_column", "'s.u' as source_table", "'COMPUTED' as source_column", "concat('x + ', id) as transformation_logic", "format_string('%03d.sql', id) as sql_file_name")
    told = L.explain_column(facts, facts.select("target_table", "source_table"), "s.t", "c")
    assert "149 other definition(s)" in told and "000.sql" in told


def test_release_leaves_no_staged_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}")
    _, df = wide(spark, 50)
    Q.duplicate_groups(df).collect()
    assert list(tmp_path.iterdir())
    staging.release(spark)
    assert not list(tmp_path.iterdir())
    engine = Engine(spark, Catalog(spark))
    engine.catalog.register("t", df.unionByName(df))
    assert engine.detect_duplicates("t")["status"] == "DUPLICATES_FOUND" and list(tmp_path.iterdir())
    engine.close()
    assert not list(tmp_path.iterdir()) and engine.edges is None


def test_without_a_shared_folder_only_a_single_machine_may_stage(monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "local[2]"

    assert staging.shared_dir(Session) == staging.shared_dir(Session) and staging.shared_dir(Session).startswith("file:///")
    Session.sparkContext.master = "spark://far:7077"
    with pytest.raises(RuntimeError):
        staging.shared_dir(Session)
