import json

import pytest

from veridra.api import Engine
from veridra.functions import types as TY
from veridra.operators import assets as A
from veridra.operators import drift as D
from veridra.operators import lineage as L
from veridra.operators import quality as Q
from veridra.plans import medallion as M
from veridra.plans import sqllineage as X
from veridra.queries import ORACLE, QUERIES
from veridra.sources.catalog import Catalog
from veridra.sources.config import load_config

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    edges, facts = X.as_frames(spark, *X.parse_script(M.SCRIPT, "pipeline.sql"))
    return Engine(spark, M.build(spark, SF), edges, facts)


def test_registry_is_complete():
    assert set(ORACLE) == set(QUERIES) and len(QUERIES) > 60


def test_identifiers_and_types():
    assert TY.check_identifier("a.b") == "a.b" and TY.two_part("c.a.b") == "a.b"
    for bad in ("", "1a", "a.b.c.d", "a b", "a;drop", None):
        with pytest.raises(ValueError):
            TY.check_identifier(bad)
    assert TY.is_safe_widening("integer", "BIGINT") and TY.is_safe_widening("VARCHAR", "TEXT") and TY.is_safe_widening("string", "text") and len(TY.SAFE_WIDENINGS) == 13
    assert TY.is_numeric("DECIMAL(12,2)") and TY.is_numeric("smallint") and not TY.is_numeric("VARCHAR") and not TY.is_safe_widening("VARCHAR", "STRING")
    assert not TY.is_safe_widening("BIGINT", "INTEGER") and not TY.is_safe_widening("INTEGER", "DOUBLE") and not TY.is_safe_widening("INTEGER", "INTEGER")


def test_config(tmp_path):
    (tmp_path / "config").mkdir()
    (tmp_path / "etl").mkdir()
    path = tmp_path / "config" / "config.yml"
    path.write_text("database: {type: duckdb}\nduckdb: {path: db.file}\netl: {sql_dir: etl}\nlineage: {source: auto}\n")
    c = load_config(path)
    assert c.etl_dir == tmp_path / "etl" and c.settings == {"path": "db.file"} and c.resolve_lineage_source() == "local"


def test_discovery(engine):
    assert engine.list_schemas() == {"schemas": ["conformed", "raw", "silver"]}
    assert {t["table_name"] for t in engine.list_tables("silver")["tables"]} == {"dim_customer", "dim_supplier", "fact_sales"}
    assert engine.describe_table("raw.region")["columns"] == [{"column_name": "r_regionkey", "column_type": "INTEGER"}, {"column_name": "r_name", "column_type": "VARCHAR"}]
    assert engine.get_row_count("raw.customer")["row_count"] == 150
    assert "error" in engine.get_row_count("raw.none") and "error" in engine.describe_table("x; drop")


def test_inspect_row(engine):
    assert engine.inspect_row("raw.nation", "n_nationkey", "3")["row"]["n_nationkey"] == 3
    assert engine.inspect_row("raw.nation", "n_nationkey", 999)["status"] == "not_found"
    assert engine.inspect_row("raw.nation", "n_nationkey", "abc")["status"] == "not_found"


def test_run_query(engine):
    assert engine.run_query("SELECT COUNT(*) AS n FROM region")["rows"] == [{"n": 5}]
    assert engine.run_query("WITH a AS (SELECT 1 AS updated_at) SELECT * FROM a;")["row_count"] == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "", "INSERT INTO x VALUES (1)"):
        assert "error" in engine.run_query(bad)
    big = Engine(engine.spark, Catalog.from_directory(engine.spark, "/root/testdata/sf0.01", ["orders"]))
    found = big.run_query("SELECT o_orderkey FROM orders")
    assert found["row_count"] == len(found["rows"]) == 15_000 and not found["truncated"]
    found = big.run_query("SELECT o_orderkey FROM orders", limit=10)
    assert (found["row_count"], len(found["rows"]), found["truncated"]) == (15_000, 10, True)
    assert engine.run_query("SELECT n_nationkey FROM nation WHERE n_nationkey = ?", [3])["rows"] == [{"n_nationkey": 3}]
    assert "error" in engine.run_query("SELECT 1 AS updated_at FROM region WHERE 'UPDATE' = 'x'", strict_compat=True)
    assert "error" in engine.run_query("WITH a AS (SELECT 1) SELECT * FROM a", strict_compat=True)


def test_no_text_writes(spark, engine):
    spark.sql("DROP TABLE IF EXISTS guard_target")
    spark.createDataFrame([], "x int").write.saveAsTable("guard_target")
    try:
        for sql in ("WITH t AS (SELECT 1 AS x) INSERT INTO guard_target SELECT x FROM t", "/* SELECT */ INSERT INTO guard_target VALUES (1)", "-- SELECT\nINSERT INTO guard_target VALUES (1)", "FROM (SELECT 1 AS x) INSERT INTO guard_target SELECT x"):
            assert "error" in engine.run_query(sql), sql
        assert spark.table("guard_target").count() == 0
    finally:
        spark.sql("DROP TABLE guard_target")


def test_large_graphs_are_not_taken_for_empty(spark, tmp_path, monkeypatch):
    """Above the bound of edges that the driver walks, every answer is the same."""
    rows = [(f"s.t{i + 1}", f"s.t{i}") for i in range(15)] + [("s.x", "s.t3"), ("s.t3", "s.x")]
    edges = spark.createDataFrame(rows, "target_table string, source_table string")
    small = (L.chains_from(edges, ["s.t0", "s.t15"]), {tuple(r) for r in L.impact_risk(edges).collect()}, L.lineage_tree(edges, "s.t4", 3))
    monkeypatch.setattr(L, "DRIVER_EDGES", 5)
    assert L.adjacency(edges) is None
    chains, risk, tree = L.chains_from(edges, ["s.t0", "s.t15"]), {tuple(r) for r in L.impact_risk(edges).collect()}, L.lineage_tree(edges, "s.t4", 3)
    assert {t: sorted(x) for t, x in chains.items()} == {t: sorted(x) for t, x in small[0].items()} and len(chains["s.t0"]) == 16
    assert (risk, tree) == small[1:]


def test_a_change_above_many_tables_is_red(spark):
    from veridra.plans import review as R

    edges = spark.range(200_001).selectExpr("concat('s.d', id) as target_table", "'silver.a' as source_table")
    versions = {"a.sql": ("CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT y FROM raw.b;")}
    assert R.review(versions, lambda changed: L.chains_from(edges, changed)).risk_level == "RED"


def test_platform_lineage_is_asked_first(spark, engine):
    cols = "source_table_schema string, source_table_name string, source_column_name string, target_table_schema string, target_table_name string, target_column_name string"
    rows = spark.createDataFrame([("raw", "a", "x", "silver", "fact_sales", "y")], cols)
    e = Engine(spark, engine.catalog, engine.edges, engine.facts, platform=(rows, rows))
    assert e.platform_available() and e.get_table_sources("silver.fact_sales")["sources"] == ["raw.a"]
    assert e.get_table_sources("silver.dim_customer")["sources"] == ["raw.customer"] and e.get_downstream_tables("raw.a")["downstream"] == ["silver.fact_sales"]
    assert "raw.a.x" in e.explain_column("silver.fact_sales", "y") and "AVG" in e.explain_column("conformed.segment_stats", "avg_balance")
    local = Engine(spark, engine.catalog, engine.edges, engine.facts, platform=(rows, rows), lineage_source="local")
    assert not local.platform_available() and local.get_table_sources("silver.fact_sales")["sources"] == ["raw.lineitem", "raw.orders"]
    with pytest.raises(NotImplementedError):
        Engine(spark, engine.catalog, lineage_source="elsewhere")


def test_default_engine_and_factory(spark, engine, tmp_path):
    from veridra import api
    from veridra.sources.config import connect

    api.set_engine(engine)
    assert api.get_engine() is engine and api.get_upstream_tables("silver.fact_sales") == ["raw.lineitem", "raw.orders"]
    assert "AVG" in api.trace_column_lineage("conformed.segment_stats", "avg_balance") and "silver.fact_sales" in api.get_lineage_tree("silver.fact_sales")
    api.set_engine(None)
    (tmp_path / "config").mkdir()
    (tmp_path / "data").mkdir()
    (tmp_path / "etl").mkdir()
    (tmp_path / "etl" / "a.sql").write_text("CREATE TABLE silver.a AS SELECT SUM(x) AS s FROM raw.b;")
    spark.range(3).write.parquet(str(tmp_path / "data" / "t.parquet"))
    path = tmp_path / "config" / "config.yml"
    path.write_text("database: {type: duckdb}\nduckdb: {path: data}\netl: {sql_dir: etl}\n")
    e = Engine.from_config(path, spark)
    assert e.get_row_count("t")["row_count"] == 3 and e.get_table_sources("silver.a")["sources"] == ["raw.b"]
    path.write_text("database: {type: oracle}\n")
    with pytest.raises(ValueError):
        connect(load_config(path), spark)


def test_change_validation_and_schema_conflicts(engine):
    found = engine.validate_change("CREATE TABLE silver.a AS SELECT x FROM raw.b WHERE x > 1;", "CREATE TABLE silver.a AS SELECT x FROM raw.b;")
    assert found["delta"]["changed_elements"] == ["silver.a"] and found["technical"]["risk_level"] == "MEDIUM" and found["business"]["severity"] == "MEDIUM"
    before = [{"column_name": "r_regionkey", "column_type": "VARCHAR"}, {"column_name": "r_name", "column_type": "VARCHAR"}]
    assert len(engine.schema_conflicts("raw.region", before)["blockers"]) == 1


def test_drift_command_line(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "tables" / "t.parquet"))
    args = ["--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "out")]
    assert D.main(["snapshot", *args]) == 0 and D.main(["detect", *args]) == 0
    spark.range(3).selectExpr("cast(id as string) as id").write.mode("overwrite").parquet(str(tmp_path / "tables" / "t.parquet"))
    assert D.main(["detect", *args]) == 1


def test_lineage_questions(engine):
    assert engine.get_table_sources("silver.fact_sales")["sources"] == ["raw.lineitem", "raw.orders"]
    assert engine.get_table_sources("main.silver.fact_sales")["sources"] == ["raw.lineitem", "raw.orders"]
    assert "AVG(c_acctbal)" in engine.explain_column("conformed.segment_stats", "avg_balance")
    assert "pass through" in engine.explain_column("silver.dim_customer", "c_custkey")
    assert "No lineage" in engine.explain_column("raw.customer", "c_name")
    assert engine.get_lineage_tree("silver.fact_sales") == {"silver.fact_sales": {"raw.lineitem": {"_is_source": True}, "raw.orders": {"_is_source": True}}}
    assert engine.get_lineage_tree("silver.fact_sales", 1) == {"silver.fact_sales": {"raw.lineitem": {"_truncated": True}, "raw.orders": {"_truncated": True}}}
    text = engine.analyze_impact("raw.customer")
    assert "RED" in text and "5 table(s)" in text and text.index("1 hop(s)") < text.index("2 hop(s)")
    assert "GREEN" in engine.analyze_impact("conformed.total_exposure") and "minor" in L.risk_of(1)[1] and L.risk_of(4)[0] == "YELLOW" and L.risk_of(5)[0] == "RED"


def test_explained_columns_are_remembered_until_cleared(engine):
    engine.explain_column("conformed.segment_stats", "customers")
    assert engine._explained
    engine.clear_cache()
    assert not engine._explained


def test_impact_by_joins_equals_the_walk(spark, tmp_path):
    import random

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(12)}", f"t{rng.randrange(12)}") for _ in range(20)] + [("t1", "t0"), ("t0", "t1")]
    edges = spark.createDataFrame(rows, "target_table string, source_table string")
    walk = {tuple(r) for r in L.impact(edges, "t0").collect()}
    assert walk == {tuple(r) for r in L.impact(edges, "t0", force_join=True).collect()} and walk
    edges.createOrReplaceTempView("lineage_edges")
    assert walk == {tuple(r) for r in spark.sql(L.impact_sql("t0", 7)).collect()}


def test_platform_lineage(spark):
    cols = "source_table_schema string, source_table_name string, source_column_name string, target_table_schema string, target_table_name string, target_column_name string"
    rows = spark.createDataFrame([("raw", "a", "x", "silver", "b", "y"), ("raw", "a", "x", "silver", "b", "y"), ("raw", None, None, "silver", "c", "z")], cols)
    assert [tuple(r) for r in L.platform_table_lineage(rows, "silver.b").collect()] == [("silver.b", "raw.a")]
    assert [tuple(r) for r in L.platform_column_lineage(rows, "silver.b", "y").collect()] == [("silver.b", "y", "raw.a", "x")]


def test_health(engine):
    assert {s["status"] for s in engine.check_table_health("silver.fact_sales")["sources"]} == {"OK"}
    assert "hint" in engine.check_table_health("raw.region")


def test_duplicates(spark, engine):
    c = Catalog(spark)
    c.register("fact_t", spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k int, v string"))
    e = Engine(spark, c)
    found = e.detect_duplicates("fact_t")
    assert (found["duplicate_groups"], found["extra_rows"]) == (2, 2) and "fact table" in found["explanation"]
    assert e.detect_duplicates("fact_t", "k, v")["duplicate_groups"] == 2 and "error" in e.detect_duplicates("fact_t", "none")
    assert engine.detect_duplicates("raw.region")["status"] == "CLEAN"
    arrays = spark.createDataFrame([([1], {"a": 1}), ([1], {"a": 1})], "x array<int>, m map<string,int>")
    assert Q.duplicate_summary(arrays).first()["groups"] == 1


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "2020", "2021"), (-1, None, "2022", "2021")], "id int, price double, start_date string, end_date string")
    c = Catalog(spark)
    c.register("t", df)
    rules = Q.rules_for(c.columns("t"))
    assert rules == ["end_date >= start_date OR end_date IS NULL", "id > 0", "id IS NOT NULL", "price >= 0", "start_date IS NOT NULL"]
    found = Engine(spark, c).validate_business_rules("t")
    assert {r["rule"]: r["violations"] for r in found["results"]} == {"end_date >= start_date OR end_date IS NULL": 1, "id > 0": 1, "id IS NOT NULL": 0, "price >= 0": 0, "start_date IS NOT NULL": 0}
    assert found["summary"] == {"total_rules": 5, "pass": 3, "fail": 2, "error": 0}
    assert Q.split_rules("id IN (1,2), start_date <> 'a,b'") == ["id IN (1,2)", "start_date <> 'a,b'"]
    status = {r["rule"]: r["status"] for r in Q.validate_rules(df, ["1 / (id - 1) > 0", "id > 0", "nope = 1", "DELETE x"]).collect()}
    assert status == {"1 / (id - 1) > 0": "ERROR", "id > 0": "FAIL", "nope = 1": "ERROR", "DELETE x": "SKIPPED"}


def test_scores():
    assert Q.score(0, 0, False, 0) == {"score": 100, "grade": "EXCELLENT", "issues_count": 0}
    assert Q.score(1, 0, False, 2) == {"score": 70, "grade": "GOOD", "issues_count": 3}
    assert Q.score(2, 1, True, 0)["grade"] == "POOR" and Q.score(9, 9, True, 9)["score"] == 0


def test_analysis(spark, engine):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "a", None), (4, "b", "z")], "id int, end_date string, v string")
    out = Q.analyze(df)
    assert {c["column_name"]: c["status"] for c in out["columns"]} == {"id": "OK", "end_date": "CRITICAL", "v": "WARNING"}
    assert out["quality"]["score"] == 100 - 20 - 5 - 5 and Q.analyze(df.limit(0))["status"] == "EMPTY"
    assert engine.analyze_data_quality("raw.region")["quality"]["grade"] == "EXCELLENT"
    approx = {r["column_name"]: r["distinct_count"] for r in Q.numeric_profile(df, approximate=True).collect()}
    assert approx == {"id": 4}


def test_drift_compare(spark):
    base = [("raw.users", "id", "INTEGER"), ("raw.users", "name", "VARCHAR"), ("silver.orders", "amount", "FLOAT")]
    frame = lambda rows: spark.createDataFrame(rows, D.LONG)
    assert D.compare(frame(base), frame(base)).count() == 0
    one = lambda rows: {(r["column_name"], r["change_type"], r["risk"]) for r in D.compare(frame(base), frame(rows)).collect()}
    assert one([*base, ("raw.users", "phone", "VARCHAR")]) == {("phone", "added", "GREEN")}
    assert one(base[:1]) == {("name", "removed", "RED"), ("amount", "removed", "RED")}
    assert one([("raw.users", "id", "bigint"), ("raw.users", "name", "INTEGER"), base[2]]) == {("id", "type_changed", "YELLOW"), ("name", "type_changed", "RED")}


def test_drift_enrich(spark):
    changes = spark.createDataFrame([("a", "x", "added", None, "INTEGER", "GREEN"), ("b", "x", "added", None, "INTEGER", "GREEN"), ("c", "x", "removed", "INTEGER", None, "RED")], "table_name string, column_name string, change_type string, old_type string, new_type string, risk string")
    edges = spark.createDataFrame([("t", "a"), ("t", "c")], "target_table string, source_table string")
    assert {r["table_name"]: r["risk"] for r in D.enrich(changes, edges).collect()} == {"a": "YELLOW", "b": "GREEN", "c": "RED"}


def test_drift_monitor(spark, tmp_path):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    m = D.DriftMonitor(c, tmp_path)
    assert m.detect()["total_changes"] == 0 and len(list(tmp_path.iterdir())) == 1
    before = json.loads(next(tmp_path.iterdir()).read_text())
    before["tables"]["main.t"] = [{"column_name": "k", "column_type": "BIGINT"}, {"column_name": "gone", "column_type": "DATE"}]
    next(tmp_path.iterdir()).write_text(json.dumps(before))
    out = m.detect()
    assert (out["total_changes"], out["red"], out["green"]) == (3, 2, 1) and out["risk_by_table"] == {"main.t": "RED"}
    assert [x["change_type"] for x in out["changes"]] == ["added", "removed", "type_changed"] and "gone" in out["text"]
    assert "No schema changes" in D.report([])["text"]


def test_assets(spark):
    g = A.AssetGraph(spark)
    g.load({"nodes": [{"id": "a"}, {"id": "b", "tags": ["PII"], "owner": "x"}, {"id": "c", "tags": ["public"]}], "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "c"}, {"source": None, "target": "c"}, {"source": "c", "target": "a"}]})
    assert g.analyze("a")["impacted_assets"] == ["b", "c"] and g.analyze("a", {"tags": ["PII"]})["impacted_assets"] == ["b"]
    assert g.analyze("a", {"owner": "x"})["impacted_assets"] == ["b", "c"] and g.analyze("a", {"owner": "y"})["impacted_assets"] == ["c"]
    assert g.analyze("none") == {"error": "Asset 'none' not found", "impacted_assets": []}
    g.policies = [A.Policy("p", ["PII"]), A.Policy("q", ["none"])]
    assert [p["policy_id"] for p in g.analyze("a")["policies"]] == ["p"]


@pytest.mark.parametrize("tags,applies,asset,has,want", [(["x"], [], "a", ["x"], True), (["x"], [], "a", ["y"], False), ([], [], "a", [], True), ([], ["a"], "a", ["x"], False), (["x"], ["a"], "a", ["x"], True), (["x"], ["b"], "a", ["x"], False)])
def test_policy_truth_table(spark, tags, applies, asset, has, want):
    assert A.Policy("p", tags, applies).matches(asset, has) is want
    assets = spark.createDataFrame([(asset, has)], "id string, tags array<string>")
    policies = spark.createDataFrame([("p", tags, applies, {})], A.POLICY_SCHEMA)
    assert bool(A.policy_matches(assets, policies).count()) is want


def test_plans_push_filters_and_prune(spark, engine):
    plan = engine.catalog.table("raw.orders").filter("o_orderkey = 7").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_stream_monitor(spark, tmp_path):
    from veridra.streaming.monitor import monitor_rules

    spark.range(10).selectExpr("id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    monitor_rules(stream, ["id > 3", "id >= 0"], str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("rule").sum("violations").collect()
    assert {r[0]: r[1] for r in rows} == {"id > 3": 4, "id >= 0": 0}
