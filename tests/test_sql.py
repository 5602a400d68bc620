import subprocess

import pytest

from veridra.plans import codelineage as C
from veridra.plans import medallion as M
from veridra.plans import review as R
from veridra.plans import sqllineage as X
from veridra.plans import sqltext as S
from veridra.queries import EDGES, FAULTY, FINDINGS


def test_pipeline_edges():
    edges, facts = X.parse_script(M.SCRIPT, "p.sql")
    assert sorted((e[0], e[1]) for e in edges) == sorted(EDGES) and len(facts) == 9


def test_scanner_knows_strings_and_comments():
    sql = "SELECT 'a;--b' AS x; -- c; d\nSELECT /* ; */ 2;;"
    assert [s.split()[0] for s in S.statements(sql)] == ["SELECT", "--"] or len(S.statements(sql)) == 2
    assert S.without_comments("a -- b\n/* c */ d '--e'").split() == ["a", "d", "'--e'"]


def test_sources():
    of = lambda sql: S.sources(S.tokens(sql))
    assert of("WITH c AS (SELECT * FROM raw.a) SELECT EXTRACT(year FROM d) FROM c, raw.b x, (SELECT 1 FROM raw.e) y LEFT JOIN cat.s.t ON true") == ["cat.s.t", "raw.a", "raw.b", "raw.e"]
    edges, _ = X.parse_statement("CREATE TABLE Raw.T AS SELECT * FROM raw.t JOIN raw.u ON 1=1", "f")
    assert [e[1] for e in edges] == ["raw.u"]


def test_facts():
    _, facts = X.parse_statement("CREATE VIEW v AS SELECT CASE WHEN a THEN CASE WHEN b THEN 1 END END x, COUNT(DISTINCT f(y)) AS n, COALESCE(z, 0), SUM(q) total FROM t", "f.sql")
    assert [(f[1], f[3]) for f in facts] == [("x", "COMPUTED"), ("n", "AGGREGATED"), ("total", "AGGREGATED")]
    assert X.parse_statement("SELECT 1", "f") == ([], []) and X.parse_statement("CREATE TABLE a AS SELECT SUM(1) AS s", "f")[1][0][2] == "UNKNOWN"


def test_publish_and_cli(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "b.sql").write_text(M.SCRIPT)
    (tmp_path / "sql" / "a.sql").write_text("CREATE TABLE conformed.segment_stats AS SELECT SUM(x) AS avg_balance FROM silver.dim_customer")
    assert X.main(["--sql-dir", str(tmp_path / "sql"), "--out", str(tmp_path / "meta")]) == 0
    assert X.main(["--sql-dir", str(tmp_path / "sql"), "--out", str(tmp_path / "meta")]) == 0
    edges, facts = X.published(spark, str(tmp_path / "meta"))
    assert edges.count() == 15 and facts.count() == 10
    assert X.main(["--sql-dir", str(tmp_path / "none"), "--out", str(tmp_path / "m")]) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["meta", "sql"]


@pytest.mark.parametrize("file", FAULTY)
def test_each_rule_fires_alone(file):
    assert [f["rule"] for f in R.check_syntax(FAULTY[file])] == [r for f, r in FINDINGS if f == file]


@pytest.mark.parametrize("sql", [
    "", "SELECT 1", "SELECT platform x FROM raw.t", "CREATE TABLE silver.a AS SELECT SUM(x) AS s FROM raw.b",
    "CREATE TABLE silver.a AS SELECT k, SUM(x) OVER (PARTITION BY k) AS s FROM raw.b", "SELECT ')' AS p FROM raw.b -- (",
    "CREATE TABLE silver.a AS SELECT b.k AS kk, COUNT(*) AS n FROM raw.b b GROUP BY b.k HAVING COUNT(*) > 1",
])
def test_clean_sql_has_no_findings(sql):
    assert R.check_syntax(sql) == []


def test_schema_suggestions():
    assert R.closest("silvr", ("silver", "raw")) == "silver" and R.closest("slver", ("silver",)) is None and R.closest("zzz", ()) is None
    assert R.check_syntax("SELECT x FROM goldd.t")[0]["message"].endswith("(did you mean 'gold'?)")
    assert R.check_syntax("SELECT x FROM mine.t", ("mine",)) == []


def test_joins_and_risks():
    sql = "SELECT * FROM a x JOIN raw.orders o ON x.i = o.i LEFT JOIN c ON 1=1 CROSS JOIN d WHERE z > 1"
    assert [(j["type"], j["table"], j["condition"]) for j in S.joins(sql)] == [("JOIN", "raw.orders", "x.i = o.i"), ("LEFT JOIN", "c", "1=1"), ("CROSS JOIN", "d", "")]
    assert len(R.cartesian_risks(sql)) == 2 and R.cartesian_risks("SELECT * FROM a JOIN b USING (k)") == []
    assert R.filter_risks(sql, "SELECT 1")[0]["severity"] == "MEDIUM" and R.filter_risks("", "SELECT 1 FROM t WHERE a = NULL")[0]["severity"] == "LOW" and R.filter_risks(sql, sql) == []
    assert R.overly_restrictive("a AND b AND c AND d") and not R.overly_restrictive("a AND b\nAND c AND d")


def test_validators():
    facts = X.parse_script("CREATE TABLE silver.b AS SELECT SUM(x) AS s FROM silver.a", "f")[1]
    old, new = "CREATE TABLE silver.a AS SELECT x, y FROM raw.t WHERE y > 0", "CREATE TABLE silver.a AS SELECT y FROM raw.t WHERE y > 0"
    out = R.validate_technical(old, new, ["silver.a.x"], facts)
    assert {(b["blocker_type"], b["severity"]) for b in out["blockers"]} == {("schema_drift", "HIGH"), ("type_conflict", "MEDIUM")} and out["risk_level"] == "HIGH"
    assert R.validate_technical(old, "SELECT (1", [], facts)["blockers"][0]["blocker_type"] == "syntax_error"
    assert R.validate_technical(old, old)["risk_level"] == "NONE"
    business = R.validate_business("SELECT x FROM t", "SELECT SUM(x) FROM t JOIN u ON a = b WHERE c")
    assert business["severity"] == "HIGH" and len(business["changes"]) == 3 and not R.validate_business("SELECT 1", "SELECT 1")["metric_drift"]


def test_block_changes_and_summaries():
    out = R.block_changes("SELECT a AS x FROM t", "SELECT a AS y FROM t JOIN u ON i = j WHERE a > 1")
    assert out["has_integrity_impact"] and out["where_modified"] and out["columns_modified"] == ["y", "x"]
    assert R.old_summary("") == "(none)" and R.old_summary("SELECT a FROM t LEFT JOIN u ON i = j JOIN v ON k = l WHERE a > 1 GROUP BY a") == "WHERE a > 1; 1 LEFT JOIN(s), 1 other JOIN(s); GROUP BY"
    assert R.is_noise(" -- x") and R.is_noise("") and not R.is_noise("SELECT 1") and R.is_etl_sql("INSERT INTO t SELECT 1") and not R.is_etl_sql("SELECT 'CREATE TABLE'")


def test_grain_mismatch():
    blocks = {"s.a": "CREATE TABLE s.a AS SELECT emp_id FROM t GROUP BY emp_id", "s.b": "CREATE TABLE s.b AS SELECT company_id FROM s.a GROUP BY company_id"}
    assert [(g["grain"], g["downstream_grain"]) for g in R.grain_mismatches(blocks, ["s.a"], {"s.a": [("s.b", 1)]})] == [("employee", "company")]


def test_review_from_git(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.sql").write_text("CREATE TABLE silver.a AS SELECT k, AVG(x) AS m FROM raw.b GROUP BY k;\n")
    (tmp_path / "same.sql").write_text("CREATE TABLE silver.same AS SELECT 1 AS one;\n")
    git("add", "."), git("commit", "-qm", "x")
    assert R.review(R.git_versions(tmp_path), {}).risk_level == "GREEN"
    (tmp_path / "a.sql").write_text("CREATE TABLE silver.a AS SELECT k, MAX(x) AS m FROM raw.b GROUP BY k;\n")
    out = R.review(R.git_versions(tmp_path), {"silver.a": ["gold.z"]}, context=R.build_context(tmp_path))
    assert out.risk_level == "YELLOW" and out.changed_tables == ["silver.a"] and "AVG() changed to MAX()" in out.formatted_output and "gold.z" in out.formatted_output
    assert R.git_versions(tmp_path, staged_only=True) == {} and set(R.git_versions(tmp_path, include_unchanged=True)) == {"a.sql", "same.sql"}
    (tmp_path / "new.sql").write_text("CREATE TABLE silver.n AS SELCT 1;\n")
    assert R.review(R.git_versions(tmp_path), {}).risk_level == "RED"


def test_code_lineage():
    code = 'a = df.select("x", col("y"))\nb = a.withColumn("z", F.col("x") + a["y"]).filter(col("z") > 1)\nc = b.withColumnRenamed("z", "w").drop("x")\n@F.udf("int")\ndef f(p, q):\n    return p\ng = udf(lambda r: r)\n'
    out = C.analyze_code(code)
    assert [u["name"] for u in out["udfs"]] == ["f", "g"] or {u["name"] for u in out["udfs"]} == {"f", "g"}
    assert [o["operation"] for o in out["operations"]] == ["select", "withColumn", "filter", "withColumnRenamed", "drop"]
    assert set(C.upstream_columns(out["edges"], "b", "z")) == {"a.x", "a.y", "df.x", "df.y"} and C.upstream_columns(out["edges"], "no", "no") == []
    assert C.column_paths(out["edges"], ("df", "x"), ("b", "z")) == [["df.x", "a.x", "b.z"]]


def test_code_folder(tmp_path):
    (tmp_path / "good.py").write_text('a = df.select("x")')
    (tmp_path / "bad.py").write_text("a = (")
    out = C.analyze_folder(tmp_path)
    assert out["good.py"]["summary"]["edges"] == 1 and "error" in out["bad.py"]


def test_run_script(spark):
    for t in ("out_t", "out_u"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    M.run_script(spark, "CREATE OR REPLACE TABLE out_t AS SELECT 1 AS a, ';' AS b; -- done\nCREATE OR REPLACE TABLE out_t AS SELECT 2 AS a; CREATE OR REPLACE TABLE out_u AS SELECT a + 1 AS a FROM out_t")
    assert spark.table("out_u").first()[0] == 3
    for t in ("out_t", "out_u"):
        spark.sql(f"DROP TABLE {t}")


def test_catalyst_origins(spark):
    from veridra.plans import catalyst

    spark.range(3).selectExpr("id", "id AS v").createOrReplaceTempView("one")
    spark.range(3).selectExpr("id AS k").createOrReplaceTempView("two")
    of = lambda sql: sorted(catalyst.column_origins(spark.sql(sql)))
    names = lambda sql: sorted({(a, b) for a, b, *_ in of(sql)})
    assert names("SELECT id, v + 1 AS w, 1 AS c FROM one") == [("id", "PASSTHROUGH"), ("w", "EXPRESSION")]
    assert names("SELECT MAX(w) AS m FROM (SELECT v * 2 AS w FROM one) x") == [("m", "AGGREGATED")]
    assert names("SELECT id AS x FROM one UNION ALL SELECT k FROM two") == [("x", "PASSTHROUGH")]
    assert catalyst.analysis_error(spark, "SELECT nope FROM one") == "UNRESOLVED_COLUMN.WITH_SUGGESTION"


def test_windows_do_not_hide_missing_groups():
    found = lambda sql: [x["rule"] for x in R.check_syntax(f"CREATE TABLE silver.a AS {sql};")]
    assert found("SELECT k, SUM(x) OVER () AS s, COUNT(*) AS c FROM raw.b") == ["agg_without_group_by"]
    assert found("SELECT k, SUM(x) OVER (PARTITION BY k) AS s FROM raw.b") == [] and found("SELECT k, SUM(x) FILTER (WHERE x > 0) OVER () AS s FROM raw.b") == []


def test_context_files(tmp_path):
    (tmp_path / "etl").mkdir()
    (tmp_path / "etl" / "a.sql").write_text("-- makes a\nCREATE TABLE silver.a AS SELECT 1 AS one;")
    (tmp_path / "b.sql").write_text("CREATE INDEX i ON a (x);")
    whole = R.build_context(tmp_path, output=tmp_path / "out" / "context.json")
    assert [f["path"] for f in whole["etl_files"]] == ["etl/a.sql"] and [f["path"] for f in whole["other_sql_files"]] == ["b.sql"]
    assert R.load_context(tmp_path / "out" / "context.json") == whole and R.load_context(tmp_path / "none.json") is None
    assert R.build_context(tmp_path, folders=[tmp_path / "etl"])["other_sql_files"] == []
    (tmp_path / "bad.json").write_text("{")
    assert R.load_context(tmp_path / "bad.json") is None


def test_deltas_of_files(tmp_path):
    old, new = tmp_path / "old.sql", tmp_path / "new.sql"
    old.write_text("CREATE TABLE silver.a AS SELECT x FROM raw.b;")
    new.write_text("CREATE TABLE silver.a AS SELECT x, y FROM raw.b JOIN raw.c ON b.i = c.i;")
    found = R.delta_of_files(old, new)
    assert found["changed_elements"] == ["silver.a", "silver.a.y"] and found["has_integrity_impact"] and "[silver.a]" in found["changes"]["silver.a"]
    assert "No analysis" in R.delta_of_files(old, tmp_path / "x.py")["description"]
    merged = R.delta_of_versions({"a.sql": (old.read_text(), new.read_text()), "b.sql": ("", "CREATE TABLE silver.b AS SELECT 1 AS one;")})
    assert merged["changed_elements"] == ["silver.a.y", "silver.b.one"] and set(merged["changes"]) == {"silver.a", "silver.b"}
    samples = R.code_samples({"a.sql": ("old a", "new a"), "b.sql": ("", "new b")})
    assert samples == {"old": "-- a.sql\nold a", "new": "-- a.sql\nnew a\n\n-- b.sql\nnew b"}
