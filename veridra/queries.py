"""The engine's own queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .operators import assets as A
from .operators import drift as D
from .operators import lineage as L
from .operators import quality as Q
from .plans import catalyst
from .plans import codelineage as C
from .plans import medallion as M
from .plans import review as R
from .plans import sqllineage as X
from .sources.catalog import Catalog

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def tables(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_directory(spark, sf_dir, M.RAW)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, tables(spark, sf_dir))


def sql_query(name: str, spark_sql: str, duck_sql: str | None = None, params: list | None = None) -> None:
    """An ad-hoc SELECT over the tables, through the engine's guard."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(spark_sql, params)

    QUERIES[name] = run
    ORACLE[name] = duck_sql or spark_sql


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else "[" + ", ".join(map(show, v)) + "]" if isinstance(v, (list, tuple)) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# Discovery


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in M.RAW))
def table_row_counts(spark, sf_dir):
    return tables(spark, sf_dir).row_counts()


@query(f"""SELECT table_name, column_name, data_type AS column_type, ordinal_position::INTEGER AS ordinal FROM information_schema.columns
WHERE table_name IN ({", ".join(f"'{t}'" for t in M.RAW)})""")
def table_columns(spark, sf_dir):
    return tables(spark, sf_dir).column_listing()


@query(f"""SELECT DISTINCT 'main' AS table_schema, table_name FROM information_schema.tables WHERE table_name IN ({", ".join(f"'{t}'" for t in M.RAW)})""")
def table_listing(spark, sf_dir):
    return tables(spark, sf_dir).listing()


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def inspect_row_order(spark, sf_dir):
    found, schema = engine(spark, sf_dir).inspect_row("orders", "o_orderkey", "7"), tables(spark, sf_dir).table("orders").schema
    return spark.createDataFrame([tuple(found["row"][f.name] for f in schema)] if "row" in found else [], schema)


sql_query("adhoc_select", "SELECT o_orderstatus, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus HAVING COUNT(*) > 1 ORDER BY o_orderstatus")
sql_query("adhoc_window", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
sql_query("adhoc_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count, SUM(l_linenumber) AS numbers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count, SUM(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("adhoc_grouping_sets", "SELECT l_returnflag, l_shipmode_free.k AS size_class, COUNT(*) AS line_count FROM (SELECT l_returnflag, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS k FROM lineitem) l_shipmode_free GROUP BY GROUPING SETS ((l_returnflag), (k))")
sql_query("adhoc_set_ops", "(SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL (SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer)")
sql_query("adhoc_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql_query("adhoc_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("adhoc_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n, n * n AS square FROM r")
sql_query("adhoc_json", "SELECT event_type, COUNT(*) AS n, COUNT(get_json_object(props, '$.k')) AS with_k FROM events GROUP BY event_type", "SELECT event_type, COUNT(*) AS n, COUNT(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")

sql_query("adhoc_params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000", ["F", 100000])
sql_query("adhoc_all_rows", "SELECT l_orderkey, l_linenumber FROM lineitem")
sql_query("adhoc_dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, COUNT(*) AS orders, CAST(MAX(datediff(DATE '2030-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS age FROM orders GROUP BY 1, 2", "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, COUNT(*) AS orders, MAX(date_diff('day', o_orderdate::DATE, DATE '2030-01-01')) AS age FROM orders GROUP BY 1, 2")
sql_query("adhoc_strings", "SELECT regexp_extract(c_name, '([0-9]+)$', 1) AS number, CONCAT(c_mktsegment, '/', LOWER(SUBSTRING(c_name, 1, 4))) AS label, NULLIF(c_nationkey, 7) AS nation, LENGTH(TRIM(c_name)) AS n FROM customer", "SELECT regexp_extract(c_name, '([0-9]+)$', 1) AS number, CONCAT(c_mktsegment, '/', LOWER(SUBSTRING(c_name, 1, 4))) AS label, NULLIF(c_nationkey, 7) AS nation, LENGTH(TRIM(c_name))::INTEGER AS n FROM customer")
sql_query("adhoc_arrays", "SELECT o_custkey, SIZE(COLLECT_SET(o_orderstatus)) AS kinds, ARRAY_JOIN(SORT_ARRAY(COLLECT_SET(o_orderstatus)), ',') AS listed FROM orders GROUP BY o_custkey", "SELECT o_custkey, COUNT(DISTINCT o_orderstatus)::INTEGER AS kinds, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS listed FROM orders GROUP BY o_custkey")

GUARDED = [
    ("SELECT 1 AS x", True), ("  select n_name from nation;", True), ("WITH t AS (SELECT 1 AS x) SELECT x FROM t", True), ("(SELECT 1 AS x) UNION (SELECT 2)", True), ("SELECT 'DROP TABLE x' AS updated_at", True),
    ("WITH t AS (SELECT 1 AS x) INSERT INTO guard_target SELECT x FROM t", False), ("/* SELECT */ INSERT INTO guard_target VALUES (1)", False), ("DROP TABLE x", False), ("SELECT 1; DROP TABLE x", False),
    ("CREATE TABLE x AS SELECT 1", False), ("FROM nation INSERT INTO guard_target SELECT n_nationkey", False), ("DELETE FROM x", False), ("SET a = b", False), ("", False), ("TRUNCATE TABLE x", False), ("INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1", False),
]


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{s.replace(chr(39), chr(39) * 2)}{chr(39)}, {str(ok).lower()})' for s, ok in GUARDED)}) g(sql_text, allowed)")
def guard_verdicts(spark, sf_dir):
    """Which texts the engine runs; those refused are never run."""
    e = engine(spark, sf_dir)
    return spark.createDataFrame([(s, "error" not in e.run_query(s)) for s, _ in GUARDED], "sql_text string, allowed boolean")


@query("SELECT 'main' AS table_schema")
def schema_listing(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in engine(spark, sf_dir).list_schemas()["schemas"]], "table_schema string")


# Duplicates.  The tables repeat few rows, so some cases are made: a slice united with itself.


@query("SELECT user_id, event_type, COUNT(*) AS duplicate_count FROM events GROUP BY ALL HAVING COUNT(*) > 1")
def dup_events_user_type(spark, sf_dir):
    return Q.duplicate_groups(tables(spark, sf_dir).table("events"), ["user_id", "event_type"])


@query("SELECT text, COUNT(*) AS duplicate_count FROM documents GROUP BY text HAVING COUNT(*) > 1")
def dup_documents_text(spark, sf_dir):
    return Q.duplicate_groups(tables(spark, sf_dir).table("documents"), ["text"])


@query("SELECT o_custkey, COUNT(*) AS duplicate_count FROM orders GROUP BY o_custkey HAVING COUNT(*) > 1")
def dup_orders_by_customer(spark, sf_dir):
    return Q.duplicate_groups(tables(spark, sf_dir).table("orders"), ["o_custkey"])


@query("SELECT *, COUNT(*) AS duplicate_count FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) GROUP BY ALL HAVING COUNT(*) > 1")
def dup_lineitem_all(spark, sf_dir):
    line = tables(spark, sf_dir).table("lineitem")
    return Q.duplicate_groups(line.unionByName(line.filter("l_returnflag = 'R' AND l_linenumber = 1")))


@query("""SELECT COUNT(*) AS groups, SUM(n)::BIGINT AS rows_in_groups, (SUM(n) - COUNT(*))::BIGINT AS extra_rows
FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)""")
def dup_summary(spark, sf_dir):
    return Q.duplicate_summary(tables(spark, sf_dir).table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT k, COUNT(*) AS duplicate_count FROM (SELECT CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS k FROM customer) GROUP BY k HAVING COUNT(*) > 1")
def dup_null_keys(spark, sf_dir):
    c = tables(spark, sf_dir).table("customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("k"))
    return Q.duplicate_groups(c, ["k"])


@query("SELECT o_custkey, COUNT(*) AS duplicate_count FROM orders GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")
def dup_top_groups(spark, sf_dir):
    return Q.duplicate_sample(tables(spark, sf_dir).table("orders"), ["o_custkey"])


@query("SELECT doc_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_documents(spark, sf_dir):
    return Q.dedupe(tables(spark, sf_dir).table("documents").select("doc_id", "text"), ["text"], [F.col("doc_id")])


# Rules

ORDER_RULES = ["o_totalprice >= 0", "o_totalprice < 150000", "o_orderstatus IN ('F', 'O')", "o_custkey > 0"]
NULL_RULES = ["v >= 0", "v < 5000", "v IS NOT NULL"]


def _rule_sql(table: str, rules: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{r.replace(chr(39), chr(39) * 2)}' AS rule, COUNT(*) FILTER (WHERE NOT ({r})) AS violations FROM {table}" for r in rules)


@query(_rule_sql("orders", ORDER_RULES))
def rules_orders(spark, sf_dir):
    return Q.rule_violations(tables(spark, sf_dir).table("orders"), ORDER_RULES)


@query(_rule_sql("(SELECT CASE WHEN c_acctbal < 9000 THEN c_acctbal END AS v FROM customer)", NULL_RULES))
def rules_with_nulls(spark, sf_dir):
    return Q.rule_violations(tables(spark, sf_dir).table("customer").select(F.when(F.col("c_acctbal") < 9000, F.col("c_acctbal")).alias("v")), NULL_RULES)


@query(
    "SELECT rule, CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status, violations FROM ("
    + _rule_sql("orders", ["o_totalprice >= 0", "o_totalprice < 150000"]) + ") UNION ALL SELECT 'no_such_column > 0', 'ERROR', NULL UNION ALL SELECT 'DROP TABLE x', 'SKIPPED', NULL"
)
def rules_status(spark, sf_dir):
    return Q.validate_rules(tables(spark, sf_dir).table("orders"), ["o_totalprice >= 0", "o_totalprice < 150000", "no_such_column > 0", "DROP TABLE x"]).drop("reason")


@query("""SELECT 'l_extendedprice >= 0' AS rule, COUNT(*) FILTER (WHERE NOT (l_extendedprice >= 0)) AS violations FROM lineitem
UNION ALL SELECT 'l_quantity >= 0', COUNT(*) FILTER (WHERE NOT (l_quantity >= 0)) FROM lineitem""")
def rules_autodetect(spark, sf_dir):
    line = tables(spark, sf_dir)
    return Q.rule_violations(line.table("lineitem"), Q.rules_for(line.columns("lineitem")))


#: The rules that names and types should suggest, written out from the rules' description.
DETECTED = [
    ("contracts", [("contract_id", "BIGINT"), ("start_date", "DATE"), ("end_date", "DATE"), ("salary", "DECIMAL(12,2)"), ("note", "VARCHAR")], ["contract_id > 0", "contract_id IS NOT NULL", "end_date >= start_date OR end_date IS NULL", "start_date IS NOT NULL", "salary >= 0"]),
    ("shifts", [("shift_start_date", "DATE"), ("end_date", "DATE")], ["end_date >= shift_start_date OR end_date IS NULL", "shift_start_date IS NOT NULL"]),
    ("open_ended", [("start_date", "DATE"), ("final_end_date", "DATE")], []),
    ("amounts", [("price", "DOUBLE"), ("total", "DOUBLE"), ("balance", "FLOAT"), ("unit_cost", "NUMERIC"), ("quantity", "INTEGER"), ("revenue", "VARCHAR"), ("amount_small", "SMALLINT")], ["price >= 0", "unit_cost >= 0", "quantity >= 0", "amount_small >= 0"]),
    ("keys", [("id", "VARCHAR"), ("paid", "BOOLEAN")], ["id IS NOT NULL", "paid IS NOT NULL"]),
]


@query(f"SELECT * FROM (VALUES {_values([(t, r) for t, _, rules in DETECTED for r in rules])}) d(table_name, rule)")
def rules_detected(spark, sf_dir):
    listed = lambda columns: [{"column_name": n, "column_type": k} for n, k in columns]
    return spark.createDataFrame([(t, r) for t, columns, _ in DETECTED for r in Q.rules_for(listed(columns))], "table_name string, rule string")


@query(f"SELECT * FROM (VALUES {_values([(w, 'SKIPPED') for w in ('DROP', 'DELETE', 'UPDATE', 'INSERT', 'TRUNCATE')])}, ('ALTER', 'ERROR')) r(word, status)")
def rules_forbidden(spark, sf_dir):
    words = ("DROP", "DELETE", "UPDATE", "INSERT", "TRUNCATE", "ALTER")
    return Q.validate_rules(tables(spark, sf_dir).table("region"), [f"{w} TABLE x" for w in words]).select(F.substring_index("rule", " ", 1).alias("word"), "status")


@query("SELECT * FROM customer WHERE NOT (c_acctbal >= 0)")
def rule_violating_rows(spark, sf_dir):
    return Q.violating_rows(tables(spark, sf_dir).table("customer"), "c_acctbal >= 0")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal >= 0) ORDER BY c_acctbal, c_custkey LIMIT 5")
def rule_violation_sample(spark, sf_dir):
    return Q.violating_rows(tables(spark, sf_dir).table("customer"), "c_acctbal >= 0").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(5)


# Profiles


def _nulled(catalog: Catalog) -> DataFrame:
    """customer with made nulls: few, many and most of a column."""
    c = catalog.table("customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_nationkey") > 20, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


_NULLED_SQL = "(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_nationkey > 20 THEN c_name END AS c_name, CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"
_NULL_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, ROUND(100 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*), 2) AS null_pct, "
    f"CASE WHEN 100 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) < 5 THEN 'OK' WHEN 100 * COUNT(*) FILTER (WHERE {c} IS NULL) / COUNT(*) < 50 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM {_NULLED_SQL}"
    for c in ("c_custkey", "c_acctbal", "c_name", "c_mktsegment")
)


@query(_NULL_PROFILE)
def null_profile(spark, sf_dir):
    return Q.null_profile(_nulled(tables(spark, sf_dir)))


_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, MIN({c})::DOUBLE AS min_value, MAX({c})::DOUBLE AS max_value, ROUND(AVG({c}), 4) AS avg_value, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem" for c in _NUMERIC))
def numeric_profile(spark, sf_dir):
    return Q.numeric_profile(tables(spark, sf_dir).table("lineitem")).withColumn("avg_value", F.round("avg_value", 4))  # sums of doubles depend on their order


@query("SELECT column_name, 'date stored as text' AS issue FROM (VALUES ('o_orderdate')) t(column_name)")
def type_issues(spark, sf_dir):
    o = tables(spark, sf_dir).table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return spark.createDataFrame([(i["column_name"], i["issue"]) for i in Q.type_issues(o)], "column_name string, issue string")


@query(f"""WITH p AS ({_NULL_PROFILE}), n AS (SELECT COUNT(*) FILTER (WHERE status = 'CRITICAL') AS critical, COUNT(*) FILTER (WHERE status = 'WARNING') AS warning FROM p),
d AS (SELECT CASE WHEN COUNT(*) > COUNT(DISTINCT c_custkey % 100) THEN 1 ELSE 0 END AS duplicates FROM customer),
s AS (SELECT critical, warning, duplicates, 0 AS type_issues, GREATEST(0, 100 - 20 * critical - 5 * warning - 15 * duplicates)::BIGINT AS score FROM n, d)
SELECT *, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'POOR' END AS grade FROM s""")
def quality_score(spark, sf_dir):
    return Q.score_frame(_nulled(tables(spark, sf_dir)), ["c_mktsegment"])


@query(f"""WITH p AS ({_NULL_PROFILE}), n AS (SELECT COUNT(*) FILTER (WHERE status = 'CRITICAL') AS critical, COUNT(*) FILTER (WHERE status = 'WARNING') AS warning FROM p),
s AS (SELECT critical + warning AS issues, GREATEST(0, 100 - 20 * critical - 5 * warning)::BIGINT AS score FROM n)
SELECT COUNT(*) AS row_count, ANY_VALUE(s.issues)::BIGINT AS issues, ANY_VALUE(s.score) AS score, CASE WHEN ANY_VALUE(s.score) >= 90 THEN 'EXCELLENT' WHEN ANY_VALUE(s.score) >= 70 THEN 'GOOD' WHEN ANY_VALUE(s.score) >= 50 THEN 'FAIR' ELSE 'POOR' END AS grade FROM customer, s""")
def quality_analysis(spark, sf_dir):
    found = Q.analyze(_nulled(tables(spark, sf_dir)))
    return spark.createDataFrame([(found["row_count"], found["quality"]["issues_count"], found["quality"]["score"], found["quality"]["grade"])], "row_count long, issues long, score long, grade string")


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer)
SELECT COUNT(*) AS outlier_count FROM customer, q WHERE c_acctbal < a - 1.5 * (b - a) OR c_acctbal > b + 1.5 * (b - a)""")
def outlier_count(spark, sf_dir):
    return Q.outliers(tables(spark, sf_dir).table("customer"), "c_acctbal").agg(F.count(F.lit(1)).alias("outlier_count"))


@query("""SELECT 'raw.lineitem' AS source_table, COUNT(*) AS row_count, 'OK' AS status FROM lineitem UNION ALL SELECT 'raw.orders', COUNT(*), 'OK' FROM orders
UNION ALL SELECT 'raw.void', 0, 'EMPTY' UNION ALL SELECT 'raw.missing', NULL, 'ERROR'""")
def source_health(spark, sf_dir):
    c = M.build(spark, sf_dir)
    edges, _ = X.as_frames(spark, *X.parse_script(M.SCRIPT, "pipeline.sql"))
    known = {r[0]: c.table(r[0]) for r in L.upstream(edges, "silver.fact_sales").collect()}
    return Q.source_health({**known, "raw.void": c.table("raw.orders").limit(0), "raw.missing": None}, spark)


CAUSED = ["Missing DISTINCT in source SQL transformation", "JOIN conditions creating cartesian products", "Data entry errors (true duplicates)", "Missing unique constraints"]


@query(f"SELECT * FROM (VALUES {_values([(c, 'true') for c in CAUSED])}) c(cause, told)")
def dup_causes(spark, sf_dir):
    """The causes that the narrative of duplicates names."""
    told = engine(spark, sf_dir).detect_duplicates("orders", "o_orderstatus")["explanation"]
    return spark.createDataFrame([(c, str(c in told).lower()) for c in CAUSED], "cause string, told string")


@query("SELECT * FROM (VALUES (1, 'Asia', 2.5::DOUBLE), (2, NULL, NULL)) v(id, name, weight)")
def values_source(spark, sf_dir):
    return M.values_table(spark, [(1, "Asia", 2.5), (2, None, None)], "id int, name string, weight double")


@query("SELECT o_orderstatus, COUNT(*) AS orders FROM orders GROUP BY o_orderstatus")
def script_steps(spark, sf_dir):
    """The last statement of a SQL script over views that its first ones make."""
    tables(spark, sf_dir).as_views()
    return M.run_script(spark, "CREATE OR REPLACE TEMP VIEW step_one AS SELECT o_orderstatus FROM orders; -- a note\nSELECT o_orderstatus, COUNT(*) AS orders FROM step_one GROUP BY o_orderstatus")[-1]


# The medallion pipeline

_DIM_C = "SELECT c_custkey, UPPER(c_name) AS name, c_nationkey, c_mktsegment, c_acctbal FROM customer"
_FACT = "SELECT l.*, o.o_custkey AS custkey, o.o_orderdate AS orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"
_STEP_SQL = {
    "dim_customer": _DIM_C,
    "dim_supplier": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "fact_sales": _FACT,
    "segment_stats": "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 6) AS avg_balance, COUNT(*) AS customers FROM customer GROUP BY c_mktsegment",
    "customer_summary": f"SELECT custkey, COUNT(l_orderkey) AS total_lines, MAX(l_extendedprice) AS peak_price, SUM(l_quantity) AS quantity FROM ({_FACT}) GROUP BY custkey",
    "region_trends": "SELECT r_name, ROUND(AVG(c_acctbal), 6) AS avg_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "customer_risk": f"""SELECT c.name, s.total_lines, CASE WHEN s.total_lines >= 60 AND c.c_acctbal < 0 THEN 'HIGH' WHEN s.total_lines > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT custkey, COUNT(*) AS total_lines FROM ({_FACT}) GROUP BY custkey) s JOIN ({_DIM_C}) c ON s.custkey = c.c_custkey""",
    "total_exposure": """SELECT g.c_mktsegment, n.n_name, d.s_name, ROUND(g.avg_balance, 6) AS avg_balance, COALESCE(d.s_acctbal, 0) AS supplier_balance, ROUND(g.avg_balance + COALESCE(d.s_acctbal, 0), 6) AS exposure
FROM (SELECT c_mktsegment, AVG(c_acctbal) AS avg_balance FROM customer GROUP BY c_mktsegment) g JOIN nation n ON 1 = 1
LEFT JOIN supplier d ON d.s_suppkey = (SELECT MIN(x.s_suppkey) FROM supplier x WHERE x.s_nationkey = n.n_nationkey)""",
}


def _step(name: str, short: str) -> None:
    def run(spark, sf_dir):
        df = M.build(spark, sf_dir).table(name)
        return df.withColumns({c: F.round(c, 6) for c in df.columns if c in ("avg_balance", "exposure")})

    QUERIES[short] = run
    ORACLE[short] = _STEP_SQL[short]


for _name, _ in M.STEPS:
    _step(_name, _name.split(".")[1])

# Lineage.  The oracle's edges are written out by hand from the pipeline's text.

EDGES = [
    ("silver.dim_customer", "raw.customer"), ("silver.dim_supplier", "raw.supplier"), ("silver.fact_sales", "raw.lineitem"), ("silver.fact_sales", "raw.orders"),
    ("conformed.segment_stats", "silver.dim_customer"), ("conformed.customer_summary", "silver.fact_sales"),
    ("conformed.region_trends", "silver.dim_customer"), ("conformed.region_trends", "raw.nation"), ("conformed.region_trends", "raw.region"),
    ("conformed.customer_risk", "conformed.customer_summary"), ("conformed.customer_risk", "silver.dim_customer"),
    ("conformed.total_exposure", "conformed.segment_stats"), ("conformed.total_exposure", "raw.nation"), ("conformed.total_exposure", "silver.dim_supplier"),
]
FACTS = [
    ("conformed.segment_stats", "avg_balance", "AGGREGATED"), ("conformed.segment_stats", "customers", "AGGREGATED"),
    ("conformed.customer_summary", "total_lines", "AGGREGATED"), ("conformed.customer_summary", "peak_price", "AGGREGATED"), ("conformed.customer_summary", "quantity", "AGGREGATED"),
    ("conformed.region_trends", "avg_balance", "AGGREGATED"), ("conformed.customer_risk", "risk_level", "COMPUTED"),
    ("conformed.total_exposure", "supplier_balance", "AGGREGATED"), ("conformed.total_exposure", "exposure", "AGGREGATED"),
]
_EDGE_SQL = f"(VALUES {_values(EDGES)}) e(target_table, source_table)"
_WALK = f"walk(root, node, hops) AS (SELECT DISTINCT source_table, target_table, 1 FROM {_EDGE_SQL} UNION SELECT w.root, e.target_table, w.hops + 1 FROM walk w JOIN {_EDGE_SQL} ON e.source_table = w.node WHERE w.hops < 10)"


def _edges(spark: SparkSession) -> DataFrame:
    return X.as_frames(spark, *X.parse_script(M.SCRIPT, "pipeline.sql"))[0]


@query(f"SELECT * FROM {_EDGE_SQL}")
def lineage_edges(spark, sf_dir):
    return _edges(spark).select("target_table", "source_table")


@query(f"SELECT * FROM (VALUES {_values(FACTS)}) f(target_table, target_column, source_column)")
def lineage_columns(spark, sf_dir):
    return X.as_frames(spark, *X.parse_script(M.SCRIPT, "pipeline.sql"))[1].select("target_table", "target_column", "source_column")


@query(f"SELECT DISTINCT source_table AS table_name FROM {_EDGE_SQL} WHERE target_table = 'conformed.total_exposure'")
def upstream_tables(spark, sf_dir):
    return L.upstream(_edges(spark), "conformed.total_exposure")


@query(f"SELECT DISTINCT target_table AS table_name FROM {_EDGE_SQL} WHERE source_table = 'silver.dim_customer'")
def downstream_tables(spark, sf_dir):
    return L.downstream(_edges(spark), "silver.dim_customer")


@query(f"SELECT source_table AS table_name, list_sort(list(DISTINCT target_table)) AS downstream FROM {_EDGE_SQL} GROUP BY 1")
def downstream_summary(spark, sf_dir):
    return L.downstream_summary(_edges(spark))


_IMPACT = f"WITH RECURSIVE {_WALK} SELECT node AS table_name, MIN(hops)::INTEGER AS hops FROM walk WHERE root = 'raw.customer' GROUP BY node"


@query(_IMPACT)
def impact_hops(spark, sf_dir):
    return L.impact(_edges(spark), "raw.customer")


@query(_IMPACT)
def impact_hops_recursive(spark, sf_dir):
    _edges(spark).createOrReplaceTempView("lineage_edges")
    return spark.sql(L.impact_sql("raw.customer"))


@query(f"""WITH RECURSIVE {_WALK}, n AS (SELECT root AS table_name, COUNT(DISTINCT node)::INTEGER AS n_downstream FROM walk GROUP BY root),
t AS (SELECT DISTINCT unnest([target_table, source_table]) AS table_name FROM {_EDGE_SQL})
SELECT table_name, COALESCE(n_downstream, 0) AS n_downstream, CASE WHEN COALESCE(n_downstream, 0) = 0 THEN 'GREEN' WHEN n_downstream < 5 THEN 'YELLOW' ELSE 'RED' END AS risk FROM t LEFT JOIN n USING (table_name)""")
def impact_risk(spark, sf_dir):
    return L.impact_risk(_edges(spark))


@query(f"""WITH RECURSIVE p(node, path, depth) AS (SELECT 'conformed.customer_risk', 'conformed.customer_risk', 0 UNION ALL
SELECT e.source_table, p.path || ' <- ' || e.source_table, p.depth + 1 FROM p JOIN {_EDGE_SQL} ON e.target_table = p.node WHERE p.depth < 5) SELECT path, depth FROM p""")
def lineage_paths(spark, sf_dir):
    return L.paths(_edges(spark), "conformed.customer_risk")


#: Platform lineage as a platform lists it, and what should come of it.
PLATFORM = [("raw", "customer", "c_name", "silver", "dim_customer", "name"), ("raw", "customer", "c_name", "silver", "dim_customer", "name"), ("raw", None, None, "silver", "dim_customer", "tier"), ("raw", "nation", "n_name", "silver", "dim_customer", "name")]


def _platform(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLATFORM, "source_table_schema string, source_table_name string, source_column_name string, target_table_schema string, target_table_name string, target_column_name string")


@query("SELECT * FROM (VALUES ('silver.dim_customer', 'raw.customer'), ('silver.dim_customer', 'raw.nation')) p(target_table, source_table)")
def platform_tables(spark, sf_dir):
    return L.platform_table_lineage(_platform(spark), "silver.dim_customer")


@query("SELECT * FROM (VALUES ('silver.dim_customer', 'name', 'raw.customer', 'c_name'), ('silver.dim_customer', 'name', 'raw.nation', 'n_name')) p(target_table, target_column, source_table, source_column)")
def platform_columns(spark, sf_dir):
    return L.platform_column_lineage(_platform(spark), "silver.dim_customer", "name")


@query("SELECT * FROM (VALUES ('silver.dim_customer', 'raw.nation'), ('silver.dim_customer', 'raw.customer'), ('silver.dim_supplier', 'raw.supplier')) s(table_name, source)")
def sources_platform_first(spark, sf_dir):
    """The platform's sources where it has any, else those of the metadata."""
    edges, facts = X.as_frames(spark, *X.parse_script(M.SCRIPT, "pipeline.sql"))
    e = Engine(spark, tables(spark, sf_dir), edges, facts, platform=(_platform(spark), _platform(spark)))
    return spark.createDataFrame([(t, s) for t in ("silver.dim_customer", "silver.dim_supplier") for s in e.get_table_sources(t)["sources"]], "table_name string, source string")


CHAIN = [(f"s.t{i + 1}", f"s.t{i}") for i in range(15)]


@query("SELECT 's.t' || i AS table_name, i::INTEGER AS hops FROM range(1, 16) r(i)")
def impact_long_chain(spark, sf_dir):
    """Fifteen hops, by joins until nothing is new."""
    return L.impact(spark.createDataFrame(CHAIN, "target_table string, source_table string"), "s.t0", force_join=True)


# Assets and policies

NODES = [("raw", ["public"], "ops"), ("clean", ["PII", "core"], "ops"), ("mart", ["public", "core"], "bi"), ("report", ["PII"], "bi"), ("lonely", [], "bi")]
LINKS = [("raw", "clean"), ("clean", "mart"), ("mart", "report"), ("raw", "report"), ("report", "clean")]
POLICIES = [("p-pii", ["PII"], []), ("p-core-mart", ["core"], ["mart"]), ("p-all", [], []), ("p-listed-only", [], ["raw"])]
_NODE_SQL = f"(VALUES {_values([(i, t or ['-'], o) for i, t, o in NODES])}) n(id, tags, owner)"
_POLICY_SQL = "(VALUES ('p-pii', ['PII'], [NULL]), ('p-core-mart', ['core'], ['mart']), ('p-all', ['*'], [NULL]), ('p-listed-only', ['!'], ['raw'])) p(policy_id, tags, applies_to)"


def _graph(spark: SparkSession) -> A.AssetGraph:
    g = A.AssetGraph(spark)
    g.load({"nodes": [{"id": i, "tags": t, "owner": o} for i, t, o in NODES], "edges": [{"source": a, "target": b} for a, b in LINKS]})
    return g


@query(f"""WITH RECURSIVE w(id, hops) AS (SELECT 'raw', 0 UNION SELECT l.b, w.hops + 1 FROM w JOIN (VALUES {_values(LINKS)}) l(a, b) ON l.a = w.id WHERE w.hops < 6)
SELECT w.id, MIN(hops)::INTEGER AS hops FROM w JOIN {_NODE_SQL} ON n.id = w.id WHERE w.id <> 'raw' AND list_has_any(n.tags, ['PII']) AND n.owner = 'bi' GROUP BY w.id""")
def asset_impact_tagged(spark, sf_dir):
    return _graph(spark).impacted("raw", {"tags": ["PII"], "owner": "bi"}).select("id", "hops")


@query(f"SELECT n.id, p.policy_id FROM {_NODE_SQL}, {_POLICY_SQL} WHERE p.tags = ['*'] OR (list_has_any(n.tags, p.tags) AND (p.applies_to[1] IS NULL OR list_contains(p.applies_to, n.id)))")
def policy_match(spark, sf_dir):
    nodes = _graph(spark).node_frame()
    return A.policy_matches(nodes, spark.createDataFrame([(i, t, a, {}) for i, t, a in POLICIES], A.POLICY_SCHEMA))


# Drift

BEFORE = [("raw.customer", "id", "INTEGER"), ("raw.customer", "name", "VARCHAR"), ("raw.customer", "zip", "INTEGER"), ("raw.orders", "total", "FLOAT"), ("raw.orders", "note", "VARCHAR"), ("raw.old", "x", "INTEGER")]
AFTER = [("raw.customer", "id", "BIGINT"), ("raw.customer", "name", "varchar"), ("raw.customer", "zip", "VARCHAR"), ("raw.customer", "phone", "VARCHAR"), ("raw.orders", "total", "DOUBLE"), ("raw.new", "y", "DATE")]
_DRIFT = f"""c AS (SELECT COALESCE(a.t, b.t) AS table_name, COALESCE(a.c, b.c) AS column_name, a.k AS old_type, b.k AS new_type,
CASE WHEN a.t IS NULL THEN 'added' WHEN b.t IS NULL THEN 'removed' ELSE 'type_changed' END AS change_type
FROM (VALUES {_values(BEFORE)}) a(t, c, k) FULL JOIN (VALUES {_values(AFTER)}) b(t, c, k) ON a.t = b.t AND a.c = b.c WHERE a.t IS NULL OR b.t IS NULL OR UPPER(a.k) <> UPPER(b.k)),
r AS (SELECT *, CASE change_type WHEN 'added' THEN 'GREEN' WHEN 'removed' THEN 'RED' ELSE CASE WHEN (old_type, new_type) IN (('INTEGER', 'BIGINT'), ('FLOAT', 'DOUBLE')) THEN 'YELLOW' ELSE 'RED' END END AS risk FROM c)"""


#: The widenings that count as safe, written out from the reference values, and some that do not.
WIDENINGS = [
    ("INTEGER", "BIGINT"), ("INT", "BIGINT"), ("FLOAT", "DOUBLE"), ("REAL", "DOUBLE"), ("SMALLINT", "INTEGER"), ("SMALLINT", "INT"), ("SMALLINT", "BIGINT"),
    ("TINYINT", "SMALLINT"), ("TINYINT", "INTEGER"), ("TINYINT", "INT"), ("TINYINT", "BIGINT"), ("VARCHAR", "TEXT"), ("STRING", "TEXT"),
]
NOT_SAFE = [("BIGINT", "INTEGER"), ("VARCHAR", "STRING"), ("INTEGER", "DOUBLE"), ("DOUBLE", "FLOAT"), ("TEXT", "VARCHAR"), ("TINYINT", "DOUBLE"), ("DATE", "VARCHAR")]
_PAIRS = [(o, n, "YELLOW") for o, n in WIDENINGS] + [(o, n, "RED") for o, n in NOT_SAFE]


@query(f"SELECT * FROM (VALUES {_values(_PAIRS)}) p(old_type, new_type, risk)")
def drift_widenings(spark, sf_dir):
    before, after = (spark.createDataFrame([("t", f"c{i}", pair[side]) for i, pair in enumerate(_PAIRS)], D.LONG) for side in (0, 1))
    return D.compare(before, after).select("old_type", "new_type", "risk")


def _changes(spark: SparkSession) -> DataFrame:
    return D.compare(spark.createDataFrame(BEFORE, D.LONG), spark.createDataFrame(AFTER, D.LONG))


@query(f"WITH {_DRIFT} SELECT table_name, column_name, change_type, old_type, new_type, risk FROM r")
def drift_changes(spark, sf_dir):
    return _changes(spark)


@query(f"WITH {_DRIFT} SELECT risk, COUNT(*) AS changes FROM r GROUP BY risk")
def drift_risk_summary(spark, sf_dir):
    return D.risk_summary(_changes(spark))


@query(f"""WITH {_DRIFT}, d AS (SELECT source_table, list_sort(list(DISTINCT target_table)) AS down FROM {_EDGE_SQL} GROUP BY 1)
SELECT table_name, column_name, CASE WHEN risk = 'RED' THEN 'RED' WHEN (change_type = 'added' AND len(down) > 0) OR len(down) > 3 THEN 'YELLOW' ELSE risk END AS risk, COALESCE(len(down), 0)::INTEGER AS n_downstream
FROM r LEFT JOIN d ON d.source_table = r.table_name""")
def drift_enriched(spark, sf_dir):
    return D.enrich(_changes(spark), _edges(spark)).select("table_name", "column_name", "risk", F.size("downstream_tables").alias("n_downstream"))


@query(f"WITH {_DRIFT} SELECT COUNT(*) FILTER (WHERE risk = 'RED') AS red, COUNT(*) FILTER (WHERE risk = 'YELLOW') AS yellow, COUNT(*) FILTER (WHERE risk = 'GREEN') AS green, COUNT(*) AS total FROM r")
def drift_snapshots(spark, sf_dir):
    """A snapshot written and read again, compared with the later columns by the monitor."""
    import tempfile

    listed = lambda rows: {t: [{"column_name": c, "column_type": k} for x, c, k in rows if x == t] for t, _, _ in rows}
    with tempfile.TemporaryDirectory() as folder:  # of the driver alone
        monitor = D.DriftMonitor(tables(spark, sf_dir), folder)
        monitor.snapshot(listed(BEFORE))
        before = monitor.latest()["tables"]
    rows = [r.asDict() for r in D.compare(D.long_form(spark, before), D.long_form(spark, listed(AFTER))).collect()]
    found = D.report(rows)
    return spark.createDataFrame([(found["red"], found["yellow"], found["green"], found["total_changes"])], "red long, yellow long, green long, total long")


# Review: files with one fault each; the oracle is the list of faults that each should show.

FAULTY = {
    "schema.sql": "CREATE TABLE silver.a AS SELECT x FROM slver.b;",
    "typo.sql": "CREATE TABLE silver.a AS SELCT x FROM raw.b;",
    "paren.sql": "CREATE TABLE silver.a AS SELECT (x FROM raw.b;",
    "quote.sql": "CREATE TABLE silver.a AS SELECT x FROM raw.b WHERE y = 'open",
    "from.sql": "SELECT b.x;",
    "agg.sql": "CREATE TABLE silver.a AS SELECT k, SUM(x) AS s FROM raw.b;",
    "comma.sql": "CREATE TABLE silver.a AS SELECT x,\nFROM raw.b;",
    "alias.sql": "CREATE TABLE silver.a AS SELECT x AS k, y AS k FROM raw.b;",
    "group.sql": "CREATE TABLE silver.a AS SELECT k, m, COUNT(*) AS n FROM raw.b GROUP BY k;",
    "mislead.sql": "CREATE TABLE silver.a AS SELECT k, SUM(x) AS avg_x FROM raw.b GROUP BY k;",
    "clean.sql": "-- it's (fine\nCREATE TABLE silver.a AS SELECT k, COUNT(*) AS n FROM raw.b GROUP BY k;",
}
FINDINGS = [("schema.sql", "unknown_schema"), ("typo.sql", "keyword_typo"), ("paren.sql", "parentheses"), ("quote.sql", "quotes"), ("from.sql", "missing_from"), ("agg.sql", "agg_without_group_by"), ("comma.sql", "trailing_comma"), ("alias.sql", "duplicate_alias"), ("group.sql", "not_grouped"), ("mislead.sql", "misleading_alias")]


@query(f"SELECT * FROM (VALUES {_values(FINDINGS)}) f(file, rule)")
def review_syntax_findings(spark, sf_dir):
    return R.findings_frame(spark, FAULTY).select("file", "rule")


OLD_SQL = "CREATE TABLE silver.a AS SELECT k, AVG(x) AS m FROM raw.b GROUP BY k;\nCREATE TABLE silver.c AS SELECT x FROM raw.b;\nCREATE TABLE silver.d AS SELECT x FROM raw.b;\nCREATE TABLE silver.same AS SELECT 1 AS one;"
NEW_SQL = "CREATE TABLE silver.a AS SELECT k, SUM(x) AS m FROM raw.b GROUP BY k;\nCREATE TABLE silver.c AS SELECT x FROM raw.b JOIN raw.e ON b.i = e.i WHERE x > 1;\nCREATE TABLE silver.f AS SELECT x FROM raw.b;\nCREATE TABLE silver.same AS SELECT 1 AS one;"
CHANGES = [("silver.a", "AVG() changed to SUM()"), ("silver.c", "Added WHERE x > 1; Added 1 JOIN(s)"), ("silver.d", "TABLE REMOVED"), ("silver.f", "NEW TABLE added")]


@query(f"SELECT * FROM (VALUES {_values(CHANGES)}) c(table_name, change)")
def review_block_changes(spark, sf_dir):
    return spark.createDataFrame(list(R.describe_changes(OLD_SQL, NEW_SQL).items()), "table_name string, change string")


#: Changes with the blockers and the business severity that each should show.
CASES = [
    ("cross join", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT x FROM raw.b CROSS JOIN raw.c;", [("HIGH", "volume_anomaly")], "MEDIUM"),
    ("always true", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT x FROM raw.b JOIN raw.c ON 1 = 1;", [("HIGH", "volume_anomaly")], "MEDIUM"),
    ("filter removed", "CREATE TABLE silver.a AS SELECT x FROM raw.b WHERE x > 1;", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", [("MEDIUM", "volume_anomaly")], "MEDIUM"),
    ("equals null", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT x FROM raw.b WHERE x = NULL;", [("LOW", "volume_anomaly")], "MEDIUM"),
    ("syntax", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT (x FROM raw.b;", [("HIGH", "syntax_error")], "LOW"),
    ("aggregated", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT x, COUNT(*) AS n FROM raw.b GROUP BY x;", [], "HIGH"),
    ("same", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", "CREATE TABLE silver.a AS SELECT x FROM raw.b;", [], "LOW"),
]


@query(f"SELECT * FROM (VALUES {_values([(c, s, k) for c, _, _, blockers, _ in CASES for s, k in blockers])}) b(change, severity, blocker_type)")
def review_blockers(spark, sf_dir):
    rows = [(c, b["severity"], b["blocker_type"]) for c, old, new, _, _ in CASES for b in R.validate_technical(old, new)["blockers"]]
    return spark.createDataFrame(rows, "change string, severity string, blocker_type string")


@query(f"SELECT * FROM (VALUES {_values([(c, s) for c, _, _, _, s in CASES])}) b(change, severity)")
def review_business(spark, sf_dir):
    return spark.createDataFrame([(c, R.validate_business(old, new)["severity"]) for c, old, new, _, _ in CASES], "change string, severity string")


DELTAS = [("silver.a", "SELECT x, y FROM raw.b", "SELECT x, z FROM raw.b", ["silver.a", "silver.a.y", "silver.a.z"], False), ("silver.b", "SELECT x FROM raw.b", "SELECT x FROM raw.b JOIN raw.c ON b.i = c.i", ["silver.b"], True), ("silver.c", "SELECT x FROM raw.b", "SELECT x FROM raw.b -- note", [], False)]


@query(f"SELECT * FROM (VALUES {_values([(t, e, str(j).lower()) for t, _, _, elements, j in DELTAS for e in elements])}) d(table_name, element, integrity)")
def review_deltas(spark, sf_dir):
    rows = []
    for t, old, new, _, _ in DELTAS:
        found = R.semantic_delta(f"CREATE TABLE {t} AS\n{old}\n;", f"CREATE TABLE {t} AS\n{new}\n;")
        rows += [(t, e, str(found["has_integrity_impact"]).lower()) for e in found["changed_elements"]]
    return spark.createDataFrame(rows, "table_name string, element string, integrity string")


REVIEWED = {
    "fact.sql": ("CREATE TABLE silver.fact_sales AS SELECT l_orderkey FROM raw.lineitem;", "CREATE TABLE silver.fact_sales AS SELECT l_orderkey FROM raw.lineitem WHERE l_tax > 0;"),
    "same.sql": ("CREATE TABLE silver.kept AS SELECT 1 AS one;", "CREATE TABLE silver.kept AS SELECT 1 AS one;"),
}


@query(f"""WITH RECURSIVE {_WALK} SELECT 'silver.fact_sales' AS table_name, node AS downstream, MIN(hops)::INTEGER AS hops, 'YELLOW' AS risk FROM walk WHERE root = 'silver.fact_sales' GROUP BY node""")
def review_chains(spark, sf_dir):
    """What a review finds downstream of a changed table, and its risk."""
    edges = _edges(spark)
    found = R.review(REVIEWED, lambda changed: L.chains_from(edges, changed))
    return spark.createDataFrame([(t, d, n, found.risk_level) for t, chain in found.impact_chains.items() for d, n in chain], "table_name string, downstream string, hops int, risk string")


NOISE = [("", True), ("  -- note", True), ("/* a", True), ("* b", True), ("# c", True), ("SELECT 1", False), ("x -- y", False)]


@query(f"SELECT l AS line, n::BOOLEAN AS noise FROM (VALUES {_values([(a, str(b).lower()) for a, b in NOISE])}) v(l, n)")
def review_noise(spark, sf_dir):
    return spark.createDataFrame([(line, R.is_noise(line)) for line, _ in NOISE], "line string, noise boolean")


SUMMARIES = [("", "(none)"), ("CREATE TABLE a AS SELECT x FROM b", "no WHERE"), ("CREATE TABLE a AS SELECT x FROM b LEFT JOIN c ON b.i = c.i JOIN d ON d.i = b.i WHERE x > 1 GROUP BY x", "WHERE x > 1; 1 LEFT JOIN(s), 1 other JOIN(s); GROUP BY")]


@query(f"SELECT * FROM (VALUES {_values(SUMMARIES)}) s(block, summary)")
def review_old_summaries(spark, sf_dir):
    return spark.createDataFrame([(b, R.old_summary(b)) for b, _ in SUMMARIES], "block string, summary string")


EXTRACTED = [("JOIN", "raw.c", "b.i = c.i"), ("LEFT JOIN", "raw.d", "d.k = b.k AND d.v > 1"), ("CROSS JOIN", "raw.e", "")]


@query(f"SELECT * FROM (VALUES {_values([(*j, 'x > 1 AND y IS NULL', 'k, m') for j in EXTRACTED])}) j(type, table_name, condition, filter, grouped)")
def review_extracts(spark, sf_dir):
    from .plans import sqltext as S

    sql = "CREATE TABLE a AS SELECT k, m, COUNT(*) AS n FROM raw.b JOIN raw.c ON b.i = c.i LEFT JOIN raw.d ON d.k = b.k AND d.v > 1 CROSS JOIN raw.e WHERE x > 1 AND y IS NULL GROUP BY b.k, m"
    return spark.createDataFrame([(j["type"], j["table"], j["condition"], S.where_clause(sql), ", ".join(S.group_columns(sql))) for j in S.joins(sql)], "type string, table_name string, condition string, filter string, grouped string")


@query("SELECT * FROM (VALUES ('silve', 'silver'), ('rax', 'raw'), ('conformex', 'conformed'), ('warehouse', NULL)) c(name, closest)")
def review_closest_names(spark, sf_dir):
    known = ("raw", "silver", "conformed")
    return spark.createDataFrame([(n, R.closest(n, known)) for n in ("silve", "rax", "conformex", "warehouse")], "name string, closest string")


GRAIN_BLOCKS = {"x.company_stats": "CREATE TABLE x.company_stats AS SELECT company_name FROM y GROUP BY company_name", "x.per_employee": "CREATE TABLE x.per_employee AS SELECT emp_id FROM x.company_stats GROUP BY emp_id", "x.plain": "CREATE TABLE x.plain AS SELECT 1 AS one FROM x.company_stats"}


@query("SELECT 'x.company_stats' AS table_name, 'x.per_employee' AS downstream, 'company' AS grain, 'employee' AS downstream_grain")
def review_grain_mismatches(spark, sf_dir):
    found = R.grain_mismatches(GRAIN_BLOCKS, ["x.company_stats"], {"x.company_stats": [("x.per_employee", 1), ("x.plain", 1)]})
    return spark.createDataFrame([(g["table"], g["downstream"], g["grain"], g["downstream_grain"]) for g in found], "table_name string, downstream string, grain string, downstream_grain string")


ETL = [("CREATE TABLE a AS SELECT 1", True), ("INSERT INTO a VALUES (1)", True), ("SELECT 1 -- CREATE TABLE a", False), ("CREATE INDEX i ON a (x)", False), ("CREATE OR REPLACE VIEW v AS SELECT 1", True), ("SELECT 'INSERT INTO a'", False)]


@query(f"SELECT t AS sql_text, e::BOOLEAN AS etl FROM (VALUES {_values([(a, str(b).lower()) for a, b in ETL])}) v(t, e)")
def review_etl_kinds(spark, sf_dir):
    return spark.createDataFrame([(t, R.is_etl_sql(t)) for t, _ in ETL], "sql_text string, etl boolean")


GRAINS = [("x.company_stats", "GROUP BY company_name", "company"), ("x.other", "GROUP BY e.emp_id", "employee"), ("x.dept_list", "", "department"), ("x.t", "GROUP BY industry", "industry"), ("x.fact_jobs", "", "job"), ("x.none", "", None)]


@query(f"SELECT t AS table_name, g AS grain FROM (VALUES {_values(GRAINS)}) v(t, b, g)")
def review_grain(spark, sf_dir):
    return spark.createDataFrame([(t, R.infer_grain(f"CREATE TABLE {t} AS SELECT 1 FROM y {b}", t)[0]) for t, b, _ in GRAINS], "table_name string, grain string")


RISKS = [(0, 1, 0), (0, 2, 0), (0, 1, 4), (0, 1, 5), (1, 1, 0)]


@query(f"SELECT e::INTEGER AS errors, c::INTEGER AS changed, d::INTEGER AS downstream, CASE WHEN e > 0 OR d >= 5 THEN 'RED' WHEN d > 0 OR c >= 2 THEN 'YELLOW' ELSE 'GREEN' END AS risk FROM (VALUES {_values(RISKS)}) v(e, c, d)")
def review_risk(spark, sf_dir):
    return spark.createDataFrame([(*r, R.review_risk(*r)) for r in RISKS], "errors int, changed int, downstream int, risk string")


ORIGIN_SQL = "SELECT c.c_custkey, UPPER(c.c_name) AS name, s.total FROM customer c JOIN (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) s ON s.o_custkey = c.c_custkey"
ORIGINS = [("c_custkey", "PASSTHROUGH", "customer", "c_custkey"), ("name", "EXPRESSION", "customer", "c_name"), ("total", "AGGREGATED", "orders", "o_totalprice")]


@query(f"SELECT * FROM (VALUES {_values(ORIGINS)}) o(target_column, kind, source_table, source_column)")
def column_origins(spark, sf_dir):
    tables(spark, sf_dir).as_views()
    return catalyst.origins_frame(spark.sql(ORIGIN_SQL))


ERRORS = [("SELECT x FROM no_such_table", "TABLE_OR_VIEW_NOT_FOUND"), ("SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_orderstatus", "MISSING_AGGREGATION"), ("SELECT o_custkey, COUNT(*) FROM orders", "MISSING_GROUP_BY"), ("SELCT 1", "PARSE_SYNTAX_ERROR"), ("SELECT 1", None)]


@query(f"SELECT * FROM (VALUES {_values(ERRORS)}) e(sql_text, error_class)")
def analyzer_errors(spark, sf_dir):
    tables(spark, sf_dir).as_views()
    return spark.createDataFrame([(sql, catalyst.analysis_error(spark, sql)) for sql, _ in ERRORS], "sql_text string, error_class string")


CODE = """
clean = raw.select("id", F.col("amount"), "day")
priced = clean.withColumn("net", col("amount") * F.col("rate"))
kept = priced.filter(col("net") > 0)
"""
CODE_EDGES = [
    ("raw", "id", "clean", "id"), ("raw", "amount", "clean", "amount"), ("raw", "day", "clean", "day"),
    ("clean", "amount", "priced", "net"), ("clean", "rate", "priced", "net"), ("clean", "id", "priced", "id"), ("clean", "amount", "priced", "amount"), ("clean", "day", "priced", "day"),
    ("priced", "net", "kept", "net"), ("priced", "id", "kept", "id"), ("priced", "amount", "kept", "amount"), ("priced", "day", "kept", "day"),
]
_CODE_SQL = f"(VALUES {_values(CODE_EDGES)}) e(src_df, src_col, dst_df, dst_col)"


@query(f"SELECT * FROM {_CODE_SQL}")
def code_lineage_edges(spark, sf_dir):
    return C.edges_frame(spark, CODE)


@query(f"""WITH RECURSIVE up(dst, src) AS (SELECT dst_df || '.' || dst_col, src_df || '.' || src_col FROM {_CODE_SQL} UNION
SELECT u.dst, e.src_df || '.' || e.src_col FROM up u JOIN {_CODE_SQL} ON e.dst_df || '.' || e.dst_col = u.src) SELECT dst AS column_name, src AS upstream_column FROM up""")
def code_lineage_closure(spark, sf_dir):
    return C.closure(C.edges_frame(spark, CODE))


LONG_CODE = "a0 = raw.select('x')\n" + "\n".join(f"a{i + 1} = a{i}.select('x')" for i in range(15))


@query("SELECT 'a' || i || '.x' AS column_name, CASE WHEN j < 0 THEN 'raw.x' ELSE 'a' || j || '.x' END AS upstream_column FROM range(0, 16) r(i), range(-1, 15) s(j) WHERE j < i")
def code_lineage_long_chain(spark, sf_dir):
    return C.closure(C.edges_frame(spark, LONG_CODE))


UDF_CODE = "f = udf(lambda x: x, 'int')\n@pandas_udf('double')\ndef g(s):\n    return s\nh = len\n"


@query("SELECT * FROM (VALUES ('f'), ('g')) u(name)")
def code_udfs(spark, sf_dir):
    return spark.createDataFrame([(u["name"],) for u in C.parse_code(UDF_CODE)["udfs"]], "name string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table of the pipeline: its rows, what lies downstream of it, and how risky a change is."""
    catalog = M.build(spark, sf_dir)
    edges = _edges(spark)
    names = sorted({r for e in edges.select("target_table", "source_table").collect() for r in e})
    counts = catalog.row_counts([n for n in names if catalog.exists(n)])
    risk = L.impact_risk(edges, names).withColumn("bare", F.element_at(F.split("table_name", r"\."), -1))
    return risk.join(F.broadcast(counts.withColumnRenamed("table_name", "bare")), "bare", "left").select("table_name", "row_count", "n_downstream", "risk").orderBy("table_name")
