import pytest

from veridra.api import Engine
from veridra.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def two(spark):
    c = Catalog.from_directory(spark, SF, ["customer", "nation", "orders"], "raw")
    c.register("other.customer", spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "c_custkey long, only_here string"))
    c.register("left.pair", spark.range(2))
    c.register("right.pair", spark.range(5))
    return Engine(spark, c)


def rows(engine, sql, params=None):
    found = engine.run_query(sql, params)
    assert "error" not in found, found
    return [tuple(r.values()) for r in found["rows"]]


def test_names_mean_their_own_tables(two):
    assert rows(two, "SELECT COUNT(*) FROM customer") == [(150,)]  # the default schema's
    assert rows(two, "SELECT COUNT(*) FROM raw.customer") == rows(two, "SELECT COUNT(*) FROM RAW . `Customer`") == [(150,)]
    assert rows(two, "SELECT COUNT(*) FROM other.customer") == [(3,)]
    assert rows(two, "SELECT a.only_here FROM other.customer a JOIN raw.customer b ON a.c_custkey = b.c_custkey ORDER BY 1") == [("x",), ("y",), ("z",)]
    assert rows(two, "SELECT COUNT(other.customer.only_here), MAX(raw.customer.c_custkey) FROM other.customer, raw.customer WHERE other.customer.c_custkey = raw.customer.c_custkey") == [(3, 3)]
    assert rows(two, "SELECT COUNT(*) FROM (SELECT raw.nation.* FROM raw.nation) x") == [(25,)]
    assert rows(two, "SELECT '\U0001f600 raw.nation' AS t FROM raw.nation WHERE n_nationkey = ? -- raw.nation", [3]) == [("\U0001f600 raw.nation",)]
    assert rows(two, "SELECT COUNT(*) FROM raw.customer TABLESAMPLE (100 PERCENT) AS c WHERE c.c_custkey >= 0") == [(150,)]


def test_names_of_a_with_hide_tables_where_it_holds(two):
    assert rows(two, "WITH customer AS (SELECT 1 AS x) SELECT COUNT(*) FROM customer") == [(1,)]
    assert rows(two, "WITH n AS (SELECT n_nationkey FROM raw.nation), m AS (SELECT * FROM n WHERE n_nationkey < 5) SELECT COUNT(*) FROM m") == [(5,)]
    assert rows(two, "SELECT (WITH nation AS (SELECT 7 AS k) SELECT MAX(k) FROM nation) AS a, (SELECT COUNT(*) FROM nation) AS b") == [(7, 25)]
    assert rows(two, "WITH RECURSIVE customer(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM customer WHERE n < 4) SELECT SUM(n) FROM customer") == [(10,)]
    assert rows(two, "SELECT COUNT(*) FROM raw.orders o WHERE EXISTS (SELECT 1 FROM other.customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey IN (SELECT n_nationkey FROM nation))")[0][0] > 0


@pytest.mark.parametrize(
    "sql, why",
    [
        ("SELECT * FROM pair", "Ambiguous table name"),
        ("SELECT * FROM raw.none", "Table not found"),
        ("SELECT * FROM text.`/etc/hostname`", "Table not found"),
        ("SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "Table not found"),
        ("SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "Not allowed"),
        ("SELECT java_method('java.lang.System', 'getProperty', 'user.name')", "java_method"),
        ("SELECT 1 WHERE EXISTS (SELECT `reflect`('java.lang.System', 'getProperty', 'user.name'))", "reflect"),
        ("SELECT 1 --x\r, try_reflect('java.lang.System', 'getProperty', 'user.name')", "try_reflect"),
        ("SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name')", "Not allowed"),
        ("SELECT TRANSFORM (n_name) USING 'cat' AS (x STRING) FROM raw.nation", "Not allowed"),
        ("WITH t AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM t", "Table not found"),
    ],
)
def test_the_guard_refuses(two, sql, why):
    assert why in two.run_query(sql).get("error", "ran"), sql


def test_session_tables_outside_the_registry_are_not_read(spark, two):
    spark.range(3).createOrReplaceTempView("private_view")
    assert "Table not found" in two.run_query("SELECT * FROM private_view")["error"]
    spark.catalog.dropTempView("private_view")


def test_only_named_tables_are_opened(spark):
    opened = []
    c = Catalog(spark, "raw")
    for name in ("a", "b"):
        c.register(f"raw.{name}", lambda name=name: opened.append(name) or spark.range(1))
    assert Engine(spark, c).run_query("SELECT * FROM a")["row_count"] == 1 and opened == ["a"]
