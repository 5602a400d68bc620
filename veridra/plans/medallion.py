"""A medallion pipeline over the sales tables: raw -> silver -> conformed, declared as named steps.

Each step is a DataFrame function of the registry; ``SCRIPT`` is the same pipeline as SQL text, from which
lineage is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import sqltext as S

SCRIPT = """
CREATE SCHEMA IF NOT EXISTS silver;
CREATE SCHEMA IF NOT EXISTS conformed;

CREATE OR REPLACE TABLE silver.dim_customer AS
SELECT c_custkey, UPPER(c_name) AS name, c_nationkey, c_mktsegment, c_acctbal FROM raw.customer;

CREATE OR REPLACE TABLE silver.dim_supplier AS
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM raw.supplier;

-- every order line with its order
CREATE OR REPLACE TABLE silver.fact_sales AS
SELECT l.*, o.o_custkey AS custkey, o.o_orderdate AS orderdate FROM raw.lineitem l JOIN raw.orders o ON l.l_orderkey = o.o_orderkey;

CREATE OR REPLACE TABLE conformed.segment_stats AS
SELECT c_mktsegment, AVG(c_acctbal) AS avg_balance, COUNT(*) AS customers FROM silver.dim_customer GROUP BY c_mktsegment;

CREATE OR REPLACE TABLE conformed.customer_summary AS
SELECT custkey, COUNT(l_orderkey) AS total_lines, MAX(l_extendedprice) AS peak_price, SUM(l_quantity) AS quantity FROM silver.fact_sales GROUP BY custkey;

CREATE OR REPLACE TABLE conformed.region_trends AS
SELECT r.r_name, AVG(c.c_acctbal) AS avg_balance FROM silver.dim_customer c
JOIN raw.nation n ON c.c_nationkey = n.n_nationkey JOIN raw.region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name;

CREATE OR REPLACE TABLE conformed.customer_risk AS
SELECT c.name, s.total_lines,
  CASE WHEN s.total_lines >= 60 AND c.c_acctbal < 0 THEN 'HIGH' WHEN s.total_lines > 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM conformed.customer_summary s JOIN silver.dim_customer c ON s.custkey = c.c_custkey;

CREATE OR REPLACE TABLE conformed.total_exposure AS
SELECT g.c_mktsegment, n.n_name, d.s_name, g.avg_balance, COALESCE(d.s_acctbal, 0) AS supplier_balance, g.avg_balance + COALESCE(d.s_acctbal, 0) AS exposure
FROM conformed.segment_stats g JOIN raw.nation n ON 1=1
LEFT JOIN silver.dim_supplier d ON d.s_suppkey = (SELECT MIN(x.s_suppkey) FROM silver.dim_supplier x WHERE x.s_nationkey = n.n_nationkey LIMIT 1);
"""


def dim_customer(c: Catalog) -> DataFrame:
    return c.table("raw.customer").select("c_custkey", F.upper("c_name").alias("name"), "c_nationkey", "c_mktsegment", "c_acctbal")


def dim_supplier(c: Catalog) -> DataFrame:
    return c.table("raw.supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


def fact_sales(c: Catalog) -> DataFrame:
    orders = c.table("raw.orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("orderdate"))
    line = c.table("raw.lineitem").alias("l")
    return line.join(orders, F.col("l.l_orderkey") == F.col("o_orderkey")).select("l.*", "custkey", "orderdate")


def segment_stats(c: Catalog) -> DataFrame:
    return c.table("silver.dim_customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("avg_balance"), F.count(F.lit(1)).alias("customers"))


def customer_summary(c: Catalog) -> DataFrame:
    return c.table("silver.fact_sales").groupBy("custkey").agg(F.count("l_orderkey").alias("total_lines"), F.max("l_extendedprice").alias("peak_price"), F.sum("l_quantity").alias("quantity"))


def region_trends(c: Catalog) -> DataFrame:
    nation, region = c.table("raw.nation"), c.table("raw.region")
    return c.table("silver.dim_customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.avg("c_acctbal").alias("avg_balance"))


def customer_risk(c: Catalog) -> DataFrame:
    risk = F.when((F.col("total_lines") >= 60) & (F.col("c_acctbal") < 0), "HIGH").when(F.col("total_lines") > 40, "MEDIUM").otherwise("LOW")
    return c.table("conformed.customer_summary").join(c.table("silver.dim_customer"), F.col("custkey") == F.col("c_custkey")).select("name", "total_lines", risk.alias("risk_level"))


def total_exposure(c: Catalog) -> DataFrame:
    """Every segment with every nation (the pipeline asks for their product; both are bounded dimensions), and the
    nation's first supplier.  Spark takes no correlated subquery in a join condition, so that supplier is found
    by an aggregate first."""
    supplier = c.table("silver.dim_supplier")
    first = supplier.groupBy("s_nationkey").agg(F.min_by(F.struct("s_name", "s_acctbal"), "s_suppkey").alias("d"))
    pairs = c.table("conformed.segment_stats").crossJoin(c.table("raw.nation"))
    balance = F.coalesce("d.s_acctbal", F.lit(0.0))
    return pairs.join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("c_mktsegment", "n_name", F.col("d.s_name").alias("s_name"), "avg_balance", balance.alias("supplier_balance"), (F.col("avg_balance") + balance).alias("exposure"))


STEPS = [
    ("silver.dim_customer", dim_customer), ("silver.dim_supplier", dim_supplier), ("silver.fact_sales", fact_sales),
    ("conformed.segment_stats", segment_stats), ("conformed.customer_summary", customer_summary), ("conformed.region_trends", region_trends),
    ("conformed.customer_risk", customer_risk), ("conformed.total_exposure", total_exposure),
]
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(spark: SparkSession, folder: str) -> Catalog:
    """Raw tables of a folder and all steps, each lazy; Catalyst sees a step's inputs through to the scan."""
    catalog = Catalog.from_directory(spark, folder, RAW, "raw")
    for name, step in STEPS:
        catalog.register(name, lambda step=step: step(catalog))
    return catalog


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in place."""
    return spark.createDataFrame(rows, schema)


def run_script(spark: SparkSession, sql: str) -> list[DataFrame]:
    """Runs each statement; CREATE SCHEMA makes a database, CREATE OR REPLACE TABLE t AS writes a table over it."""
    out = []
    for statement in S.statements(S.without_comments(sql)):
        toks = S.tokens(statement)
        made = S.created(toks)
        words = [t.word for t in toks[:3]]
        if made and words == ["CREATE", "OR", "REPLACE"] and toks[3].word == "TABLE" and made[1] < len(toks) and toks[made[1]].word == "AS":
            df = spark.sql(statement[toks[made[1] + 1].start :])
            df.write.mode("overwrite").saveAsTable(made[0])
            out.append(df)
        else:
            out.append(spark.sql(statement))
    return out
