"""Queries of the operators made for large tables, with DuckDB SQL for the same rows; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .api import Engine
from .operators import distincts, footers, json_drift
from .operators import quality as Q
from .operators import reach
from .operators import temporal as T
from .operators.staging import new_path
from .plans import materialise
from .plans import medallion as M
from .queries import ORACLE, QUERIES, query, tables
from .streaming import sessions as stream_state

# As-of joins.  Rows of one key and time count as one on the right: the greatest of their tie columns.

_LAST_ORDERS = "(SELECT o_custkey, o_orderdate, MAX(o_orderkey) AS o_orderkey, ARG_MAX(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2)"


@query(f"SELECT e.event_id, e.user_id, e.ts, o.o_orderkey, o.o_orderdate, o.o_totalprice FROM events e ASOF LEFT JOIN {_LAST_ORDERS} o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def asof_events_orders(spark, sf_dir):
    """Each event with its user's last order."""
    c = tables(spark, sf_dir)
    events, orders = c.table("events").select("event_id", "user_id", "ts"), c.table("orders")
    return T.asof_join(events, orders, "ts", "o_orderdate", [("user_id", "o_custkey")], tie=["o_orderkey"], columns=["o_orderkey", "o_orderdate", "o_totalprice"])


_SHIPPED = "(SELECT o_custkey AS custkey, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT s.*, o.o_orderkey, o.o_orderdate FROM {_SHIPPED} s ASOF JOIN {_LAST_ORDERS} o ON s.custkey = o.o_custkey AND s.l_shipdate > o.o_orderdate")
def asof_shipments_orders(spark, sf_dir):
    """Each line with the last order that its customer made before it was shipped; lines without one go."""
    c = tables(spark, sf_dir)
    orders = c.table("orders")
    lines = c.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("custkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return T.asof_join(lines, orders, "l_shipdate", "o_orderdate", [("custkey", "o_custkey")], tie=["o_orderkey"], columns=["o_orderkey", "o_orderdate"], inclusive=False, how="inner")


@query("""SELECT e.event_id, e.user_id, CASE WHEN p.ts <= e.ts + INTERVAL 1 DAY THEN p.event_id END AS bought_event, CASE WHEN p.ts <= e.ts + INTERVAL 1 DAY THEN p.value END AS bought_value
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts < p.ts""")
def asof_next_purchase(spark, sf_dir):
    """Each error with the purchase that followed within a day."""
    events = tables(spark, sf_dir).table("events")
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("bought_event"), F.col("value").alias("bought_value"))
    day = 86_400_000_000
    return T.asof_join(errors, bought, "ts", "ts", [("user_id", "user_id")], columns=["bought_event", "bought_value"], direction="forward", inclusive=False, within=day).drop("ts")


# Intervals: an order is open from its date to its last shipment (orders shipped before their date never are).

_OPEN = "(SELECT o_orderkey, o_custkey, o_orderdate AS opened, closed FROM orders JOIN (SELECT l_orderkey, MAX(l_shipdate) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def _open_orders(c):
    closed = c.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    orders = c.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened"))
    return orders.join(closed, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "opened", "closed")


@query(f"""SELECT a.o_orderkey, a.o_custkey, a.opened, a.closed, b.o_orderkey AS other_order FROM {_OPEN} a JOIN {_OPEN} b ON a.o_custkey = b.o_custkey AND a.opened <= b.closed AND b.opened <= a.closed AND a.o_orderkey < b.o_orderkey
WHERE a.opened <= a.closed AND b.opened <= b.closed""")
def overlapping_orders(spark, sf_dir):
    """Pairs of orders of a customer that are open at the same time."""
    rows = _open_orders(tables(spark, sf_dir))
    other = rows.select(F.col("o_orderkey").alias("other_order"), F.col("o_custkey").alias("other_customer"), F.col("opened").alias("from"), F.col("closed").alias("to"))
    pairs = T.overlap_join(rows, other, ("opened", "closed"), ("from", "to"), by=[("o_custkey", "other_customer")])
    return pairs.filter("o_orderkey < other_order").select("o_orderkey", "o_custkey", "opened", "closed", "other_order")


@query(f"""SELECT w.week, COUNT(*) AS open_orders, MIN(o.o_orderkey) AS first_order FROM (SELECT DISTINCT date_trunc('week', o_orderdate) AS week FROM orders) w
JOIN {_OPEN} o ON o.opened < w.week + INTERVAL 7 DAY AND w.week < o.closed AND o.opened < o.closed GROUP BY w.week""")
def open_orders_by_week(spark, sf_dir):
    """How many orders are open in each week that has orders: half-open intervals without a key."""
    c = tables(spark, sf_dir)
    weeks = c.table("orders").select(F.date_trunc("week", "o_orderdate").cast("timestamp_ntz").alias("week")).distinct().withColumn("week_end", F.expr("week + INTERVAL 7 DAYS"))
    orders = _open_orders(c).select("o_orderkey", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("closed").cast("timestamp_ntz").alias("closed"))
    return T.overlap_join(weeks, orders, ("week", "week_end"), ("opened", "closed"), closed=False).groupBy("week").agg(F.count(F.lit(1)).alias("open_orders"), F.min("o_orderkey").alias("first_order"))


@query(f"SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_orderkey FROM {_SHIPPED} l JOIN {_OPEN} o ON l.custkey = o.o_custkey AND l.l_shipdate BETWEEN o.opened AND o.closed WHERE o.o_orderkey <> l.l_orderkey")
def shipments_in_open_orders(spark, sf_dir):
    """Lines shipped while another order of the customer was open: points in intervals."""
    c = tables(spark, sf_dir)
    orders = c.table("orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    lines = c.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("custkey", "l_orderkey", "l_linenumber", "l_shipdate")
    pairs = T.overlap_join(lines, _open_orders(c), ("l_shipdate", "l_shipdate"), ("opened", "closed"), by=[("custkey", "o_custkey")])
    return pairs.filter("o_orderkey <> l_orderkey").select("l_orderkey", "l_linenumber", "l_shipdate", "o_orderkey")


# Duplicates of wide rows: digests first.


@query("SELECT *, COUNT(*) AS duplicate_count FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount, l_quantity FROM lineitem) GROUP BY ALL HAVING COUNT(*) > 1")
def dup_wide_keys(spark, sf_dir):
    """Lines that agree in seven columns; seven are wide, so only digests and candidates move."""
    columns = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_quantity"]
    return Q.duplicate_groups(tables(spark, sf_dir).table("lineitem"), columns)


_LINE_COLUMNS = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    f"""WITH g AS (SELECT l_orderkey, l_linenumber, {", ".join(f"COUNT(DISTINCT {c}) + MAX(({c} IS NULL)::INTEGER) > 1 AS v_{c}" for c in _LINE_COLUMNS)} FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1) """
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE v_{c}) AS varying_groups, COUNT(*) AS groups FROM g" for c in _LINE_COLUMNS)
)
def dup_evidence(spark, sf_dir):
    """In what the lines of one order and number differ."""
    return Q.duplicate_evidence(tables(spark, sf_dir).table("lineitem"), ["l_orderkey", "l_linenumber"])


# Rules and types


_SAMPLED = ["o_totalprice >= 1000", "o_orderstatus <> 'P'", "o_custkey > 10", "o_totalprice >= 0"]


@query(" UNION ALL ".join(f"(SELECT '{r.replace(chr(39), chr(39) * 2)}' AS rule, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS place, orders.* FROM orders WHERE NOT ({r}) ORDER BY o_totalprice DESC, o_orderkey LIMIT 7)" for r in _SAMPLED))
def rule_samples(spark, sf_dir):
    """The seven dearest violations of each rule."""
    return Q.rule_samples(tables(spark, sf_dir).table("orders"), _SAMPLED, [F.desc("o_totalprice"), F.asc("o_orderkey")], 7)


_TEXTS = "(SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_orderkey::VARCHAR AS code, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 2 = 0)::VARCHAR END AS flag FROM orders)"


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{form}' AS form, COUNT(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS matching, COUNT({c}) AS row_count FROM {_TEXTS}" for c in ("o_orderpriority", "placed", "code", "flag") for form, pattern in Q.TEXT_FORMS.items())
    + ") WHERE matching > 0"
)
def text_forms(spark, sf_dir):
    """Text columns that hold dates, numbers or truth values, by their values."""
    orders = tables(spark, sf_dir).table("orders")
    flag = F.when(F.col("o_custkey") % 3 == 0, (F.col("o_custkey") % 2 == 0).cast("string"))
    return Q.text_forms(orders.select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("placed"), F.col("o_orderkey").cast("string").alias("code"), flag.alias("flag")))


# Ad-hoc queries that name tables with their schemas


def _ad_hoc(sql: str):
    """Through the guard, over the whole medallion catalog (raw, silver, conformed)."""
    return lambda spark, sf_dir: Engine(spark, M.build(spark, sf_dir)).query(sql)


def _qualified(name: str, sql: str, duck: str) -> None:
    QUERIES[name], ORACLE[name] = _ad_hoc(sql), duck


_qualified(
    "adhoc_qualified",
    "SELECT raw.customer.c_mktsegment, COUNT(*) AS lines, MAX(f.l_quantity) AS most FROM silver.fact_sales AS f JOIN raw.customer ON f.custkey = raw.customer.c_custkey GROUP BY raw.customer.c_mktsegment",
    "SELECT c_mktsegment, COUNT(*) AS lines, MAX(l_quantity) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
_qualified(
    "adhoc_qualified_cte",
    "WITH customer AS (SELECT c_custkey, name FROM silver.dim_customer WHERE c_acctbal < (SELECT AVG(c.c_acctbal) FROM raw.customer c)) SELECT customer.name, o.* FROM customer, raw.orders o WHERE o_custkey = c_custkey AND o_orderkey IN (SELECT l_orderkey FROM raw.lineitem WHERE l_quantity > 49)",
    "WITH c AS (SELECT c_custkey, UPPER(c_name) AS name FROM customer WHERE c_acctbal < (SELECT AVG(c_acctbal) FROM customer)) SELECT c.name, o.* FROM c, orders o WHERE o_custkey = c_custkey AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)",
)


# Footers

_LINE_ALL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_INTEGERS = _LINE_ALL[:4]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, {f'MIN({c})::VARCHAR' if c in _INTEGERS else 'NULL::VARCHAR'} AS min_value, {f'MAX({c})::VARCHAR' if c in _INTEGERS else 'NULL::VARCHAR'} AS max_value FROM lineitem" for c in _LINE_ALL))
def footer_profile(spark, sf_dir):
    """Rows, nulls and ranges of lineitem from the footers of its files."""
    return footers.footer_profile(spark, f"{sf_dir}/lineitem.parquet")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, ROUND(100 * (COUNT(*) - COUNT({c})) / COUNT(*), 2) AS null_pct, 'OK' AS status FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def footer_nulls(spark, sf_dir):
    """The null profile of documents without reading a text."""
    return footers.null_profile(spark, f"{sf_dir}/documents.parquet")


# Distinct counts that merge

_COUNTED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM lineitem" for c in _COUNTED))
def distinct_merged(spark, sf_dir):
    """Distinct values of ten columns of lineitem: two states, of returned and of other lines, merged."""
    line = tables(spark, sf_dir).table("lineitem")
    returned = F.col("l_returnflag") == "R"
    states = [distincts.distinct_state(line.filter(part), list(_COUNTED)) for part in (returned, ~returned)]
    return distincts.distinct_counts(states[0].unionByName(states[1]))


# Reach: from an order to the next one that has the same part of the same supplier.

_NEXT = """(SELECT DISTINCT a AS source, b AS target FROM (SELECT o_orderkey AS a, LEAD(o_orderkey) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY o_orderdate, o_orderkey) AS b
FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey) WHERE b IS NOT NULL)"""


@query(f"""WITH RECURSIVE e AS MATERIALIZED {_NEXT}, r(root, node) AS (SELECT source, target FROM e UNION SELECT r.root, e.target FROM r JOIN e ON e.source = r.node)
SELECT node, COALESCE(n, 0) AS reachable FROM (SELECT source AS node FROM e UNION SELECT target FROM e) LEFT JOIN (SELECT root, COUNT(*) AS n FROM r GROUP BY root) ON root = node""")
def reach_of_orders(spark, sf_dir):
    """How many later orders each order leads to by parts that come again from the same supplier."""
    c = tables(spark, sf_dir)
    bought = c.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().join(c.table("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    following = F.lead("o_orderkey").over(Window.partitionBy("l_partkey", "l_suppkey").orderBy("o_orderdate", "o_orderkey"))
    return reach.reach_counts(bought.select(F.col("o_orderkey").alias("source"), following.alias("target")))


# Steps as tables


@query("SELECT custkey, COUNT(*) AS total_lines, MAX(l_extendedprice) AS peak_price, SUM(l_quantity) AS quantity, ANY_VALUE(c_name) AS c_name FROM (SELECT l.*, o_custkey AS custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = custkey GROUP BY custkey")
def bucketed_customer_summary(spark, sf_dir):
    """fact_sales and customers in equal buckets of the customer: joined and summed without a shuffle."""
    c = M.build(spark, sf_dir)
    sales = materialise.write_bucketed(c.table("silver.fact_sales").select("custkey", "l_orderkey", "l_extendedprice", "l_quantity"), ["custkey"], 16)
    customers = materialise.write_bucketed(c.table("raw.customer").select("c_custkey", "c_name"), ["c_custkey"], 16)
    joined = sales.join(customers.hint("merge"), F.col("custkey") == F.col("c_custkey"))
    return joined.groupBy("custkey").agg(F.count(F.lit(1)).alias("total_lines"), F.max("l_extendedprice").alias("peak_price"), F.sum("l_quantity").alias("quantity"), F.min("c_name").alias("c_name"))


_SUMMARY_SQL = "(SELECT o_custkey AS custkey, COUNT(l_orderkey) AS total_lines, MAX(l_extendedprice) AS peak_price, SUM(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"
_SUMMARY_RULES = ["total_lines > 0", "peak_price >= 0", "quantity >= total_lines"]


@query(f"SELECT * FROM {_SUMMARY_SQL}")
def published_customer_summary(spark, sf_dir):
    """customer_summary as it was published after its audit."""
    path = new_path(spark, "summary")
    materialise.write_audited(M.build(spark, sf_dir).table("conformed.customer_summary"), path, _SUMMARY_RULES)
    return materialise.published(spark, path)


@query(
    f"SELECT 'rows' AS kind, NULL::VARCHAR AS name, COUNT(*) AS n FROM {_SUMMARY_SQL} UNION ALL "
    + " UNION ALL ".join(f"SELECT 'nulls', '{c}', COUNT(*) - COUNT({c}) FROM {_SUMMARY_SQL}" for c in ("custkey", "total_lines", "peak_price", "quantity"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT 'violations', '{r}', COUNT(*) FILTER (WHERE NOT ({r})) FROM {_SUMMARY_SQL}" for r in [*_SUMMARY_RULES, "total_lines < 40"])
)
def audit_of_customer_summary(spark, sf_dir):
    """What the one write job of customer_summary told; one rule is violated, so this version is not published."""
    report = materialise.write_audited(M.build(spark, sf_dir).table("conformed.customer_summary"), new_path(spark, "summary"), [*_SUMMARY_RULES, "total_lines < 40"])
    return materialise.audit_rows(spark, report)


# Drift inside JSON: props of events with fields that come, go and change with the day.

_PROPS = """(SELECT ts::DATE AS period, CASE WHEN day(ts) % 5 = 0 THEN '{"k": "' || (json_extract_string(props, '$.k')) || '", "t": "' || event_type || '"}'
WHEN day(ts) % 3 = 0 THEN '{"k": ' || (json_extract_string(props, '$.k')) || ', "v": {"w": [1.5, 2]}}' ELSE props END AS j FROM events)"""
_FLAT = f"""(SELECT period, key AS path, json_type(j, '$.' || key) AS t FROM (SELECT period, j, unnest(json_keys(j)) AS key FROM {_PROPS}))"""


@query(f"""WITH p AS (SELECT period, '$.' || path AS path, CASE WHEN MIN(t) = MAX(t) THEN CASE MIN(t) WHEN 'UBIGINT' THEN 'INTEGER' WHEN 'VARCHAR' THEN 'TEXT' ELSE MIN(t) END ELSE 'MIXED' END AS kind FROM {_FLAT} GROUP BY 1, 2
UNION ALL SELECT DISTINCT period, '$', 'OBJECT' FROM {_PROPS} UNION ALL SELECT DISTINCT period, '$.v.w', 'ARRAY' FROM {_PROPS} WHERE j LIKE '%"w"%' UNION ALL SELECT DISTINCT period, '$.v.w[]', 'NUMBER' FROM {_PROPS} WHERE j LIKE '%"w"%'),
d AS (SELECT period, LEAD(period) OVER (ORDER BY period) AS next FROM (SELECT DISTINCT period FROM p)),
b AS (SELECT d.next AS period, path, kind FROM p JOIN d USING (period) WHERE next IS NOT NULL), a AS (SELECT * FROM p WHERE period > (SELECT MIN(period) FROM p))
SELECT COALESCE(a.period, b.period) AS period, COALESCE(a.path, b.path) AS path, CASE WHEN b.kind IS NULL THEN 'ADDED' WHEN a.kind IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change, b.kind AS old_kind, a.kind AS new_kind
FROM a FULL JOIN b ON a.period = b.period AND a.path = b.path WHERE a.kind IS DISTINCT FROM b.kind""")
def props_drift(spark, sf_dir):
    """What changes in props from day to day."""
    events, day = tables(spark, sf_dir).table("events"), F.dayofmonth("ts")
    k = F.get_json_object("props", "$.k")
    made = F.when(day % 5 == 0, F.concat(F.lit('{"k": "'), k, F.lit('", "t": "'), "event_type", F.lit('"}'))).when(day % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit(', "v": {"w": [1.5, 2]}}'))).otherwise(F.col("props"))
    return json_drift.json_drift(events.select("ts", made.alias("j")), "j", F.to_date("ts"))


# State over a stream

_GAP, _DELAY = 30, 60  # minutes


@query(f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts > LAG(ts) OVER w + INTERVAL {_GAP} MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS number FROM e),
g AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL {_GAP} MINUTE AS session_end, COUNT(*) AS n_events FROM s GROUP BY user_id, number)
SELECT user_id, session_start::TIMESTAMPTZ AS session_start, session_end::TIMESTAMPTZ AS session_end, n_events FROM g WHERE session_end <= (SELECT MAX(ts) FROM events) - INTERVAL {_DELAY} MINUTE""")
def event_sessions(spark, sf_dir):
    """Closed sessions of all users, by a run over a stream in which each tenth event comes twice."""
    schema = tables(spark, sf_dir).table("events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = stream.unionByName(stream.filter("event_id % 10 = 0"))
    path = new_path(spark, "sessions")
    once = stream_state.without_repeats(twice, ["event_id"], "ts", f"{_DELAY} minutes")
    stream_state.write_sessions(stream_state.sessions(once, "user_id", "ts", f"{_GAP} minutes"), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n_events long").parquet(f"{path}/rows")
