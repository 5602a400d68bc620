"""Questions to the lineage tables: neighbours, impact by hops, trees, paths, explanations.

Edges are a DataFrame of (target_table, source_table).  Graphs of code are small: up to ``DRIVER_EDGES`` edges
they are collected (a checked bound) and walked on the driver, which takes milliseconds; beyond, the
frontier is joined with the edges hop by hop, each hop written to the checkpoint folder.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import check_identifier

DRIVER_EDGES = 200_000
HOPS_SCHEMA = "table_name string, hops int"


def upstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.filter(F.col("target_table") == check_identifier(table)).select(F.col("source_table").alias("table_name")).distinct().orderBy("table_name")


def downstream(edges: DataFrame, table: str) -> DataFrame:
    return edges.filter(F.col("source_table") == check_identifier(table)).select(F.col("target_table").alias("table_name")).distinct().orderBy("table_name")


def downstream_summary(edges: DataFrame) -> DataFrame:
    """Of each table with any: its direct downstream tables, sorted."""
    return edges.groupBy(F.col("source_table").alias("table_name")).agg(F.sort_array(F.collect_set("target_table")).alias("downstream"))


def adjacency(edges: DataFrame, by: str = "source_table", to: str = "target_table") -> dict[str, list[str]] | None:
    """The neighbours of each node, or None if there are too many edges for the driver."""
    rows = edges.select(by, to).distinct().limit(DRIVER_EDGES + 1).collect()
    if len(rows) > DRIVER_EDGES:
        return None
    found: dict[str, list[str]] = {}
    for a, b in sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None):
        found.setdefault(a, []).append(b)
    return found


def hops_from(graph: dict[str, list[str]], start: str) -> list[tuple[str, int]]:
    """Every node that can be reached, with the least number of hops, nearest first; not the start itself."""
    seen, queue = {start: 0}, deque([start])
    while queue:
        here = queue.popleft()
        for there in graph.get(here, ()):
            if there not in seen:
                seen[there] = seen[here] + 1
                queue.append(there)
    return [(node, n) for node, n in seen.items() if node != start]


def _cut(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and reread; a temporary one only where none is set on a single machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="veridra-"))
    return df.checkpoint()


def hops_by_join(edges: DataFrame, starts: list[str] | DataFrame) -> DataFrame:
    """root, table_name, hops of all that is downstream of each start, by joins until nothing is new."""
    spark = edges.sparkSession
    pairs = edges.select("source_table", "target_table").distinct()
    roots = starts if isinstance(starts, DataFrame) else spark.createDataFrame([(s,) for s in starts], "root string")
    seen = frontier = roots.select("root", F.col("root").alias("table_name"), F.lit(0).alias("hops"))
    hop = 0
    while True:
        hop += 1
        frontier = _cut(
            pairs.join(frontier, pairs["source_table"] == frontier["table_name"]).select("root", F.col("target_table").alias("table_name")).distinct()
            .join(seen, ["root", "table_name"], "left_anti").select("root", "table_name", F.lit(hop).alias("hops"))
        )
        if frontier.isEmpty():
            return seen.filter("hops > 0")
        seen = seen.unionByName(frontier)


def chains_from(edges: DataFrame | None, starts: list[str]) -> dict[str, list[tuple[str, int]]]:
    """What is downstream of each start that has anything downstream, nearest first, in graphs of any size."""
    if edges is None or not starts:
        return {}
    graph = adjacency(edges)
    if graph is not None:
        return {t: hops_from(graph, t) for t in starts if t in graph}
    found: dict[str, list[tuple[str, int]]] = {}
    for r in hops_by_join(edges, starts).orderBy("root", "hops", "table_name").collect():
        found.setdefault(r["root"], []).append((r["table_name"], r["hops"]))
    return found


def impact(edges: DataFrame, table: str, force_join: bool = False) -> DataFrame:
    """table_name, hops of everything downstream of a table; cycles end."""
    check_identifier(table)
    graph = None if force_join else adjacency(edges)
    if graph is None:
        return hops_by_join(edges, [table]).select("table_name", "hops")
    return edges.sparkSession.createDataFrame(hops_from(graph, table), HOPS_SCHEMA)


def impact_sql(start: str, most: int = 10) -> str:
    """The same as one recursive query over a view ``lineage_edges``, for graphs of at most that many hops."""
    return f"""
with recursive walk(table_name, hops) as (
  select '{check_identifier(start)}', 0
  union all
  select e.target_table, w.hops + 1 from walk w join lineage_edges e on e.source_table = w.table_name where w.hops < {most}
)
select table_name, min(hops) as hops from walk where table_name <> '{start}' group by table_name"""


def risk_of(n: int) -> tuple[str, str]:
    """Fixed thresholds: GREEN 0, YELLOW 1 to 4 (1 is minor), RED from 5."""
    if n == 0:
        return "GREEN", "no downstream impact"
    if n == 1:
        return "YELLOW", "minor downstream impact"
    return ("YELLOW", "moderate downstream impact") if n < 5 else ("RED", "high downstream impact")


def impact_risk(edges: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """table_name, n_downstream, risk of each table (all nodes by default)."""
    graph = adjacency(edges)
    if graph is None:
        # All tables at once: the pairs of a table and what it reaches are counted where they are.
        nodes = edges.sparkSession.createDataFrame([(t,) for t in tables], "root string") if tables else edges.select(F.explode(F.array("source_table", "target_table")).alias("root")).distinct()
        counts = hops_by_join(edges, nodes).groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("n"))
        n = F.coalesce("n", F.lit(0))
        return nodes.join(counts, "root", "left").select(F.col("root").alias("table_name"), n.alias("n_downstream"), F.when(n == 0, "GREEN").when(n < 5, "YELLOW").otherwise("RED").alias("risk"))
    else:
        nodes = tables or sorted({*graph, *(x for v in graph.values() for x in v)})
        counted = [(t, len(hops_from(graph, t))) for t in nodes]
    return edges.sparkSession.createDataFrame([(t, n, risk_of(n)[0]) for t, n in counted], "table_name string, n_downstream int, risk string")


def lineage_tree(edges: DataFrame, table: str, max_depth: int = 5) -> dict:
    """Upstream as nested dicts: a source is {_is_source: True}, what lies at the depth's end {_truncated: True}
    (also a source there); cycles end by the depth."""
    graph = adjacency(edges, "target_table", "source_table")
    if graph is None:  # only the part of the graph that the tree shows
        up = edges.select(F.col("target_table").alias("source_table"), F.col("source_table").alias("target_table"))
        near = hops_by_join_up_to(up, table, max_depth)
        graph = {}
        rows = up.join(near, up["source_table"] == near["table_name"]).select("source_table", "target_table").distinct().collect()
        for a, b in sorted((r[0], r[1]) for r in rows if r[1] is not None):
            graph.setdefault(a, []).append(b)

    def below(node: str, depth: int) -> dict:
        if depth >= max_depth:
            return {"_truncated": True}
        parents = graph.get(node)
        return {p: below(p, depth + 1) for p in parents} if parents else {"_is_source": True}

    return {check_identifier(table): below(table, 0)}


def hops_by_join_up_to(edges: DataFrame, start: str, most: int) -> DataFrame:
    """table_name of the start and of all within that many hops of it."""
    pairs = edges.select("source_table", "target_table").distinct()
    near = edges.sparkSession.createDataFrame([(start,)], "table_name string")
    for _ in range(most):
        near = _cut(near.unionByName(pairs.join(near, pairs["source_table"] == near["table_name"]).select(F.col("target_table").alias("table_name"))).distinct())
    return near


def paths(edges: DataFrame, table: str, max_depth: int = 5) -> DataFrame:
    """path (array from the table up to a source or the depth's end), depth: one recursive query."""
    edges.select("target_table", "source_table").distinct().createOrReplaceTempView("veridra_edges")
    return edges.sparkSession.sql(
        f"""
with recursive walk(node, path, depth) as (
  select '{check_identifier(table)}', array('{table}'), 0
  union all
  select e.source_table, array_append(w.path, e.source_table), w.depth + 1
  from walk w join veridra_edges e on e.target_table = w.node where w.depth < {int(max_depth)} and not array_contains(w.path, e.source_table)
)
select array_join(path, ' <- ') as path, depth from walk"""
    )


def explain_rows(facts: DataFrame, table: str, column: str) -> DataFrame:
    """All facts of a column, in a fixed order."""
    return facts.filter((F.col("target_table") == check_identifier(table)) & (F.col("target_column") == check_identifier(column))).orderBy("sql_file_name", "transformation_logic")


def explain_column(facts: DataFrame, edges: DataFrame, table: str, column: str) -> str:
    """How a column is computed, as text; the first of several definitions, whose number is told."""
    found = explain_rows(facts, table, column)
    rows = found.limit(1).collect()
    if rows:
        r, others = rows[0], found.count() - 1
        lines = [f"{table}.{column}", f"  from:  {r['source_table']}", f"  kind:  {r['source_column']}", f"  logic: {r['transformation_logic']}", f"  file:  {r['sql_file_name']}"]
        return "\n".join(lines + ([f"  ({others} other definition(s))"] if others else []))
    known = upstream(edges, table).collect()
    if known:
        return f"No computed lineage for '{column}' in '{table}'; it may pass through unchanged from {', '.join(r[0] for r in known)}."
    return f"No lineage found for table '{table}'."


def platform_table_lineage(rows: DataFrame, target: str | None = None) -> DataFrame:
    """A platform's lineage table (source/target catalog, schema, name columns) as edges with two-part names."""
    name = lambda side: F.concat_ws(".", f"{side}_table_schema", f"{side}_table_name")
    out = rows.filter(F.col("source_table_name").isNotNull() & F.col("target_table_name").isNotNull()).select(name("target").alias("target_table"), name("source").alias("source_table")).distinct()
    return out.filter(F.col("target_table") == target) if target else out


def platform_column_lineage(rows: DataFrame, target: str | None = None, column: str | None = None) -> DataFrame:
    out = rows.select(
        F.concat_ws(".", "target_table_schema", "target_table_name").alias("target_table"), F.col("target_column_name").alias("target_column"),
        F.concat_ws(".", "source_table_schema", "source_table_name").alias("source_table"), F.col("source_column_name").alias("source_column"),
    ).distinct()
    for wanted, name in ((target, "target_table"), (column, "target_column")):
        out = out.filter(F.col(name) == wanted) if wanted is not None else out
    return out
