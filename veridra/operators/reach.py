"""How many nodes each node of a graph leads to, by a breadth-first search of 64 sources at a time.

Sources are numbered; 64 of them share a word whose bits say which of them have reached a node.  A step joins the bits that
are new with the edges and merges what arrives at a node by ``bit_or``; what a node had already is taken away.  So a step moves one
row for a node and 64 sources, never a pair of nodes, and counts at the end are sums of bits.  Each step's bits are written in the shared
folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, staged


def _numbered(nodes: DataFrame) -> DataFrame:
    """node and number, from 0 without gaps: running numbers of partitions, moved by what lies before a partition."""
    listed = staged(nodes.withColumn("at", F.monotonically_increasing_id()), "reach-nodes")
    listed_path, listed = listed.staged_path, listed.withColumn("part", F.shiftright("at", 33))
    sizes = listed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = listed.join(before, "part").select("node", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))
    found.staged_path = listed_path
    return found


def reach_counts(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """node, reachable (other nodes that it leads to) of each source; by default of all nodes.

    edges: source, target; null ends, loops and repeated edges do not matter.  sources: a column node; those that are on no edge reach 0.
    Cycles are fine: a node does not count itself.
    """
    pairs = staged(edges.select("source", "target").filter("source is not null and target is not null and source <> target").distinct(), "reach-edges")
    if sources is None:
        sources = pairs.select(F.col("source").alias("node")).unionByName(pairs.select(F.col("target").alias("node"))).distinct()
    numbered = _numbered(sources.select("node").filter("node is not null").distinct())
    roots = staged(numbered, "reach-roots")
    discard(numbered)
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    seen = frontier = staged(roots.select("node", F.shiftright("number", 6).alias("word"), bit.alias("bits")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "reach-seen")
    while True:
        arrived = frontier.join(pairs, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node"), "word").agg(F.bit_or("bits").alias("came"))
        had = seen.select("node", "word", F.col("bits").alias("had"))
        fresh = arrived.join(had, ["node", "word"], "left").select("node", "word", F.col("came").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
        step = staged(fresh, "reach-step")
        if step.isEmpty():
            discard(step, pairs, *([frontier] if frontier is not seen else []))
            break
        grown = staged(seen.unionByName(step).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), "reach-seen")
        discard(*{t.staged_path: t for t in (seen, frontier)}.values())
        seen, frontier = grown, step
    # A root's own bit is at its own node only, once.
    sums = seen.groupBy("word").agg(F.array(*[F.sum(F.getbit("bits", F.lit(k)).cast("long")) for k in range(64)]).alias("sums"))
    per_root = sums.select("word", F.posexplode("sums").alias("bit", "n")).select((F.col("word") * 64 + F.col("bit")).alias("number"), "n")
    return roots.join(per_root, "number").select("node", (F.col("n") - 1).alias("reachable"))
