"""A Merkle manifest of a dataset: one tree of runs of three a group, and one over the groups' roots.

A row's leaf is the SHA-256 of its columns, each as ``-`` if null, else its count of UTF-8 bytes, a colon and the value.
Per group the leaves ascend by id; every three neighbours (the last run: fewer, even one) become the hash of
their joined hex texts until one node remains.  The groups' roots, in the order of the groups (null first, by bytes), are
reduced alike to the root of the dataset.  A proof is, level by level, what stands left and right of a node in
its run; folding a leaf with it gives the root, if nothing was changed.

The rows are dealt to ordered ranges once; the numbers of rows of each range give every row its place, so that a group
of any size is spread over many tasks.  Places are cut at multiples of ``FAN ** LEVELS`` into aligned buckets, whose trees
do not depend on each other.  An executor gets one bucket as an Arrow table and runs one DuckDB query a level: an ordered
``string_agg`` of each run and its ``sha256``.  The tops of the buckets are the nodes of the next pass, until each
group has one; a pass divides their number by 729.  The proofs of the upper passes and of the outer tree, one
row a bucket, are joined to the rows of the buckets.

Defined cases: null columns count as above; of equal ids the smaller leaf comes first, ids of null come first of all;
rows that repeat have a leaf each; a group of one row has its leaf as its root; an empty table gives no rows.  Columns
other than those named do not matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 3, 6
BUCKET = FAN**LEVELS
PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def encoded(value: Column) -> Column:
    """``-`` if null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(columns: dict[str, Column]) -> Column:
    """The hash of a row's columns, in the order given."""
    return hashed(*map(encoded, columns.values()))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, run: hashed(run["left"], node, run["right"]))


def proof_digest(path: Column) -> Column:
    """The hash of a proof's siblings from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "").cast("binary"), 256)


def placed(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds pos (from 0) and total to each row: its place in its group by the given order, and the group's size.

    The ordered rows are written with their running number of their range; counts of each range and group, at most
    as many as there are ranges and groups together, give what stands before a range.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    # The running number has the range's in its upper 31 bits and begins with 0 in each.
    ordered = staged(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    ranged = ordered.withColumn("part", F.shiftright("at", 33))
    counts = ranged.groupBy("part", F.col(group).alias("__of")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_group = Window.partitionBy("__of")
    before = F.coalesce(F.sum("rows").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = counts.select(F.col("part").alias("in_part"), "__of", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_group).alias("total"))
    found = ranged.join(known, (F.col("part") == F.col("in_part")) & F.col(group).eqNullSafe(F.col("__of")))
    found = found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "total")
    found.staged_path = ordered.staged_path
    return found


def height(total: int) -> int:
    levels = 0
    while FAN**levels < total:
        levels += 1
    return levels


def _bucket(table: pa.Table) -> pa.Table:
    """The nodes of an aligned bucket with their paths to its top, and the top: one query a level."""
    import duckdb

    levels = min(LEVELS, height(table.column("total")[0].as_py()))
    with duckdb.connect(config={"threads": 1, "memory_limit": "200MB"}) as db:
        db.register("given", table.select(["pos", "node"]))
        db.execute(f"create table level0 as select pos % {BUCKET} as idx, node from given")
        runs, joins = [], []
        for n in range(levels):
            db.execute(f"create table run{n} as select idx // {FAN} as idx, string_agg(node, '' order by idx) as run from level{n} group by 1")
            db.execute(f"create table level{n + 1} as select idx, sha256(run) as node from run{n}")
            place = f"g.pos % {BUCKET} // {FAN**n} % {FAN} * 64"
            runs.append(f"{{'left': left(run{n}.run, {place}), 'right': substr(run{n}.run, {place} + 65)}}")
            joins.append(f"join run{n} on run{n}.idx = g.pos % {BUCKET} // {FAN ** (n + 1)}")
        top = db.execute(f"select node from level{levels}").fetchall()[0][0]
        paths = db.sql(f"select g.pos, [{', '.join(runs)}] as path from given g {' '.join(joins)} order by g.pos").to_arrow_table()
    table = table.sort_by("pos")
    path = paths.column("path").cast(_PATH) if levels else pa.array([[]] * table.num_rows, _PATH)
    return table.append_column(pa.field("path", _PATH), path).append_column(pa.field("top", pa.string()), pa.array([top] * table.num_rows, pa.string()))


def one_pass(nodes: DataFrame, group: str, name: str) -> DataFrame:
    """nodes: group, pos, total, node and more columns; adds path and top of each node's bucket."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    dealt = nodes.groupBy(F.col(group).alias("__group"), F.floor(F.col("pos") / BUCKET).alias("__bucket"))
    return staged(dealt.applyInArrow(_bucket, f"{schema}, path {PATH}, top string"), name)


def _above(group: str) -> list[Column]:
    """Keys of a node's bucket, which is a node of the next pass."""
    return [F.col(group), F.floor(F.col("pos") / BUCKET).alias("pos")]


def forest(nodes: DataFrame, group: str, name: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The first pass over the nodes; of each of its buckets (group, pos) the path from there to the group's root; and what to discard."""
    first = last = one_pass(nodes, group, name)
    passes = []
    while (last.agg(F.max("total")).first()[0] or 0) > BUCKET:
        above = last.filter(F.col("pos") % BUCKET == 0).select(*_above(group), F.ceil(F.col("total") / BUCKET).alias("total"), F.col("top").alias("node"))
        last = one_pass(above, group, name)
        passes.append(last)
    up = last.filter(F.col("pos") % BUCKET == 0).select(*_above(group), F.array().cast(PATH).alias("above"), F.col("top").alias("subroot"))
    for lower in reversed(passes):
        up = _joined(lower.select(group, "pos", "path"), up, group).select(group, "pos", F.concat("path", "above").alias("above"), "subroot")
    return first, up, passes


def _joined(nodes: DataFrame, up: DataFrame, group: str) -> DataFrame:
    """Nodes with what is known of their buckets."""
    named = up.withColumnsRenamed({group: "__group", "pos": "__pos"})
    return nodes.join(named, F.col(group).eqNullSafe(F.col("__group")) & (F.floor(F.col("pos") / BUCKET) == F.col("__pos"))).drop("__group", "__pos")


def proofs(leaves: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """leaves: group, node and more columns.  Adds subroot, root and path (of structs left, right: from the leaf to the root)."""
    inner = placed(leaves, group, order, "merkle-leaves")
    first, up, passes = forest(inner, group, "merkle-nodes")
    discard(inner)
    up = staged(up, "merkle-buckets")
    discard(*passes)
    subroots = up.filter("pos = 0").select(F.col(group).alias("of"), F.lit(0).alias("outer"), F.col("subroot").alias("node"))
    roots = placed(subroots, "outer", [F.col("of").asc_nulls_first()], "merkle-subroots")
    outer_first, outer_up, outer_passes = forest(roots, "outer", "merkle-outer")
    discard(roots)
    outer = staged(_joined(outer_first, outer_up.withColumnRenamed("subroot", "root"), "outer").select("of", F.concat("path", "above").alias("outer_path"), "root"), "merkle-roots")
    discard(outer_first, *outer_passes)
    # One row a bucket meets its group's proof, so that a large group's rows never share a key.
    known = staged(up.join(outer, F.col(group).eqNullSafe(F.col("of"))).select(group, "pos", F.concat("above", "outer_path").alias("above"), "subroot", "root"), "merkle-proofs")
    discard(up, outer)
    return _joined(first, known, group).select(*leaves.columns, "subroot", "root", F.concat("path", "above").alias("path"))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", **also: Column) -> DataFrame:
    """Of each row: key, group, leaf, what ``also`` names, subroot, root and path."""
    leaf = leaf_of({c: F.col(c) for c in columns})
    leaves = staged(docs.select(F.col(key), F.col(group), leaf.alias("node"), *[c.alias(n) for n, c in also.items()]), "merkle-rows")
    found = proofs(leaves, group, [F.col(key).asc_nulls_first(), F.col("node").asc()])
    discard(leaves)
    return found.withColumnRenamed("node", "leaf")


def verify_tampering(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and what verification says of rows whose line feeds were deleted.

    Rows whose id has an even CRC-32 are tampered with; a row verifies if its leaf, tampered with or not, and its original
    proof lead to the root.
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    without = {c: F.col(c) for c in COLUMNS} | {"text": F.translate("text", "\n", "")}
    rows = manifest(docs, present=F.when(even, leaf_of(without)))
    again = rows.withColumn("folded_root", folded(F.coalesce("present", "leaf"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
