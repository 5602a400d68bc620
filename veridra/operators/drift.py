"""Schema drift: snapshots of all tables' columns, their difference, and what it endangers downstream."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import SAFE_WIDENINGS
from ..sources.catalog import Catalog
from .lineage import downstream_summary

LONG = "table_name string, column_name string, column_type string"
ORDER = {"GREEN": 0, "YELLOW": 1, "RED": 2}


def capture(catalog: Catalog) -> dict[str, list[dict]]:
    """The columns of every table; what cannot be described is left out."""
    found = {}
    for t in catalog.tables():
        name = f"{t['table_schema']}.{t['table_name']}"
        try:
            found[name] = catalog.columns(name)
        except Exception as error:
            print(f"{name} cannot be described: {error}")
    return found


def long_form(spark: SparkSession, tables: dict[str, list[dict]]) -> DataFrame:
    return spark.createDataFrame([(t, c["column_name"], c["column_type"]) for t, columns in tables.items() for c in columns], LONG)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """table_name, column_name, change_type, old_type, new_type, risk of every difference of two long forms.

    Added is GREEN, removed RED, another type YELLOW if it is a listed widening, else RED; case of types does not
    count.  A dropped table removes all of its columns.
    """
    old, new = (df.select("table_name", "column_name", F.col("column_type").alias(c)) for df, c in ((before, "old_type"), (after, "new_type")))
    both = old.join(new, ["table_name", "column_name"], "full_outer")
    safe = F.struct(F.upper("old_type").alias("o"), F.upper("new_type").alias("n")).isin(*[F.struct(F.lit(o).alias("o"), F.lit(n).alias("n")) for o, n in sorted(SAFE_WIDENINGS)])
    kind = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("type_changed")
    risk = F.when(kind == "added", "GREEN").when((kind == "type_changed") & safe, "YELLOW").otherwise("RED")
    changed = F.col("old_type").isNull() | F.col("new_type").isNull() | (F.upper("old_type") != F.upper("new_type"))
    return both.filter(changed).select("table_name", "column_name", kind.alias("change_type"), "old_type", "new_type", risk.alias("risk"))


def enrich(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds downstream_tables, and raises risks: added with any downstream, or more than three downstream of what
    is not RED, is YELLOW."""
    joined = changes.join(downstream_summary(edges), "table_name", "left").withColumn("downstream_tables", F.coalesce("downstream", F.array().cast("array<string>")))
    n = F.size("downstream_tables")
    raised = F.when(F.col("risk") == "RED", "RED").when(((F.col("change_type") == "added") & (n > 0)) | (n > 3), "YELLOW").otherwise(F.col("risk"))
    return joined.select("table_name", "column_name", "change_type", "old_type", "new_type", raised.alias("risk"), "downstream_tables")


def risk_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("risk").agg(F.count(F.lit(1)).alias("changes"))


class DriftMonitor:
    """Snapshots as JSON files in a folder of the driver."""

    def __init__(self, catalog: Catalog, folder: str | Path, edges: DataFrame | None = None):
        self.catalog, self.folder, self.edges = catalog, Path(folder), edges

    def snapshot(self, tables: dict | None = None) -> Path:
        self.folder.mkdir(parents=True, exist_ok=True)
        now = datetime.now()
        path = self.folder / f"snapshot_{now:%Y%m%d_%H%M%S_%f}.json"
        path.write_text(json.dumps({"timestamp": now.isoformat(), "tables": capture(self.catalog) if tables is None else tables}, indent=2))
        return path

    def latest(self) -> dict | None:
        found = sorted(self.folder.glob("snapshot_*.json"))
        return json.loads(found[-1].read_text()) if found else None

    def detect(self) -> dict:
        """The changes since the latest snapshot; the first run only takes one.  Ends with a new snapshot."""
        before, now = self.latest(), capture(self.catalog)
        if before is None:
            self.snapshot(now)
            return report([])
        spark = self.catalog.spark
        changes = compare(long_form(spark, before["tables"]), long_form(spark, now))
        if self.edges is not None:
            changes = enrich(changes, self.edges)
        rank = {"added": 0, "removed": 1, "type_changed": 2}
        rows = sorted((r.asDict() for r in changes.collect()), key=lambda r: (r["table_name"], rank[r["change_type"]], r["column_name"]))
        self.snapshot(now)
        return report(rows)


def main(argv: list[str] | None = None) -> int:
    """snapshot or detect over a folder of Parquet tables; 1 if anything RED was detected."""
    import argparse

    parser = argparse.ArgumentParser(description="Take a snapshot of schemas, or detect what changed since the last.")
    parser.add_argument("action", choices=("snapshot", "detect"))
    parser.add_argument("--tables", required=True, help="folder with a Parquet file or folder for each table")
    parser.add_argument("--out", required=True, help="folder of the snapshots")
    args = parser.parse_args(argv)
    names = sorted(p.stem for p in Path(args.tables).glob("*.parquet"))
    monitor = DriftMonitor(Catalog.from_directory(SparkSession.builder.getOrCreate(), args.tables, names), args.out)
    if args.action == "snapshot":
        print(monitor.snapshot())
        return 0
    found = monitor.detect()
    print(found["text"])
    return int(found["red"] > 0)


def report(changes: list[dict]) -> dict:
    """Counts, risk by table, and text."""
    by_risk = Counter(c["risk"] for c in changes)
    tables = {t: max((c["risk"] for c in changes if c["table_name"] == t), key=ORDER.get) for t in sorted({c["table_name"] for c in changes})}
    sign = {"added": "+", "removed": "-", "type_changed": "~"}
    lines = ["SCHEMA DRIFT REPORT", ""]
    if not changes:
        lines.append("No schema changes detected.")
    for table, risk in tables.items():
        lines.append(f"{table} [{risk}]")
        for c in (c for c in changes if c["table_name"] == table):
            types = f"{c['old_type']} -> {c['new_type']}" if c["change_type"] == "type_changed" else c["new_type"] or c["old_type"]
            affects = ", ".join(c.get("downstream_tables") or [])
            lines.append(f"  {sign[c['change_type']]} {c['column_name']} ({types}) {c['risk']}" + (f"; feeds {affects}" if affects else ""))
    return {"total_changes": len(changes), "red": by_risk["RED"], "yellow": by_risk["YELLOW"], "green": by_risk["GREEN"], "risk_by_table": tables, "changes": changes, "text": "\n".join(lines)}


if __name__ == "__main__":
    raise SystemExit(main())
