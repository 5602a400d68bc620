"""Asset graphs: what lies downstream of an asset, filtered by attributes, and the policies that apply."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import hops_from

NODE_SCHEMA = "id string, tags array<string>, attrs map<string,string>"
POLICY_SCHEMA = "policy_id string, tags array<string>, applies_to array<string>, rules map<string,string>"


@dataclass
class Policy:
    policy_id: str
    tags: list[str] = field(default_factory=list)
    applies_to: list[str] = field(default_factory=list)
    rules: dict = field(default_factory=dict)
    name: str = ""
    description: str = ""
    severity: str = "MEDIUM"

    def matches(self, asset_id: str, tags: list[str]) -> bool:
        """An asset outside applies_to never matches; then tags must overlap.  A policy with neither matches
        all; one with applies_to only matches none (kept as the behaviour is relied on)."""
        if self.applies_to and asset_id not in self.applies_to:
            return False
        return bool(set(self.tags) & set(tags)) if self.tags else not self.applies_to

    def to_dict(self) -> dict:
        return asdict(self)


class AssetGraph:
    """Assets and edges; edges with a missing end are left out."""

    def __init__(self, spark: SparkSession):
        self.spark, self.children, self.nodes, self.policies = spark, {}, {}, []

    def load(self, graph: dict) -> None:
        """{'nodes': [{'id', 'tags', ...}], 'edges': [{'source', 'target'}]}; replaces edges, adds to nodes."""
        self.children = {}
        for edge in graph.get("edges", []):
            if edge.get("source") and edge.get("target"):
                self.children.setdefault(edge["source"], []).append(edge["target"])
        self.nodes |= {n["id"]: n for n in graph.get("nodes", []) if n.get("id")}

    def node_frame(self) -> DataFrame:
        rows = [(i, list(n.get("tags") or []), {k: str(v) for k, v in n.items() if k not in ("id", "tags")}) for i, n in self.nodes.items()]
        return self.spark.createDataFrame(rows, NODE_SCHEMA)

    def downstream(self, asset: str) -> list[str]:
        return [node for node, _ in hops_from(self.children, asset)]

    def impacted(self, asset: str, filters: dict | None = None) -> DataFrame:
        """Impacted assets as rows (id, hops, tags, attrs) after the filter."""
        hops = self.spark.createDataFrame(hops_from(self.children, asset), "id string, hops int")
        return hops.join(self.node_frame(), "id", "left").filter(matches_filters(filters or {}))

    def analyze(self, asset: str, filters: dict | None = None) -> dict:
        if asset not in self.nodes:
            return {"error": f"Asset '{asset}' not found", "impacted_assets": []}
        kept = {r["id"] for r in self.impacted(asset, filters).select("id").collect()}
        assets = [a for a in self.downstream(asset) if a in kept]
        tags = lambda a: self.nodes.get(a, {}).get("tags") or []
        return {"asset": asset, "impacted_assets": assets, "total_impacted": len(assets), "policies": [p.to_dict() for p in self.policies if any(p.matches(a, tags(a)) for a in assets)]}


def matches_filters(filters: dict) -> Column:
    """A list of tags means any of them; any other key must be equal where the asset has it."""
    out = F.lit(True)
    for key, value in filters.items():
        if key == "tags":
            out &= F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, value)))
        else:
            out &= F.coalesce(F.col("attrs")[key] == F.lit(str(value)), F.lit(True))
    return out


def policy_matches(assets: DataFrame, policies: DataFrame) -> DataFrame:
    """id, policy_id of each asset (id, tags) and each policy that applies to it.

    A policy meets assets through its tags and its list of assets by equi-joins; only policies with neither,
    which match everything, are paired with all assets.
    """
    tagged = policies.filter("size(tags) > 0")
    by_tag = tagged.select("policy_id", "applies_to", F.explode("tags").alias("tag"))
    asset_tags = assets.select("id", F.explode("tags").alias("tag"))
    hit = asset_tags.join(by_tag, "tag").filter((F.size("applies_to") == 0) | F.array_contains("applies_to", F.col("id"))).select("id", "policy_id").distinct()
    everywhere = [r[0] for r in policies.filter("size(tags) = 0 and size(applies_to) = 0").select("policy_id").collect()]
    all_ = assets.select("id", F.explode(F.array(*map(F.lit, everywhere))).alias("policy_id")) if everywhere else None
    return hit.unionByName(all_) if all_ is not None else hit
