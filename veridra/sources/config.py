"""Configuration from YAML, and where SQL and code lie."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

SKIPPED = {".git", "__pycache__", ".venv", "venv", "node_modules", ".tox"}


@dataclass
class Config:
    root: Path
    db_type: str = "duckdb"
    settings: dict = field(default_factory=dict)
    etl: dict = field(default_factory=dict)
    lineage_source: str = "auto"

    def resolve(self, path: str | None) -> Path | None:
        if not path:
            return None
        found = Path(path)
        return found if found.is_absolute() else self.root / found

    @property
    def sql_dir(self) -> Path | None:
        return self.resolve(self.etl.get("sql_dir"))

    @property
    def jobs_dir(self) -> Path | None:
        return self.resolve(self.etl.get("jobs_dir"))

    @property
    def notebooks_dir(self) -> Path | None:
        return self.resolve(self.etl.get("notebooks_dir"))

    @property
    def etl_dirs(self) -> list[Path]:
        """Those that exist: SQL, then jobs, then notebooks."""
        return [d for d in (self.sql_dir, self.jobs_dir, self.notebooks_dir) if d and d.is_dir()]

    @property
    def etl_dir(self) -> Path | None:
        return next(iter(self.etl_dirs), None)

    def resolve_lineage_source(self) -> str:
        """local or platform: what is configured, else local if there is any code to read, else by the backend."""
        if self.lineage_source != "auto":
            return self.lineage_source
        if any(d.rglob(p) and next(d.rglob(p), None) for d in self.etl_dirs for p in ("*.sql", "*.py", "*.ipynb")):
            return "local"
        return "databricks" if self.db_type == "databricks" else "local"


def load_config(path: str | Path) -> Config:
    """Relative paths hold from the folder above the file's."""
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text()) or {}
    kind = (raw.get("database") or {}).get("type", "duckdb")
    return Config(path.resolve().parent.parent, kind, raw.get(kind) or {}, raw.get("etl") or {}, (raw.get("lineage") or {}).get("source", "auto"))


#: Backends by the name that a configuration gives them: files of a folder, or the session's own catalog.
BACKENDS = ("duckdb", "parquet", "databricks", "spark")


def connect(config: Config, spark=None):
    """The catalog of a configured backend; ValueError for a type that is not known."""
    from pyspark.sql import SparkSession

    from .catalog import Catalog

    if config.db_type not in BACKENDS:
        raise ValueError(f"Unsupported database type: {config.db_type}")
    spark = spark or SparkSession.builder.getOrCreate()
    if config.db_type in ("databricks", "spark"):
        return Catalog.from_session(spark, config.settings.get("schema"))
    folder = config.resolve(config.settings.get("path"))
    if not folder or not folder.is_dir():
        raise ValueError(f"No such folder: {folder}")
    return Catalog.from_directory(spark, str(folder), sorted(p.stem for p in folder.glob("*.parquet")))


def walk(root: Path, *suffixes: str) -> list[Path]:
    return sorted(p for p in Path(root).rglob("*") if p.suffix in suffixes and not SKIPPED & set(p.relative_to(root).parts[:-1]))
