"""The engine: sixteen questions that return plain dicts, lists or text, and never raise.

Each answer is ``{"error": ...}`` (or a text beginning with Error) if it fails.
"""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.types import check_identifier, quoted, two_part
from .operators import footers
from .operators import lineage as L
from .operators import quality as Q
from .operators.staging import release
from .plans import review as R
from .plans import sqllineage as X
from .plans import sqltext as S
from .plans.catalyst import commands_in, reading, renamed
from .sources.catalog import Catalog
from .sources.config import connect, load_config

BLOCKED = ("INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE")


def answers(text: bool = False):
    """Turns an exception into an answer."""

    def wrap(f):
        @functools.wraps(f)
        def call(*args, **kwargs):
            try:
                return f(*args, **kwargs)
            except Exception as error:
                return f"Error: {error}" if text else {"error": str(error)}

        return call

    return wrap


class Engine:
    """Lineage questions ask the platform's own lineage first where ``platform`` has it: a pair of DataFrames, of
    tables and of columns, in the platform's columns; either may be None.  lineage_source: auto, local or platform.
    """

    def __init__(
        self, spark: SparkSession, catalog: Catalog, edges: DataFrame | None = None, facts: DataFrame | None = None, repo: str | Path = ".",
        platform: tuple[DataFrame | None, DataFrame | None] = (None, None), lineage_source: str = "auto", etl_folders: list[Path] = (), context_file: str | Path | None = None,
    ):
        if lineage_source not in ("auto", "local", "platform"):
            raise NotImplementedError(f"Unknown lineage source: {lineage_source}")
        self.spark, self.catalog, self.repo = spark, catalog, Path(repo)
        self.platform, self.lineage_source, self.etl_folders = platform, lineage_source, list(etl_folders)
        self.context_file = Path(context_file) if context_file else None
        self.context = R.load_context(self.context_file) if self.context_file else None
        self.set_lineage(edges, facts)

    @classmethod
    def from_config(cls, path: str | Path, spark: SparkSession | None = None, **options) -> Engine:
        """The engine of a configuration file; the lineage of its SQL folder is read if that source is resolved."""
        config = load_config(path)
        catalog = connect(config, spark)
        local = config.resolve_lineage_source() == "local"
        if local and config.sql_dir and config.sql_dir.is_dir() and "edges" not in options:
            options["edges"], options["facts"] = X.as_frames(catalog.spark, *X.parse_folder(config.sql_dir))
        return cls(catalog.spark, catalog, repo=config.root, etl_folders=config.etl_dirs, lineage_source="local" if local else "platform", **options)

    def platform_available(self) -> bool:
        """Whether the platform's table lineage can be read."""
        if self.lineage_source == "local" or self.platform[0] is None:
            return False
        try:
            self.platform[0].limit(1).collect()
            return True
        except Exception:
            return False

    def _platform_edges(self) -> DataFrame | None:
        return L.platform_table_lineage(self.platform[0]) if self.platform_available() else None

    def set_lineage(self, edges: DataFrame | None, facts: DataFrame | None) -> None:
        """New metadata; what was explained before is forgotten."""
        for old in (getattr(self, "edges", None), getattr(self, "facts", None)):
            if old is not None:
                old.unpersist()
        shorten = lambda df: df.withColumns({c: F.concat_ws(".", F.slice(F.split(c, r"\."), F.greatest(F.size(F.split(c, r"\.")) - 1, F.lit(1)), F.lit(2))) for c in ("target_table", "source_table")})
        self.edges = shorten(edges).persist() if edges is not None else None
        self.facts = facts.persist() if facts is not None else None
        self._explained: dict[tuple, str] = {}

    def clear_cache(self) -> None:
        self._explained.clear()

    def close(self) -> None:
        """Gives back what the engine holds: cached lineage, and tables that operators have staged.  The session is its owner's."""
        self.set_lineage(None, None)
        release(self.spark)

    def _lineage(self) -> DataFrame:
        """The platform's edges and the local ones."""
        found = [e for e in (self._platform_edges(), self.edges.select("target_table", "source_table") if self.edges is not None else None) if e is not None]
        if not found:
            raise LookupError("Lineage metadata not found; build it first")
        return found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()

    def _neighbours(self, ask, table: str) -> list[str]:
        """The platform's answer if it has one, else the local metadata's."""
        for edges in (self._platform_edges(), self.edges):
            rows = [r[0] for r in ask(edges, table).collect()] if edges is not None else []
            if rows:
                return rows
        self._lineage()
        return []

    # Discovery

    @answers()
    def list_schemas(self) -> dict:
        return {"schemas": self.catalog.schemas()}

    @answers()
    def list_tables(self, schema: str | None = None) -> dict:
        return {"tables": self.catalog.tables(schema)}

    @answers()
    def describe_table(self, table: str) -> dict:
        return {"table": table, "columns": self.catalog.columns(table)}

    @answers()
    def get_row_count(self, table: str) -> dict:
        return {"table": table, "row_count": self.catalog.table(table).agg(F.count(F.lit(1))).first()[0]}

    @answers()
    def table_statistics(self, table: str) -> dict:
        """Rows, nulls, least and greatest values of a table of files, from its footers where these tell."""
        if (path := self.catalog.path(table)) is None:
            raise LookupError(f"Not a table of files: {table}")
        return {"table": table, "columns": [r.asDict() for r in footers.footer_profile(self.spark, path).collect()]}

    @answers()
    def inspect_row(self, table: str, key_column: str, key_value) -> dict:
        """One row with this key, or status not_found; the value is cast to the column's type."""
        df = self.catalog.table(table)
        kind = df.schema[check_identifier(key_column, "column")].dataType
        rows = df.filter(F.col(quoted(key_column)) == F.lit(str(key_value)).try_cast(kind)).limit(1).collect()
        return {"status": "found", "row": rows[0].asDict(True)} if rows else {"status": "not_found", "table": table, "key": {key_column: key_value}}

    def query(self, sql: str, params: list | None = None, strict_compat: bool = False) -> DataFrame:
        """A read-only query over the catalog's tables, with ``?`` for params, as a DataFrame.

        The text must parse to one plan without any command, insert or table statement in it, whatever it begins
        with.  strict_compat asks for SELECT and refuses any text with a blocked word in it.
        """
        parts = S.statements(sql)
        toks = S.tokens(sql)
        first = next((t.word for t in toks if t.text != "("), "")
        if first not in (("SELECT",) if strict_compat else ("SELECT", "WITH", "VALUES", "FROM")):
            raise ValueError("Only SELECT queries are allowed")
        if strict_compat and (found := [w for w in BLOCKED if w in sql.upper()]):
            raise ValueError(f"Query contains blocked keyword: {found[0]}")
        if len(parts) != 1:
            raise ValueError("Only one statement is allowed")
        if found := commands_in(self.spark, parts[0]):
            raise ValueError(f"Only reading is allowed: {found[0]}")
        text = self._over_views(parts[0])
        return self.spark.sql(text, args=params) if params else self.spark.sql(text)

    def _over_views(self, sql: str) -> str:
        """The query over temporary views of the registered tables that it names, and of no others.

        A name with its schema means that table; so does a bare one in the default schema, or in the only schema that has it.
        Views have the tables' bare names, with the schema before it only where one query names two tables alike.
        """
        seen = reading(self.spark, sql)
        if seen.refused:
            raise ValueError(f"Not allowed in a query: {seen.refused[0]}")
        full = {parts: self.catalog.resolve(parts) for parts, _ in seen.tables}
        bare = [name.rsplit(".", 1)[-1].lower() for name in set(full.values())]
        view = {name: name.rsplit(".", 1)[-1] if bare.count(name.rsplit(".", 1)[-1].lower()) == 1 else name.replace(".", "__") for name in full.values()}
        for name, short in view.items():
            self.catalog.table(name).createOrReplaceTempView(short)
        names = [(parts, at, f"`{view[full[parts]]}`") for parts, at in seen.tables]
        by_name = {tuple(p.lower() for p in parts): view[name] for parts, name in full.items() if len(parts) > 1}
        by_name |= {tuple(name.lower().split(".")): short for name, short in view.items()}
        for parts, at in seen.columns:
            table = tuple(p.lower() for p in parts[:2])
            if len(parts) > 2 and table in by_name:
                names.append((parts[:2], at, f"`{by_name[table]}`"))
        return renamed(sql, names)

    @answers()
    def run_query(self, sql: str, params: list | None = None, strict_compat: bool = False, limit: int | None = None) -> dict:
        """All rows of a read-only query.  With a limit at most so many are returned; row_count is always the
        query's, and truncated tells whether rows are missing.  Rows come from the executors one partition at a time; results that
        the driver can't hold are for ``query``, which gives a DataFrame."""
        df = self.query(sql, params, strict_compat)
        rows = [r.asDict(True) for r in (df if limit is None else df.limit(limit + 1)).toLocalIterator()]
        if limit is None or len(rows) <= limit:
            return {"rows": rows, "row_count": len(rows), "columns": df.columns, "truncated": False}
        return {"rows": rows[:limit], "row_count": df.count(), "columns": df.columns, "truncated": True}

    # Lineage

    @answers(text=True)
    def explain_column(self, table: str, column: str) -> str:
        key = (two_part(table), column)
        if key not in self._explained:
            told = self._platform_column(*key)
            self._explained[key] = told or L.explain_column(self.facts, self._lineage(), *key) if self.facts is not None else told or f"No lineage found for column '{column}' of '{table}'."
        return self._explained[key]

    def _platform_column(self, table: str, column: str) -> str | None:
        if not self.platform_available() or self.platform[1] is None:
            return None
        rows = L.platform_column_lineage(self.platform[1], check_identifier(table), check_identifier(column)).orderBy("source_table", "source_column").collect()
        return "\n".join([f"{table}.{column}", *(f"  from:  {r['source_table']}.{r['source_column']}" for r in rows)]) if rows else None

    @answers()
    def get_table_sources(self, table: str) -> dict:
        return {"table": table, "sources": self._neighbours(L.upstream, two_part(table))}

    @answers()
    def get_downstream_tables(self, table: str) -> dict:
        return {"table": table, "downstream": self._neighbours(L.downstream, two_part(table))}

    @answers()
    def get_lineage_tree(self, table: str, max_depth: int = 5) -> dict:
        return L.lineage_tree(self._lineage(), two_part(table), max_depth)

    @answers(text=True)
    def analyze_impact(self, table: str) -> str:
        hops = sorted(((r["table_name"], r["hops"]) for r in L.impact(self._lineage(), two_part(table)).collect()), key=lambda x: x[1])
        risk, told = L.risk_of(len(hops))
        return "\n".join([f"IMPACT OF {table}: {risk} ({told})", f"{len(hops)} table(s) downstream", *(f"  {n} hop(s): {t}" for t, n in hops)])

    # Quality

    @answers()
    def check_table_health(self, table: str) -> dict:
        names = [r[0] for r in L.upstream(self._lineage(), two_part(table)).collect()]
        if not names:
            return {"error": f"No upstream sources found for {table}", "hint": "Build the lineage metadata or check the name"}
        known = {n: self.catalog.table(n) if self.catalog.exists(n) else None for n in names}
        return {"table": table, "sources": [r.asDict() for r in Q.source_health(known, self.spark).collect()]}

    @answers()
    def detect_duplicates(self, table: str, columns: str | list[str] | None = None) -> dict:
        df = self.catalog.table(table)
        keys = [c.strip() for c in columns.split(",") if c.strip()] if isinstance(columns, str) else columns
        total = Q.duplicate_summary(df, keys).first()
        if not total["groups"]:
            return {"status": "CLEAN", "table": table, "duplicate_groups": 0, "extra_rows": 0}
        sample = [r.asDict(True) for r in Q.duplicate_sample(df, keys).collect()]
        evidence = [r.asDict() for r in Q.duplicate_evidence(df, keys).collect()] if keys and set(df.columns) - set(keys) else []
        return {
            "status": "DUPLICATES_FOUND", "table": table, "duplicate_groups": total["groups"], "extra_rows": total["extra_rows"], "sample": sample,
            "explanation": Q.explain_duplicates(table, keys or df.columns, sample, total["extra_rows"], not keys, evidence), "suggested_fix": Q.suggest_fix(table, keys or df.columns),
        }

    @answers()
    def validate_business_rules(self, table: str, rules: str | list[str] | None = None) -> dict:
        df = self.catalog.table(table)
        listed = Q.split_rules(rules) if isinstance(rules, str) else rules or Q.rules_for(self.catalog.columns(table))
        found = [r.asDict() for r in Q.validate_rules(df, listed).collect()]
        failing = [r for r in found if r["status"] == "FAIL"]
        if failing:
            samples: dict[str, list] = {}
            for row in sorted(Q.rule_samples(df, [r["rule"] for r in failing]).collect(), key=lambda row: row[1]):
                values = [v.asDict(True) if isinstance(v, Row) else v for v in row[2:]]
                samples.setdefault(row[0], []).append(dict(zip(df.columns, values)))
            for r in failing:
                r["sample"] = samples.get(r["rule"], [])
        return {"table": table, "results": found, "summary": {"total_rules": len(found), **{s.lower(): sum(r["status"] == s for r in found) for s in ("PASS", "FAIL", "ERROR")}}}

    @answers()
    def analyze_data_quality(self, table: str) -> dict:
        return {"table": table, **Q.analyze(self.catalog.table(table))}

    # Review

    @answers()
    def trace_query_columns(self, sql: str) -> dict:
        """Where each column of a SELECT over the registered tables comes from, by the analysed plan."""
        from .plans.catalyst import column_origins

        rows = column_origins(self.query(sql))
        return {"columns": [dict(zip(("column", "kind", "source_table", "source_column"), r)) for r in rows]}

    @answers()
    def peer_review_setup(self) -> dict:
        summary = {r[0]: list(r[1]) for r in L.downstream_summary(self.edges).collect()} if self.edges is not None else {}
        self.context = R.build_context(self.repo, summary, self.etl_folders, self.context_file)
        return {"status": "ready", "etl_files": len(self.context["etl_files"]), "tables": len(self.context["tables"])}

    @answers(text=True)
    def peer_review(self, staged_only: bool = False, include_unchanged: bool = False) -> str:
        versions = R.git_versions(self.repo, staged_only, include_unchanged)
        return R.review(versions, lambda changed: L.chains_from(self.edges, changed), tuple(self.catalog.schemas()), self.context).formatted_output

    @answers()
    def validate_change(self, old_sql: str, new_sql: str) -> dict:
        """The delta of two versions, what endangers it technically, and its likely business impact."""
        delta = R.semantic_delta(old_sql, new_sql)
        facts = [tuple(r) for r in self.facts.collect()] if self.facts is not None else []
        technical = R.validate_technical(old_sql, new_sql, delta["changed_elements"], facts, tuple(self.catalog.schemas()))
        return {"delta": {k: v for k, v in delta.items() if not k.endswith("_sql")}, "technical": technical, "business": R.validate_business(old_sql, new_sql, delta["changed_elements"])}

    @answers()
    def schema_conflicts(self, table: str, before: list[dict]) -> dict:
        """Columns whose type has changed, since an earlier describe_table, to one that is no safe widening."""
        return {"table": table, "blockers": R.schema_conflicts(before, self.catalog.columns(table), table)}


_default: Engine | None = None


def set_engine(engine: Engine | None) -> None:
    """The engine that the functions below ask."""
    global _default
    _default = engine


def get_engine() -> Engine:
    """The engine set before; else one of the session's own tables, made when first asked for."""
    global _default
    if _default is None:
        spark = SparkSession.builder.getOrCreate()
        _default = Engine(spark, Catalog.from_session(spark))
    return _default


def trace_column_lineage(table: str, column: str) -> str:
    return get_engine().explain_column(table, column)


def debug_query_dependencies(table: str) -> dict:
    return get_engine().check_table_health(table)


def get_upstream_tables(table: str) -> list[str]:
    return get_engine().get_table_sources(table).get("sources", [])


def get_lineage_tree(table: str, max_depth: int = 5) -> dict:
    return get_engine().get_lineage_tree(table, max_depth)
