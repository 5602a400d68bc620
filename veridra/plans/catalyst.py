"""What Spark's own analyser knows of a query: column origins, and the class of its error.

The only module that uses handles of the JVM session, which Spark Connect does not have; callers fall back on the
scanner in ``sqltext``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession


#: Where a plan node keeps its named expressions.
LISTS = {"Project": "projectList", "Aggregate": "aggregateExpressions", "Window": "windowExpressions"}


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def commands_in(spark: SparkSession, sql: str) -> list[str]:
    """The kinds of the parsed plan's nodes that do anything but read: commands, inserts, statements about tables."""
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    statement = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
    found = []

    def walk(plan) -> None:
        if command.isInstance(plan) or statement.isInstance(plan) or _kind(plan).startswith("InsertInto"):
            found.append(_kind(plan))
        for child in _listed(plan.children()):
            walk(child)
        if _kind(plan) == "UnresolvedWith":
            for relation in _listed(plan.cteRelations()):
                walk(relation._2())

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))
    return found


#: Functions that run any method of the JVM, and nodes that run programs or take names from text (fixed values).
REFLECTION = ("java_method", "reflect", "try_reflect")
REFUSED_NODES = ("ScriptTransformation", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier")
_PART = r"(?:`(?:[^`]|``)+`|\w+)"


@dataclass
class Reading:
    """What a parsed query reads: tables with the places of their names, columns that are named with their table, and what is refused."""

    tables: list[tuple[tuple[str, ...], int]] = field(default_factory=list)
    columns: list[tuple[tuple[str, ...], int]] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)


def _place(node) -> int:
    at = node.origin().startIndex()
    return at.get() if at.isDefined() else 0


def reading(spark: SparkSession, sql: str) -> Reading:
    """What the query reads, by its parsed plan; names that a WITH defines are not tables where it holds."""
    found = Reading()

    def expression(e) -> None:
        kind = _kind(e)
        if kind in REFUSED_NODES:
            found.refused.append(kind)
        elif kind == "UnresolvedFunction" and (name := _listed(e.nameParts())[-1].lower()) in REFLECTION:
            found.refused.append(name)
        elif kind == "UnresolvedAttribute":
            found.columns.append((tuple(_listed(e.nameParts())), _place(e)))
        elif kind == "UnresolvedStar" and e.target().isDefined():
            found.columns.append(((*_listed(e.target().get()), "*"), _place(e)))
        for child in _listed(e.children()):
            expression(child)

    def walk(plan, known: frozenset) -> None:
        kind = _kind(plan)
        if kind in REFUSED_NODES:
            found.refused.append(kind)
        if kind == "UnresolvedRelation":
            parts = tuple(_listed(plan.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in known:
                found.tables.append((parts, _place(plan)))
        for e in _listed(plan.expressions()):
            expression(e)
        for inner in _listed(plan.subqueries()):
            walk(inner, known)
        if kind == "UnresolvedWith":
            for relation in _listed(plan.cteRelations()):
                name = relation._1().lower()
                walk(relation._2(), known | {name} if plan.allowRecursion() else known)
                known |= {name}
        for child in _listed(plan.children()):
            walk(child, known)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset())
    return found


def renamed(sql: str, names: list[tuple[tuple[str, ...], int, str]]) -> str:
    """The query with other names: (parts of the old one, its place as the parser counts, the new one)."""
    wide = [0]  # the parser counts in units of 16 bits
    for c in sql:
        wide.append(wide[-1] + (2 if ord(c) > 0xFFFF else 1))
    at_unit = {unit: n for n, unit in enumerate(wide)}
    cuts: dict[int, tuple[int, str]] = {}
    for parts, unit, new in names:
        pattern = re.compile(r"\s*\.\s*".join([_PART] * len(parts)))
        same = lambda text: tuple(p.strip("`").replace("``", "`").lower() for p in re.findall(_PART, text)) == tuple(p.lower() for p in parts)  # noqa: B023, E731
        start = at_unit[unit]
        while (m := pattern.search(sql, start)) and not same(m[0]):
            start = m.start() + 1
        if not m:
            raise ValueError(f"Name not understood: {'.'.join(parts)}")
        cuts[m.start()] = (m.end(), new)
    out, at = [], 0
    for start, (end, new) in sorted(cuts.items()):
        out += [sql[at:start], new]
        at = end
    return "".join([*out, sql[at:]])


def column_origins(df: DataFrame) -> list[tuple[str, str, str, str]]:
    """(output column, kind, table, column) for each base column that an output column is computed from.

    kind is PASSTHROUGH, EXPRESSION or AGGREGATED; the table is the nearest alias above the relation ("" if
    there is none).  A column without any origin, such as a literal or COUNT(*), gives no row.
    """
    made: dict[int, object] = {}  # expression by id
    base: dict[int, tuple[str, str]] = {}
    renamed: dict[int, list[int]] = {}  # output of a set operation -> the same place of each branch

    def walk(plan, alias: str) -> None:
        kind = _kind(plan)
        if kind == "SubqueryAlias":
            alias = plan.alias()
        children = _listed(plan.children())
        for e in _listed(getattr(plan, LISTS[kind])()) if kind in LISTS else []:
            if _kind(e) == "Alias":
                made[e.exprId().id()] = e.child()
        if kind in ("Union", "Intersect", "Except"):
            for i, out in enumerate(_listed(plan.output())):
                ids = [_listed(c.output())[i].exprId().id() for c in children]
                renamed[out.exprId().id()] = [x for x in ids if x != out.exprId().id()] + [x for x in ids if x == out.exprId().id()]
        if not children:
            for out in _listed(plan.output()):
                base[out.exprId().id()] = (alias, out.name())
        for child in children:
            walk(child, alias)

    def origins(id_: int, seen: frozenset) -> tuple[set[tuple[str, str]], bool, bool]:
        """Base columns, whether computed, whether aggregated."""
        if id_ in seen:
            return set(), False, False
        seen |= {id_}
        found, computed, aggregated = ({base[id_]} if id_ in base else set()), False, False
        if id_ in made:
            e = made[id_]
            computed = _kind(e) != "AttributeReference"
            aggregated = any(f"{a}(" in e.toString().lower() for a in ("sum", "avg", "count", "min", "max"))
            for ref in _listed(e.references().toSeq()):
                more, c, a = origins(ref.exprId().id(), seen)
                found, computed, aggregated = found | more, computed or c, aggregated or a
        for other in renamed.get(id_, []):
            more, c, a = origins(other, seen)
            found, computed, aggregated = found | more, computed or c, aggregated or a
        return found, computed, aggregated

    plan = df._jdf.queryExecution().analyzed()
    walk(plan, "")
    rows = []
    for out in _listed(plan.output()):
        found, computed, aggregated = origins(out.exprId().id(), frozenset())
        kind = "AGGREGATED" if aggregated else "EXPRESSION" if computed else "PASSTHROUGH"
        rows += [(out.name(), kind, table, column) for table, column in sorted(found)]
    return rows


def origins_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(column_origins(df), "target_column string, kind string, source_table string, source_column string")


def analysis_error(spark: SparkSession, sql: str) -> str | None:
    """The class of the error that the parser or analyser finds in a query (such as TABLE_OR_VIEW_NOT_FOUND or
    MISSING_AGGREGATION), or None; nothing runs."""
    try:
        spark.sql(sql).schema
    except (ParseException, AnalysisException) as error:
        return error.getCondition()
    return None
