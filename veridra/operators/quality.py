"""Data quality: duplicates, business rules, null and numeric profiles, a score from 0 to 100.

A profile takes two jobs whatever the number of columns: one aggregate for counts, nulls, least, greatest
and mean, and one for exact distinct counts, which would widen every row of the first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import canonical_type, is_numeric, quoted
from .staging import staged

#: Words in a rule that is not run, words in names of what is never negative, causes of duplicates.
FORBIDDEN = ("DROP", "DELETE", "UPDATE", "INSERT", "TRUNCATE")
NOT_NEGATIVE = ("salary", "price", "amount", "cost", "revenue", "quantity")
CAUSES = (
    "Missing DISTINCT in source SQL transformation",
    "JOIN conditions creating cartesian products",
    "Data entry errors (true duplicates)",
    "Missing unique constraints",
)


#: Keys of more bytes than this are found by digests first.  Repeated digests up to the second number go to all tasks; of
#: more, a bitmap of at most 2 ** MAP_BITS bits goes first.
WIDE_BYTES, BROADCAST_DIGESTS, MAP_BITS = 48, 500_000, 26


# Duplicates


def _width(df: DataFrame, keys: list[str]) -> int:
    """About how many bytes a key has."""
    return sum(8 if is_numeric(kind := canonical_type(df.schema[c].dataType)) or kind in ("DATE", "TIMESTAMP", "BOOLEAN") else 20 for c in keys)


def repeated_candidates(df: DataFrame, keys: list[str], broadcast: int = BROADCAST_DIGESTS, map_bits: int = MAP_BITS) -> DataFrame:
    """The rows whose key may occur more than once: all of those that do, and a few others, which the caller's grouping by the key tells.

    Only digests are shuffled, 16 bytes a row and the count.  The digests that repeat are written; if they are few, each task keeps its
    rows by them without moving one.  Else it keeps them by a bitmap of the digests, which lets some other rows pass; to
    join these away would move all candidates once more, and Spark puts such a semi-join before the bitmap, where it moves all rows.
    """
    columns = [F.col(quoted(c)) for c in keys]
    digests = {"__d1": F.xxhash64(*columns), "__d2": F.xxhash64(F.lit(1), *columns)}
    repeated = staged(df.select(*[c.alias(n) for n, c in digests.items()]).groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__d1", "__d2"), "digests")
    found, rows = repeated.count(), df.withColumns(digests)
    if found <= broadcast:
        kept = rows.join(F.broadcast(repeated), ["__d1", "__d2"], "left_semi")
    else:
        bits = min(1 << map_bits, 1 << (16 * found).bit_length())
        place = F.pmod("__d1", F.lit(bits))
        marked = repeated.groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(__d1, {bits}) % 64 as int))")).alias("__bits"))
        kept = rows.withColumn("__word", F.shiftright(place, 6)).join(F.broadcast(marked), "__word").filter(F.getbit("__bits", (place % 64).cast("int")) == 1)
    return kept.select(*[F.col(quoted(c)) for c in df.columns])


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The key columns and duplicate_count of each key that occurs more than once; nulls are one key.

    Wide keys are compared in full among candidates only (``repeated_candidates``).
    """
    keys = columns or df.columns
    if missing := [c for c in keys if c not in df.columns]:
        raise ValueError(f"Columns not found: {', '.join(missing)}")
    rows = df.select(*map(quoted, keys))
    if _width(df, keys) > WIDE_BYTES:
        rows = repeated_candidates(rows, keys)
    return rows.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("duplicate_count")).filter("duplicate_count > 1")


def duplicate_evidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """column_name, varying_groups, groups: in how many of the groups of equal keys each other column has several values (null is one)."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        raise ValueError("No columns besides the keys")
    rows = repeated_candidates(df, keys)
    value = lambda c: F.struct(F.col(quoted(c)))  # noqa: E731  (a struct orders null too)
    per_group = rows.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("__n"), *[(F.min(value(c)) != F.max(value(c))).alias(f"__v{i}") for i, c in enumerate(others)]).filter("__n > 1")
    one = per_group.agg(F.count(F.lit(1)).alias("groups"), *[F.count_if(f"__v{i}").alias(f"v{i}") for i in range(len(others))])
    return one.select("groups", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("varying_groups")) for i, c in enumerate(others)])).alias("x")).select("x.column_name", "x.varying_groups", "groups")


def duplicate_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """groups, rows_in_groups, extra_rows, in one row."""
    return duplicate_groups(df, columns).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("rows_in_groups")).select(
        "groups", "rows_in_groups", (F.col("rows_in_groups") - F.col("groups")).alias("extra_rows")
    )


def duplicate_sample(df: DataFrame, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    keys = columns or df.columns
    return duplicate_groups(df, keys).orderBy(F.desc("duplicate_count"), *map(quoted, keys)).limit(n)


def explain_duplicates(table: str, keys: list[str], sample: list[dict], extra: int, all_columns: bool, evidence: list[dict] = ()) -> str:
    """The narrative; ``evidence`` are rows of duplicate_evidence, from which it tells copies from fan-out."""
    what = "all columns" if all_columns else ", ".join(keys)
    lines = [f"{extra} duplicate row(s) in {table} by {what}; {len(sample)} group(s) shown."]
    if len(sample) <= 3:
        lines += [f"  {g}" for g in sample]
    varying = sorted((e for e in evidence if e["varying_groups"]), key=lambda e: (-e["varying_groups"], e["column_name"]))
    if varying:
        lines.append("The rows of a group differ in " + ", ".join(f"{e['column_name']} ({e['varying_groups']} of {e['groups']} groups)" for e in varying[:5]) + ": the key is finer, or a join multiplies rows.")
    elif all_columns or evidence:
        lines.append("The rows of a group agree in every column: they are copies.")
    lines += ["Possible reasons:", *(f"  - {c}" for c in CAUSES)]
    if "fact" in table.lower():
        lines.append("  A fact table may repeat keys on purpose; check its grain.")
    return "\n".join(lines)


def suggest_fix(table: str, keys: list[str]) -> str:
    named = ", ".join(keys) if len(keys) <= 3 else "the key columns"
    return f"Keep one row per {named}: ROW_NUMBER() OVER (PARTITION BY {named} ORDER BY ...) = 1 on {table}."


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*order))).filter("__n = 1").drop("__n")


# Rules


def split_rules(text: str) -> list[str]:
    """Cut at commas outside parentheses and quotes."""
    out, depth, quote, at = [], 0, False, 0
    for i, c in enumerate(text + ","):
        quote ^= c == "'"
        depth += 0 if quote else (c == "(") - (c == ")")
        if c == "," and not quote and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    return [r for r in out if r]


def forbidden(rule: str) -> bool:
    return any(re.search(rf"\b{w}\b", rule, re.IGNORECASE) for w in FORBIDDEN)


def rules_for(columns: list[dict]) -> list[str]:
    """Rules that column names and types suggest, sorted: start before end date or no end yet, a start, amounts not
    negative, ids positive and not null (``id`` anywhere in a name counts)."""
    end = next((c["column_name"] for c in columns if "end_date" in c["column_name"].lower()), None)
    exact = any(c["column_name"].lower() == "end_date" for c in columns)
    found = set()
    for c in columns:
        name, low, numeric = c["column_name"], c["column_name"].lower(), is_numeric(c["column_type"])
        if "start_date" in low and exact:
            found |= {f"{end} >= {name} OR {end} IS NULL", f"{name} IS NOT NULL"}
        if numeric and any(k in low for k in NOT_NEGATIVE):
            found.add(f"{name} >= 0")
        if numeric and "id" in low:
            found.add(f"{name} > 0")
        if "id" in low:
            found.add(f"{name} IS NOT NULL")
    return sorted(found)


def validate_rules(df: DataFrame, rules: list[str]) -> DataFrame:
    """rule, status (PASS, FAIL, ERROR, SKIPPED), violations, and why a rule was skipped or failed to run.

    A row violates a rule if NOT (rule) is true, so null never does.  All rules that can be analysed run in one
    aggregate; if one fails while running, each runs on its own.
    """
    spark, status, ready = df.sparkSession, {}, []
    for rule in rules:
        if forbidden(rule):
            status[rule] = ("SKIPPED", None, "Rule contains dangerous SQL operations")
            continue
        try:
            df.filter(~F.expr(f"({rule})")).schema
            ready.append(rule)
        except Exception as error:
            status[rule] = ("ERROR", None, str(error))

    def counted(some: list[str]) -> None:
        row = df.agg(*[F.count_if(~F.expr(f"({r})")).alias(f"v{i}") for i, r in enumerate(some)]).first()
        for r, n in zip(some, row):
            status[r] = ("FAIL" if n else "PASS", n, None)

    if ready:
        try:
            counted(ready)
        except Exception:
            for rule in ready:
                try:
                    counted([rule])
                except Exception as error:
                    status[rule] = ("ERROR", None, str(error))
    return spark.createDataFrame([(r, *status[r]) for r in rules], "rule string, status string, violations long, reason string")


def rule_violations(df: DataFrame, rules: list[str]) -> DataFrame:
    """rule, violations as one lazy aggregate (for rules known to run)."""
    one = df.agg(*[F.count_if(~F.expr(f"({r})")).alias(f"v{i}") for i, r in enumerate(rules)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v{i}").alias("violations")) for i, r in enumerate(rules)])).alias("x")).select("x.rule", "x.violations")


def violating_rows(df: DataFrame, rule: str) -> DataFrame:
    return df.filter(~F.expr(f"({rule})"))


def rule_samples(df: DataFrame, rules: list[str], order: list[Column] | None = None, k: int = 5) -> DataFrame:
    """rule, place (from 1) and the columns of the first k violating rows of each rule, in one scan for all rules.

    order should be total; without it rows go by all their columns.  A task keeps k rows of a rule before any row moves.
    """
    order = order or [F.col(quoted(f.name)) for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    failed = F.filter(F.array(*[F.when(~F.expr(f"({r})"), F.lit(i)) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    rows = df.select("*", F.explode(failed).alias("__rule"))
    ranked = rows.withColumn("__place", F.row_number().over(Window.partitionBy("__rule").orderBy(*order))).filter(F.col("__place") <= k)
    name = F.element_at(F.array(*map(F.lit, rules)), F.col("__rule") + 1)
    return ranked.select(name.alias("rule"), F.col("__place").alias("place"), *[F.col(quoted(c)) for c in df.columns])


# Profiles


def null_profile(df: DataFrame, with_rows: bool = False) -> DataFrame:
    """column_name, null_count, null_pct, status (OK under 5 %, WARNING under 50 %, else CRITICAL), and row_count if
    asked for: one aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count")) for i, c in enumerate(df.columns)])).alias("x"))
    pct = F.when(F.col("n") > 0, 100 * F.col("x.null_count") / F.col("n")).otherwise(0.0)
    found = long.select("n", "x.column_name", "x.null_count", F.round(pct, 2).alias("null_pct"), F.when(pct < 5, "OK").when(pct < 50, "WARNING").otherwise("CRITICAL").alias("status"))
    return found.withColumnRenamed("n", "row_count") if with_rows else found.drop("n")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(canonical_type(f.dataType))]


def numeric_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_name, min_value, max_value, avg_value, distinct_count over non-null values, as doubles."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, min_value double, max_value double, avg_value double, distinct_count long")
    cols = [F.col(quoted(c)) for c in names]
    basic = [x for i, c in enumerate(cols) for x in (F.min(c).cast("double").alias(f"min{i}"), F.max(c).cast("double").alias(f"max{i}"), F.avg(c).alias(f"avg{i}"))]
    if approximate:
        one = df.agg(*basic, *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
        rows = lambda i: F.col(f"d{i}")
    else:
        # Several distinct counts in one aggregate would repeat each row, all columns wide, for each of them.  One
        # aggregate a column reads and moves that column only; each gives one row.
        one = df.agg(*basic).withColumn("one", F.lit(1))
        for i, c in enumerate(cols):
            one = one.join(F.broadcast(df.select(c.alias("v")).agg(F.count_distinct("v").alias(f"d{i}")).withColumn("one", F.lit(1))), "one")
        rows = lambda i: F.col(f"d{i}")
    return one.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"), F.col(f"avg{i}").alias("avg_value"), rows(i).alias("distinct_count")) for i, c in enumerate(names)])).alias("x")
    ).select("x.*")


def outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond the quartiles by factor times their distance."""
    q = F.percentile_approx(quoted(column), F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    low, high = df.agg(q.alias("q")).first()["q"] or (None, None)
    if low is None:
        return df.limit(0)
    return df.filter((F.col(quoted(column)) < low - factor * (high - low)) | (F.col(quoted(column)) > high + factor * (high - low)))


def type_issues(df: DataFrame) -> list[dict]:
    """Text columns whose name says date."""
    return [{"column_name": f.name, "issue": "date stored as text"} for f in df.schema.fields if canonical_type(f.dataType) == "VARCHAR" and "date" in f.name.lower()]


#: What a text column may hold instead of text, and the form of each value (fixed values).
TEXT_FORMS = {"date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9:.]+)?$", "integer": r"^[+-]?[0-9]{1,18}$", "number": r"^[+-]?[0-9]+[.][0-9]+$", "boolean": r"^(true|false|TRUE|FALSE)$"}


def text_forms(df: DataFrame) -> DataFrame:
    """column_name, form, matching, row_count of each text column and form whose values have it, in one aggregate; nulls do not count."""
    texts = [f.name for f in df.schema.fields if canonical_type(f.dataType) == "VARCHAR"]
    pairs = [(c, form, pattern) for c in texts for form, pattern in TEXT_FORMS.items()]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, form string, matching long, row_count long")
    one = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)], *[F.count_if(F.col(quoted(c)).rlike(pattern)).alias(f"m{i}") for i, (c, _, pattern) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(form).alias("form"), F.col(f"m{i}").alias("matching"), F.col(f"n{texts.index(c)}").alias("row_count")) for i, (c, form, _) in enumerate(pairs)])
    return one.select(F.explode(listed).alias("x")).select("x.*").filter("matching > 0")


def typed_texts(df: DataFrame) -> list[dict]:
    """Text columns all of whose values have one form of another type."""
    rows = text_forms(df).filter("matching = row_count").orderBy("column_name", "form").collect()
    return [{"column_name": r["column_name"], "issue": f"{r['form']} stored as text"} for r in rows]


def score(critical: int, warning: int, has_duplicates: bool, n_type_issues: int) -> dict:
    """Fixed weights: 100 less 20, 5, 15 and 5 each; at least 0."""
    value = max(0, 100 - 20 * critical - 5 * warning - 15 * has_duplicates - 5 * n_type_issues)
    grade = "EXCELLENT" if value >= 90 else "GOOD" if value >= 70 else "FAIR" if value >= 50 else "POOR"
    return {"score": value, "grade": grade, "issues_count": critical + warning + int(has_duplicates) + n_type_issues}


def score_frame(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """critical, warning, duplicates, type_issues, score, grade as one row, by column arithmetic."""
    issues = len(type_issues(df))
    nulls = null_profile(df).agg(F.count_if(F.col("status") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "WARNING").alias("warning")).withColumn("one", F.lit(1))
    dup = duplicate_summary(df, keys).select((F.col("extra_rows") > 0).cast("int").alias("duplicates")).withColumn("one", F.lit(1))
    value = F.greatest(F.lit(0), 100 - 20 * F.col("critical") - 5 * F.col("warning") - 15 * F.col("duplicates") - 5 * F.lit(issues)).cast("long")
    return nulls.join(F.broadcast(dup), "one").select("critical", "warning", "duplicates", F.lit(issues).alias("type_issues"), value.alias("score")).withColumn(
        "grade", F.when(F.col("score") >= 90, "EXCELLENT").when(F.col("score") >= 70, "GOOD").when(F.col("score") >= 50, "FAIR").otherwise("POOR")
    )


def analyze(df: DataFrame) -> dict:
    """The full analysis; an empty table ends it early."""
    columns = [r.asDict() for r in null_profile(df, with_rows=True).collect()]
    row_count = columns[0]["row_count"] if columns else df.count()
    if row_count == 0:
        return {"status": "EMPTY", "row_count": 0, "message": "Table has no rows"}
    columns = [{k: v for k, v in c.items() if k != "row_count"} for c in columns]
    numeric = [r.asDict() for r in numeric_profile(df).collect()]
    dup = duplicate_summary(df).first()
    issues = type_issues(df)
    named = {i["column_name"] for i in issues}
    stored = [i for i in typed_texts(df) if i["column_name"] not in named]
    critical = [c["column_name"] for c in columns if c["status"] == "CRITICAL"]
    warning = [c["column_name"] for c in columns if c["status"] == "WARNING"]
    advice = [f"Remove {dup['extra_rows']} duplicate row(s)"] if dup["extra_rows"] else []
    advice += [f"Convert {i['column_name']} to a date" for i in issues] + [f"{i['column_name']}: {i['issue']}" for i in stored] + [f"Fill or drop {c}: mostly null" for c in critical]
    return {"status": "OK", "row_count": row_count, "columns": columns, "numeric": numeric, "duplicates": dup.asDict(), "type_issues": issues, "typed_texts": stored, "recommendations": advice, "quality": score(len(critical), len(warning), dup["extra_rows"] > 0, len(issues))}


def source_health(sources: dict[str, DataFrame | None], spark) -> DataFrame:
    """source_table, row_count, status: OK, EMPTY, or ERROR for what cannot be read; one job for all."""
    parts = []
    for name, df in sources.items():
        if df is None:
            parts.append(spark.createDataFrame([(name, None, "ERROR")], "source_table string, row_count long, status string"))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source_table"), "row_count", F.when(F.col("row_count") > 0, "OK").otherwise("EMPTY").alias("status")))
    if not parts:
        return spark.createDataFrame([], "source_table string, row_count long, status string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
