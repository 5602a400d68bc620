"""Joins on time: the row as of a moment, and intervals that overlap.

``asof_join`` is a sort-merge join by parts.  Keys with many rows are cut into time buckets at quantiles of their own rows,
so that a bucket holds about ``per_bucket`` of them however times are spread.  The last right row of each
bucket, one row a bucket, is carried over the buckets that follow; put before a bucket's own rows it makes
every bucket complete in itself, and one window a bucket finds the answers.

``overlap_join`` gives intervals bins of their own length: level j has bins of ``BASE * FAN ** j``, and an
interval belongs to the first level whose bins are no shorter than itself, so it lies in two of them at most.  Two intervals meet
at the higher of their levels, where the shorter one also lies in two bins at most, and only in the
first bin that they share; so every pair comes once, by an equality join that Spark can split where it is skewed, and a
few long intervals cost no more rows than short ones.  Keys with at most ``FEW`` intervals on the right need no bins: each left row is
compared with all of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.types import quoted
from .staging import discard, staged

PER_BUCKET, BROADCAST_KEYS = 1_000_000, 100_000
BASE, FAN, FEW = 1, 8, 64


def _as_number(df: DataFrame, column: str) -> Column:
    """Order-preserving numbers: microseconds of times, days of dates, numbers as they are."""
    kind, col = df.schema[column].dataType, F.col(quoted(column))
    if isinstance(kind, TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, TimestampNTZType):
        minutes = F.unix_date(col.cast("date")).cast("long") * 1440 + F.hour(col) * 60 + F.minute(col)
        return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, NumericType):
        return col
    raise TypeError(f"{column} is neither a time nor a number")


def _known(df: DataFrame, *columns: str) -> Column:
    found = F.lit(True)
    for c in columns:
        found &= F.col(quoted(c)).isNotNull()
    return found


def _named(columns: list[str], taken: list[str], suffix: str) -> dict[str, str]:
    lower = {c.lower() for c in taken}
    return {c: c + suffix if c.lower() in lower else c for c in columns}


# As-of


def bucket_bounds(rows: DataFrame, per_bucket: int) -> DataFrame:
    """key, bounds of the keys that have more than per_bucket rows: quantiles of their times, at which their rows are cut."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_bucket)
    hot = staged(counts, "asof-hot")
    many = hot.agg(F.max("n")).first()[0]
    if many is None:
        discard(hot)
        return rows.sparkSession.createDataFrame([], rows.select("key", F.array("t").alias("bounds")).schema)
    parts = -(-many // per_bucket)
    quantiles = F.percentile_approx("t", F.array(*[F.lit(k / parts) for k in range(1, parts)]), max(10_000, 10 * parts))
    side = F.broadcast(hot.select("key")) if hot.count() <= BROADCAST_KEYS else hot.select("key")
    found = staged(rows.join(side, "key").groupBy("key").agg(F.array_distinct(quantiles).alias("bounds")), "asof-bounds")
    discard(hot)
    return found


def asof_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[tuple[str, str]], tie: list[str] | None = None, columns: list[str] | None = None,
    direction: str = "backward", inclusive: bool = True, within: float | None = None, how: str = "left", suffix: str = "_right", per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time, not after it (forward: not before it).

    by: pairs of (left, right) key columns.  Of right rows of one key and time the one with the greatest ``tie`` columns
    counts (all columns of the result, if not given).  ``inclusive`` lets equal times match; ``within`` bounds the
    distance, in microseconds of times, days of dates, or the number itself.  Left rows without a match, with a null key or a null time stay
    with nulls (how="left") or go (how="inner").  Left rows that repeat all stay.
    """
    if direction not in ("backward", "forward") or how not in ("left", "inner") or not by:
        raise ValueError("direction is backward or forward, how is left or inner, and by names at least one pair of keys")
    columns = columns or [c for c in right.columns if c not in {r for _, r in by}]
    names = _named(columns, left.columns, suffix)
    sign = 1 if direction == "backward" else -1
    keys = lambda df, side: F.struct(*[F.col(quoted(pair[side])).cast(left.schema[pair[0]].dataType).alias(f"k{i}") for i, pair in enumerate(by)])
    value = F.struct(*[F.col(quoted(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    l_known, r_known = _known(left, left_time, *[a for a, _ in by]), _known(right, right_time, *[b for _, b in by])
    l_rows = left.filter(l_known).select(keys(left, 0).alias("key"), (_as_number(left, left_time) * sign).alias("t"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("own"))
    rank = F.struct(*[F.col(quoted(c)) for c in tie]) if tie else value
    r_rows = right.filter(r_known).select(keys(right, 1).alias("key"), (_as_number(right, right_time) * sign).alias("t"), value.alias("value"), rank.alias("rank"))
    r_rows = r_rows.groupBy("key", "t").agg(F.max_by("value", "rank").alias("value"))
    stamps = l_rows.select("key", "t").unionByName(r_rows.select("key", "t"))
    bounds = bucket_bounds(stamps, per_bucket)
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_KEYS else bounds

    def bucketed(rows: DataFrame) -> DataFrame:
        # Bounds that are below a time tell its bucket; equal times never part.
        passed = F.size(F.filter("bounds", lambda b: b < F.col("t")))
        return rows.join(bounds, "key", "left").withColumn("bucket", F.when(F.col("bounds").isNull(), 0).otherwise(passed)).drop("bounds")

    r_rows = bucketed(r_rows)
    found = F.struct(F.col("t").alias("at"), "value")
    # What each bucket ends with, carried to the next one that has any row: one row a bucket, and one only for most keys.
    ends = r_rows.join(bounds, "key", "left_semi").groupBy("key", "bucket").agg(F.max_by(found, "t").alias("end"))
    later = bucketed(stamps.join(bounds, "key", "left_semi")).select("key", "bucket").distinct()
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = later.join(ends, ["key", "bucket"], "left").withColumn("carry", F.last("end", ignorenulls=True).over(before)).filter("carry is not null")
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    l_rows = bucketed(l_rows)
    shape = r_rows.select(found.alias("found"))
    rows = (
        carried.select("key", "bucket", F.lit(None).cast(l_rows.schema["t"].dataType).alias("t"), F.lit(0).alias("side"), F.col("carry").alias("found"), none("own", l_rows))
        .unionByName(r_rows.select("key", "bucket", "t", F.lit(1 if inclusive else 3).alias("side"), found.alias("found"), none("own", l_rows)))
        .unionByName(l_rows.select("key", "bucket", "t", F.lit(2).alias("side"), none("found", shape), "own"))
    )
    so_far = Window.partitionBy("key", "bucket").orderBy(F.col("t").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = rows.withColumn("match", F.last("found", ignorenulls=True).over(so_far)).filter("own is not null")
    if within is not None:
        matched = matched.withColumn("match", F.when(F.col("t") - F.col("match.at") <= within, F.col("match")))
    result = matched.select("own.*", *[F.col(f"match.value.v{i}").alias(names[c]) for i, c in enumerate(columns)])
    if how == "inner":
        return matched.filter("match is not null").select(*[F.col(f"own.{quoted(c)}") for c in left.columns], *[F.col(f"match.value.v{i}").alias(names[c]) for i, c in enumerate(columns)])
    return result.unionByName(left.filter(~l_known).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in columns]))


# Intervals


def _levelled(df: DataFrame, start: Column, end: Column, base: float) -> DataFrame:
    length = (end - start).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log(float(FAN), F.greatest(length, F.lit(float(base))) / float(base)))).cast("int")
    # The logarithm is rounded; a level whose bins are too short goes one up.
    short = F.lit(float(base)) * F.pow(F.lit(float(FAN)), level) < length
    return df.withColumn("level", level + short.cast("int"))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[tuple[str, str]] | None = None, closed: bool = True, base: float | None = None, suffix: str = "_right", few: int = FEW) -> DataFrame:
    """All pairs of rows whose intervals overlap, and whose keys agree where ``by`` names some.

    Closed intervals share their ends; half-open ones ([start, end)) do not, and empty ones overlap nothing.  A point is an interval whose
    start and end are one column.  Intervals with a null end or key, or that end before they start, have no pairs.  Rows that repeat pair each time.
    base: the length of the shortest bins; by default a tenth of the intervals that are no points are shorter.
    few: keys with no more right intervals are joined without bins.
    """
    by = by or []
    names = _named(right.columns, left.columns, suffix)

    def result(pairs: DataFrame) -> DataFrame:
        return pairs.select("a.*", *[F.col(f"b.{quoted(c)}").alias(names[c]) for c in right.columns])

    def spans(df: DataFrame, span: tuple[str, str], side: int) -> DataFrame:
        keys = F.struct(F.lit(0), *[F.col(quoted(p[side])).alias(f"k{i}") for i, p in enumerate(by)])
        rows = df.filter(_known(df, *span, *[p[side] for p in by])).select(keys.alias("key"), _as_number(df, span[0]).alias("s"), _as_number(df, span[1]).alias("e"), F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("own"))
        return rows.filter(F.col("s") <= F.col("e") if closed else F.col("s") < F.col("e"))

    a, b = spans(left, left_span, 0), spans(right, right_span, 1)
    if not by:
        return result(_binned_pairs(a, b, closed, base))
    many = staged(b.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("key"), "overlap-many")
    found = many.count()
    if not found:
        discard(many)
        return result(_pairs_of_keys(a, b, closed))
    side = F.broadcast(many) if found <= BROADCAST_KEYS else many
    split = [[x.join(side, "key", how) for x in (a, b)] for how in ("left_anti", "left_semi")]
    return result(_pairs_of_keys(*split[0], closed).unionByName(_binned_pairs(*split[1], closed, base)))


def _overlap(closed: bool) -> Column:
    return (F.col("as") <= F.col("be")) & (F.col("bs") <= F.col("ae")) if closed else (F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae"))


def _pairs_of_keys(a: DataFrame, b: DataFrame, closed: bool) -> DataFrame:
    x, y = a.withColumnsRenamed({"s": "as", "e": "ae", "own": "a"}), b.withColumnsRenamed({"s": "bs", "e": "be", "own": "b"})
    return x.join(y, "key").filter(_overlap(closed)).select("a", "b")


def _binned_pairs(a: DataFrame, b: DataFrame, closed: bool, base: float | None) -> DataFrame:
    if base is None:
        lengths = a.select("s", "e").unionByName(b.select("s", "e")).select((F.col("e") - F.col("s")).cast("double").alias("n")).filter("n > 0")
        base = lengths.agg(F.percentile_approx("n", 0.1)).first()[0] or BASE
    a, b = (_levelled(x, F.col("s"), F.col("e"), base) for x in (a, b))
    # Levels in use, a few dozen at most: lengths grow by FAN from one to the next.
    levels = [sorted(r[0] for r in x.select("level").distinct().collect()) for x in (a, b)]

    def binned(rows: DataFrame, others: list[int], own: str) -> DataFrame:
        """A row for each bin of the row's own level and of the higher levels that the other side has."""
        used = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("level"))
        at = rows.withColumn("at", F.explode(F.concat(F.array("level"), used)))
        width = F.lit(float(base)) * F.pow(F.lit(float(FAN)), F.col("at"))
        at = at.withColumns({"first": F.floor(F.col("s") / width), "last": F.floor(F.col("e") / width)})
        return at.withColumn("bin", F.explode(F.sequence("first", "last"))).withColumn(own, F.col("at") == F.col("level")).drop("level", "last")

    x = binned(a, levels[1], "a_own").withColumnsRenamed({"s": "as", "e": "ae", "own": "a", "first": "a_first"})
    y = binned(b, levels[0], "b_own").withColumnsRenamed({"s": "bs", "e": "be", "own": "b", "first": "b_first"})
    # Of two levels the pair meets at the higher one: there one row at least is at its own level.
    meet = (F.col("a_own") | F.col("b_own")) & (F.col("bin") == F.greatest("a_first", "b_first"))
    return x.join(y, ["key", "at", "bin"]).filter(meet & _overlap(closed)).select("a", "b")
