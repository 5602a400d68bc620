"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a hash of 32 bits of its id and text.  Words are summed by source and by the hash's
first eight bits; the bucket in which a source's running sum passes its budget is the only one that is
split again, by the next eight bits, down to a threshold of all 32.  A document whose hash lies below its
source's threshold is taken once more.  Nothing is sorted, no row is moved for the choice, and a larger
budget always takes what a smaller one took.

Targets: sources in the order of code points, null last, weigh ``weights`` in turn and share ``share`` of
all words; a target stops at ``cap`` times its source's words, and what is over goes to the others by
weight until none is above.  The sources' list, one row each, is the only thing that meets in one task.

Defined cases: a null text has no words; a document without words is never taken; rows that repeat have
one hash and share their fate; an empty table gives an empty result; only doc_id, source and text are
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged

BITS, LEVELS = 8, 4

#: Of sources (source, source_size): their targets, in the order of operations that DuckDB follows too.
TARGETS = """
ranked as (select source, source_size, cast({weights}[{first} + (row_number() over (order by source nulls last) - 1) % {n_weights}] as double) as weight from sources),
capped as (select *, {cap} * source_size as most, sum(cast(source_size as double)) over () * {share} as budget from ranked),
filled as (select *, (budget - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as rate from capped),
level as (select *, max(rate) over () as best from filled),
targets as (select source, source_size, case when best * weight <= most then best * weight else most end as target from level)
"""


def targets_sql(weights: tuple[float, ...], share: float, cap: float, duckdb: bool = False) -> str:
    listed = ", ".join(f"{float(w)}e0" for w in weights)
    return TARGETS.format(weights=f"[{listed}]" if duckdb else f"array({listed})", first=int(duckdb), n_weights=len(weights), cap=f"{float(cap)}e0", share=f"{float(share)}e0")


def document_hash() -> Column:
    """32 bits of the MD5 of the id and the text."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x01"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(content.cast("binary")), 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the hash h."""
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), document_hash().alias("h"))


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows.sparkSession.sql(
        f"with {targets_sql(weights, share, cap).strip()} select source, source_size, target from targets".replace("from sources)", "from {sources})"),
        sources=sources,
    )


def _running(hist: DataFrame) -> DataFrame:
    """Of each source's histogram (at most 2^BITS buckets): the first bucket whose running sum passes the budget, the
    words below it, and its own."""
    bins = F.array_sort(F.collect_list(F.struct("bucket", "words")))
    start = F.struct(F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("words"))
    step = lambda s, x: F.when(
        (s["bucket"] >= 0), s
    ).otherwise(F.when(s["below"] + x["words"] > F.col("budget"), F.struct(x["bucket"].alias("bucket"), s["below"].alias("below"), x["words"].alias("words"))).otherwise(F.struct(s["bucket"].alias("bucket"), (s["below"] + x["words"]).alias("below"), s["words"].alias("words"))))
    return hist.groupBy("sk", "budget").agg(bins.alias("bins")).select("sk", "budget", F.aggregate("bins", start, step).alias("at"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: sk, size, h; budgets: sk, budget.  Of each sk the threshold that comes nearest to its budget: the last document is
    taken if less than half of it is over."""
    total = BITS * LEVELS
    at = budgets.select("sk", "budget", F.lit(0).cast("long").alias("prefix"))
    kept = None
    for level in range(1, LEVELS + 1):
        shift = total - BITS * level
        inside = rows.join(at.select("sk", "budget", "prefix"), "sk").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        found = _running(inside.groupBy("sk", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words")))
        # Behind the first level the boundary lies inside, as its bucket's words pass what is left of the budget.
        at = staged(found.select("sk", (F.col("budget") - F.col("at.below")).alias("budget"), F.col("at.bucket").alias("prefix"), F.col("at.words").alias("words")), "boundary")
        if kept is None:
            kept = at.filter("prefix < 0").select("sk", F.lit(1 << total).cast("long").alias("threshold"))
        at = at.filter("prefix >= 0")
    return kept.unionByName(at.select("sk", (F.col("prefix") + F.when(2 * F.col("budget") > F.col("words"), 1).otherwise(0)).cast("long").alias("threshold")))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix_rules(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Of each source: sk, source_size, target, how often each of its documents is taken whole, and the
    hash threshold below which one is taken once more.  rows: source, size, h."""
    goal = staged(source_targets(rows, weights, share, cap), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select(_source_key(F.col("source")).alias("sk"), "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    keyed = rows.filter("size > 0").select(_source_key(F.col("source")).alias("sk"), "size", "h")
    return staged(goal.join(thresholds(keyed, goal.select("sk", "budget")), "sk", "left").drop("budget"), "rules")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Of each document: doc_id, source, size, source_size, target, times (how often it is taken) and taken words."""
    rows = staged(sized(docs), "sized")
    rules = mix_rules(rows, weights, share, cap)
    times = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("long")).otherwise(0)
    return rows.withColumn("sk", _source_key(F.col("source"))).join(rules, "sk", "left").select(
        "doc_id", "source", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    rules = mix_rules(staged(sized(docs), "sized"), weights, share, cap)
    rules = rules.select(F.col("sk").alias("__mix_sk"), F.col("whole").alias("__mix_whole"), F.col("threshold").alias("__mix_threshold"))
    times = F.col("__mix_whole") + F.coalesce(F.col("__mix_h") < F.col("__mix_threshold"), F.lit(False)).cast("long")
    return (
        docs.filter(F.col("text").rlike(WORD))
        .withColumns({"__mix_sk": _source_key(F.col("source")), "__mix_h": document_hash()})
        .join(rules, "__mix_sk").withColumn("__mix_times", times).filter("__mix_times > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
