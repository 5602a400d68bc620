"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains.  A canonical key is a host with its labels
reversed, each with a dot behind it, so a host and its subdomains are the keys that start with the host's: an
interval of the sorted keys, and such intervals nest.  Urls and the hosts of rules are sorted together by key
and swept once.  Each rule host carries the stack of rule hosts that are open where it begins, from outer to
inner, with the rules of each; the sweep hands the last stack on to the urls behind it.  Any rule host that
encloses a url is in that stack, as all intervals that hold the url hold the last host begun before it too;
what has closed since is dropped by its key.  Of the rules left on the stack those whose path the url's path
starts with are judged, and the longest wins.

Sweeps run for each top label that rules have.  Labels with many urls are dealt over several sweeps, whose
number keeps the copies of rules below a quarter of the urls; a url moves once, and a page not at all if no rule has its
top label.  A host of more than ``most_paths`` rules would burden each url under it with all of them, so it takes no
place on stacks: the urls under it are swept once more by path, with a stack of nested paths.

Defined cases: a url that is null or has no ``://`` has an empty host and path and gets the default
verdict; rules of an empty host fit nothing; of rules equally long the longer host wins, then ``block``.
Repeated pages give repeated rows.  Only the id and the url are read, so other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, staged

BROADCAST_RULES, MOST_PATHS = 100_000, 256
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HIT = "struct<n:int,h:int,action:string,rule:string>"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def host_key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _keyed(df: DataFrame) -> DataFrame:
    """With the key of the host, and its top label."""
    return df.withColumn("key", host_key(reversed_labels(F.col("host")))).withColumn("top", F.substring_index("key", ".", 1))


def _small(df: DataFrame) -> DataFrame:
    """The table to be sent to all tasks if its size allows."""
    return F.broadcast(df) if df.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df


def clean_rules(rules: DataFrame) -> DataFrame:
    """host, path, key, top, and hit: what a url that the rule fits is judged by, the greatest first."""
    rule = F.concat("host", "path")
    return _keyed(
        rules.filter(F.length("host") > 0)
        .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("host", "path").agg(F.max("action").alias("action"))
    ).withColumn("hit", F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), "action", rule.alias("rule")).cast(_HIT))


def host_stacks(cleaned: DataFrame) -> DataFrame:
    """Of each rule host: key, top, and its stack of (key, rules) from the outermost rule host to itself."""
    levels = cleaned.groupBy("key", "top").agg(F.sort_array(F.collect_list(F.struct("path", "hit"))).alias("rules"))
    labels = F.split(F.expr("substr(key, 1, length(key) - 1)"), r"\.", -1)
    outer = levels.select("key", "top", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: host_key(F.slice(labels, F.lit(1), n)))).alias("outer"))
    return (
        outer.join(levels.select(F.col("key").alias("outer"), "rules"), "outer").groupBy("key", "top")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("outer").alias("depth"), F.col("outer").alias("key"), "rules"))).alias("stack"))
    )


def path_stacks(cleaned: DataFrame) -> DataFrame:
    """Of each rule: its host's key, its path, and the stack of (path, hit) of its host that enclose it, itself last.

    Enclosing paths are looked up at the lengths that paths of the host have.
    """
    lengths = cleaned.groupBy("key").agg(F.collect_set(F.length("path")).alias("lengths"))
    inner = cleaned.join(lengths, "key").select("key", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    return (
        inner.withColumn("outer", F.substring("path", F.lit(1), F.col("n"))).join(cleaned.select("key", F.col("path").alias("outer"), "hit"), ["key", "outer"])
        .groupBy("key", "path").agg(F.array_sort(F.collect_list(F.struct(F.length("outer").alias("depth"), F.col("outer").alias("path"), "hit"))).alias("stack"))
    )


def _swept(points: DataFrame, starts: DataFrame, group: str, place: str, per_sweep: int) -> DataFrame:
    """points with the stack of the last start at or before their place in their group, null if there is none.

    A group's points are dealt over sweeps of at least ``per_sweep`` points and four times its starts.
    """
    splits = _small(
        points.groupBy(group).agg(F.count(F.lit(1)).alias("points")).join(_small(starts.groupBy(group).agg(F.count(F.lit(1)).alias("starts"))), group)
        .select(group, F.ceil(F.col("points") / F.greatest(F.lit(per_sweep), 4 * F.col("starts"))).alias("sweeps"))
    )
    columns = [c for c in points.columns if c not in (group, place)]
    events = (
        points.join(splits, group)
        .select(F.concat_ws("\x02", group, F.pmod(F.xxhash64(place, *columns), "sweeps")).alias("sweep"), place, F.lit(1).alias("kind"), *columns, F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"))
        .unionByName(
            starts.join(splits, group).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sweeps") - 1)))
            .select(F.concat_ws("\x02", group, "n").alias("sweep"), place, F.lit(0).alias("kind"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns], "stack")
        )
    )
    order = Window.partitionBy("sweep").orderBy(place, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1")


def _under_many_paths(urls: DataFrame, cleaned: DataFrame, per_sweep: int) -> DataFrame:
    """host, path and the best hit of the rules of hosts with many, for the urls that any of them fits."""
    starts = staged(path_stacks(cleaned), "path_stacks")
    labels = F.col("labels")
    points = (
        urls.select("host", "path").distinct().withColumn("labels", reversed_labels(F.col("host")))
        .select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: host_key(F.slice(labels, F.lit(1), n)))).alias("key"))
        .join(_small(cleaned.select("key").distinct()), "key").withColumn("url_path", F.col("path"))
    )
    swept = _swept(points, starts, "key", "path", per_sweep)
    still_open = F.filter("stack", lambda s: F.startswith(F.col("path"), s["path"]))
    found = swept.select("host", F.col("url_path").alias("path"), F.try_element_at(still_open, F.lit(-1))["hit"].alias("hit"))
    return found.filter("hit is not null").groupBy("host", "path").agg(F.max("hit").alias("many"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", per_sweep: int = 4096, most_paths: int = MOST_PATHS) -> DataFrame:
    """Of each page: page_id, host, path, rule (null if none fits) and verdict.

    The longest rule wins, by the characters of host and path.  ``per_sweep`` is the least number of urls that a
    sweep takes before a label's urls are split.
    """
    cleaned = staged(clean_rules(rules), "rules")
    many = cleaned.groupBy("key").agg(F.count(F.lit(1)).alias("paths")).filter(F.col("paths") > most_paths).select("key")
    starts = staged(host_stacks(cleaned.join(many, "key", "left_anti")), "stacks")
    urls = _keyed(pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")))
    swept = _swept(urls, starts, "top", "key", per_sweep)
    still_open = F.filter("stack", lambda s: F.startswith(F.col("key"), s["key"]))
    fitting = F.filter(F.flatten(F.transform(still_open, lambda s: s["rules"])), lambda r: F.startswith(F.col("path"), r["path"]))
    tops = _small(starts.select("top").distinct())
    others = urls.join(tops, "top", "left_anti").select("page_id", "host", "path", F.lit(None).cast(_HIT).alias("hit"))
    judged = swept.select("page_id", "host", "path", F.array_max(F.transform(fitting, lambda r: r["hit"])).alias("hit")).unionByName(others)
    if not many.isEmpty():
        judged = judged.join(_under_many_paths(urls, cleaned.join(many, "key", "left_semi"), per_sweep), ["host", "path"], "left").withColumn("hit", F.greatest("hit", "many"))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))
