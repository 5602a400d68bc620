import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veridra.operators import distincts as D
from veridra.operators import reach as R


def counts(df):
    return {r["column_name"]: r["distinct_count"] for r in df.collect()}


def table(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-40_000, 40_000, 13)]), rng.choice([0.0, -0.0, float("nan"), 1.5, None, 0.1 + 0.2, 0.3]), rng.choice(["a", "b", "", None]), rng.randrange(-(2**62), 2**62), None) for _ in range(3000)]
    return rows, spark.createDataFrame(rows, "i int, d double, s string, far long, none int")


def test_distinct_counts_are_exact(spark):
    rows, df = table(spark)
    state = D.distinct_state(df)
    assert D.dense_columns(df, df.columns) == ["i"]
    want = {"i": len({r[0] for r in rows} - {None}), "d": 5, "s": 3, "far": len({r[3] for r in rows})}
    assert counts(D.distinct_counts(state)) == want
    assert state.filter("bitmap is not null").count() <= 4  # 80,000 numbers in four bitmaps


def test_states_merge_also_if_a_column_was_dense_in_some_only(spark):
    rows, df = table(spark)
    ids = df.withColumn("n", F.monotonically_increasing_id())
    parts = [ids.filter("n % 3 = 0").drop("n"), ids.filter("n % 3 <> 0").drop("n"), df.limit(0)]
    for dense in (["i"], []):
        states = [D.distinct_state(parts[0], dense=["i"]), D.distinct_state(parts[1], dense=dense), D.distinct_state(parts[2])]
        both = states[0].unionByName(states[1]).unionByName(states[2])
        assert counts(D.distinct_counts(both)) == counts(D.distinct_counts(D.distinct_state(df))) and counts(D.distinct_counts(D.merged(both))) == counts(D.distinct_counts(both))


@pytest.mark.parametrize("values", [[0], [1], [-1, 0, 1], [32768, 32769, -32767, -32768, -32769], [2**40, 2**40 + 7, -(2**40)]])
def test_numbers_of_bitmaps_come_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "i long")
    both = D.distinct_state(df, dense=["i"]).unionByName(D.distinct_state(df.limit(1), dense=[]))
    assert sorted(int(r["value"]) for r in D.merged(both).collect()) == sorted(values)


def test_a_store_reads_added_files_only(spark, tmp_path):
    _, df = table(spark)
    for name, part in (("a", df.filter("s = 'a'")), ("b", df.filter("s is null or s <> 'a'"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    store, files = D.DistinctStore(spark, f"{tmp_path}/store"), [f"{tmp_path}/a", f"{tmp_path}/b"]
    assert store.files() == [] and counts(store.counts()) == {}
    assert store.add(files[:1]) == files[:1] and store.add(files) == files[1:] and store.add(files) == []
    assert counts(store.counts()) == counts(D.distinct_counts(D.distinct_state(df)))
    # A state whose list of files was never written does not count.
    D.distinct_state(spark.createDataFrame([(10**9,)], "i int")).write.parquet(f"{tmp_path}/store/state/batch=lost")
    assert counts(store.counts()) == counts(D.distinct_counts(D.distinct_state(df)))


def brute(edges):
    graph = defaultdict(set)
    for a, b in edges:
        if None not in (a, b):
            graph[a].add(b)
    found = {}
    for start in {x for e in edges if None not in e and e[0] != e[1] for x in e}:
        seen, todo = {start}, [start]
        while todo:
            for b in graph[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        found[start] = len(seen) - 1
    return found


@pytest.mark.parametrize("n, m", [(150, 200), (300, 250)])
def test_reach_equals_brute_force(spark, n, m):
    rng = random.Random(n)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [("hub", f"n{i}") for i in range(0, n, 2)] + [("n1", "hub"), (None, "n1"), ("n2", None), ("self", "self")]
    got = R.reach_counts(spark.createDataFrame(edges + edges[:20], "source string, target string"))
    assert {r["node"]: r["reachable"] for r in got.collect()} == brute(edges)


def test_reach_of_given_sources(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "source long, target long")
    some = spark.createDataFrame([(3,), (99,), (None,), (3,)], "node long")
    assert sorted(map(tuple, R.reach_counts(edges, some).collect())) == [(3, 12), (99, 0)]
    assert R.reach_counts(edges.limit(0)).count() == 0
