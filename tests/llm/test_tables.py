import random

import pytest

import corpus_pipeline
from veridra.llm import mixing, url_rules
from veridra.llm.registry import ORACLE, QUERIES, URL_RULES


def best(host, path, rules):
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


@pytest.mark.parametrize("most_paths", [256, 1])
def test_urls_equal_brute_force(spark, most_paths):
    rules = [*URL_RULES, ("a.example.com", "/en/x", "allow"), ("example.com", "/en/x/y", "block"), ("com", "/en/", "block"), ("org", "", "block"), ("", "/", "block")]
    urls = [f"{s}{h}{p}" for s in ("http://", "ftp://") for h in ("COM", "example.com", "a.example.com", "xexample.com", "www.example.com", "net", "b.net", "internet", "a.org", "com.", "") for p in ("", "/", "/en/", "/en/x/y?z", "/es/#f", "?q=/en/", "/EN/", "/fr/a/b")]
    urls += ["no scheme", "", "a://b://c/", "://example.com/en/", "http://example.com:80/en/", None, None, "http://x.com/\nen"]
    pages = spark.createDataFrame([(i // 2, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    found = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in url_rules.filter_urls(pages, table, per_sweep=4, most_paths=most_paths).collect())
    want = []
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        rule, verdict = best(host, path, [r for r in rules if r[0]])
        want.append((str(i // 2), host, path, str(rule), verdict))
    assert found == sorted(want)


@pytest.mark.parametrize("most_paths", [256, 2])
def test_nested_hosts_and_long_paths_equal_brute_force(spark, most_paths):
    """Random rules over few labels, so that hosts and paths nest deeply, some paths of thousands of characters."""
    rng = random.Random(6)
    host = lambda: ".".join(rng.choice(["a", "b", "a-b", "b0", "é"]) for _ in range(rng.randrange(1, 6)))
    path = lambda: "/" + "".join(rng.choice(["a/", "b", "a", "%", "x" * 900]) for _ in range(rng.randrange(0, 6)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(120))}.values())
    pages = [(i, h, p) for i, (h, p) in enumerate((host(), path() + rng.choice(["", "/z"])) for _ in range(1500))]
    urls = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.filter_urls(urls, table, per_sweep=50, most_paths=most_paths).collect()}
    assert len(found) == len(pages)
    for i, h, p in pages:
        assert found[i] == best(h, p, rules), (h, p[:50])


def test_urls_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    table = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    assert url_rules.filter_urls(pages, table).count() == 0
    one = spark.createDataFrame([(None, "http://a.net/es/1")], "page_id long, url string")
    assert [tuple(r) for r in url_rules.filter_urls(one, table.limit(0)).collect()] == [(None, "a.net", "/es/1", None, "allow")]


def test_mix_targets_and_choice(spark, docs):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for s, goal in targets.items():
        mine = [r for r in rows if r["source"] == s]
        assert goal <= 2 * mine[0]["source_size"] + 1e-6 and mine[0]["source_size"] == sum(r["size"] for r in mine)
        taken = sum(r["taken"] for r in mine)
        assert abs(goal - taken) <= max(r["size"] for r in mine) / 2 + 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)


def test_mix_budgets_nest(docs):
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, share=s).collect()} for s in (0.7, 1.2))
    assert all(large[i] >= n for i, n in small.items())


def test_mix_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r["times"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_every_operator_is_registered():
    assert [any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [True] * 13
    assert set(ORACLE) <= set(QUERIES)


def test_pipeline_stages_are_those_operators(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "tokenize"]
    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns and 0 < docs.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.columns[0] == "doc_id"


def test_pipeline_takes_odd_rows(spark, odd):
    """Extra columns with clashing names pass through every stage but the last."""
    docs = odd
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() > 0 and (docs.columns == before.columns or n == len(corpus_pipeline.STAGES) - 1), name


def test_pipeline_takes_empty_tables(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() == 0
