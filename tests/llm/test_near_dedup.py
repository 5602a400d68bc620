import random

import numpy as np

from veridra.llm import near_dedup as N


def brute(texts, words, percent):
    """Components by comparing all pairs of shingle tuples."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def made_texts(n_groups=12, seed=3):
    """Groups of chained edits, so that ends of a chain may only be linked through its middle."""
    rng, texts, i = random.Random(seed), {}, 100
    for _ in range(n_groups):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5, 9])):
            texts[i] = " ".join(words)
            i += rng.randrange(1, 5)
            words = list(words)
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return texts


def test_equals_brute_force(spark):
    texts = made_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words in (4, 5):
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, words, 80).collect()}
        assert found == brute(texts, words, 80)


def test_links_missed_by_stars_are_found_across_components(spark, monkeypatch):
    """A chain whose links all avoid each bucket's smallest class."""
    base = [f"w{i}" for i in range(100)]
    texts = {k: " ".join(base[: 100 - 5 * k] + [f"x{i}" for i in range(5 * k)]) for k in range(1, 12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, 4, 80).collect()}
    assert found == brute(texts, 4, 80)


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    texts = made_texts(6, seed=8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, 4, 80).collect()}
    assert found == brute(texts, 4, 80)


def test_low_bytes_that_agree_in_an_earlier_band_lose_no_pair(spark, monkeypatch):
    """Classes 2 and 3 share band 1 only, there with class 1; in band 0 they agree in the low bytes only."""

    def crafted(found, functions):
        n, sig = {27: 1, 47: 2, 48: 3}[len(found)], np.arange(160, dtype=np.uint32).reshape(32, 5) * np.uint32(1000)
        sig[0, 0] += np.uint32(n << 8)
        sig[2:, 0] += np.uint32(n)
        if n == 1:
            sig[2:] += np.uint32(77)
        return sig.ravel()

    monkeypatch.setattr(N, "signature", crafted)
    words = [f"w{i}" for i in range(51)]
    texts = {1: " ".join(f"c{i}" for i in range(30)), 2: " ".join(words[:50]), 3: " ".join(words)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, 4, 80).collect()}
    assert found == brute(texts, 4, 80) and found[3][1] == 2


def test_odd_rows(odd, none):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(odd, 4, 80).collect()}
    assert (1, 0, 1, True) in rows and (2, 0, 2, True) in rows and (3, 0, 3, True) in rows
    assert (5, 4, 5, True) in rows and (6, 4, 5, False) in rows
    assert (8, 1, 8, True) in rows and (4, 1, 4, True) in rows
    assert N.near_duplicates(odd).count() == odd.count() and N.near_duplicates(none).count() == 0
    assert N.drop_near_duplicates(none).count() == 0
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_components(spark):
    links = [(i + 1, i) for i in range(1, 30)] + [(50, 40), (40, 60), (60, 50), (7, 7)]
    found = {r["a"]: r["b"] for r in N.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(2, 31)} | {50: 40, 60: 40}


def test_exact_threshold():
    a, b = np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64)
    assert N.linked(a, b, 80) and not N.linked(a, b, 81) and not N.linked(a, a + np.uint64(100), 1)


def test_word_hashes_know_words():
    one, two = N.word_hashes(b"ab c"), N.word_hashes(b" a\tbc ")
    assert len(one) == len(two) == 2 and not set(one.tolist()) & set(two.tolist())
    assert (N.word_hashes(b"THE cat") == N.word_hashes(b"x the\ncat")[1:]).all()
