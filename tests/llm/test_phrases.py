import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veridra.llm import phrases


def brute(rows, least, covered=80, top=2000):
    words, f = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: n for p, n in counts.items() if n >= least}
        found = []
        for p, a in frequent.items():
            if len(p) < 2:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * n >= covered * a and inside(q) for q, n in frequent.items()):
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p, -a, left, right, words[lang], -score) for rank, (score, a, _, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("block, per_task", [(1 << 20, 500_000), (60, 40)])
def test_collocations_equal_brute_force(spark, block, per_task, monkeypatch):
    """Small blocks cut texts at pieces only; a small bound of a task splits most prefixes."""
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "PER_TASK", per_task)
    rng = random.Random(3)
    words = ["the", "The", "of", "a", "é", "É", "x\x1cy", "10\xa0km", "state", "art", "|", "\x01"]
    passage = "One copied passage of the state, of THE ART; of the\x0bstate of the art"
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "!?", ":"]) for _ in range(rng.randrange(60))) + rng.choice(["", passage])
    rows = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(300)]
    rows += [("en", "the the the the the the the"), ("fr", None), ("en", ""), ("fr", "nothing frequent here")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "lang string, text string, words string").repartition(5)
    want = brute(rows, 12)
    assert len(want) > 100 and rows_of(phrases.collocations(docs, least=12)) == want
    few = phrases.collocations(docs, least=12, top=7)
    assert rows_of(few) == [r for r in want if r[1] <= 7]


def test_documents_equal_brute_force(spark, docs):
    assert rows_of(phrases.collocations(docs)) == brute([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], 30)


def test_odd_rows(odd, none):
    assert rows_of(phrases.collocations(odd, least=2)) == brute([(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()], 2)
    assert phrases.collocations(none).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, other = 9_000_000_000_000_000_001, 9_000_000_000_000_000_007
    row = spark.range(1).select(phrases.best_cut(F.lit(a), F.array(F.lit(other), F.lit(a)), F.array(F.lit(other), F.lit(other))).alias("c")).first()["c"]
    assert (row["score"], row["k"]) == (2_000_000 * a // (2 * other), 0)


def test_a_piece_longer_than_a_block_stays_whole(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 4)
    words = phrases.words_of(pa.array(["a b c d e f g. h i. j", None, "k"]))
    parts = list(phrases.blocks_of(words))
    assert pa.concat_arrays(parts).to_pylist() == words.to_pylist() and all(p[-1].as_py() == "." for p in parts)


def test_projection_counts_every_occurrence_once():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 500)
    hot = np.array([1 << 32 | 2, 3 << 32 | 3], np.int64)
    for parts, split in ((1, hot[:0]), (3, hot[:0]), (3, hot)):
        prefix, which, partly, starts, pointers = phrases.project(text, np.full(len(text), parts), split, np.full(len(split), 4))
        found, pairs = Counter(), {}
        for p, slice_, part, lo, hi in zip(prefix.tolist(), which.tolist(), partly.tolist(), starts, np.r_[starts[1:], len(pointers)]):
            for w1, w2, w3, n in pointers[lo:hi].tolist():
                first = p >> 32 if part else p
                found[(first, w1, w2, w3)] += n
                pairs.setdefault((first, w1), set()).add(slice_)
                assert part == (first << 32 | w1 in split.tolist())
        want = Counter()
        for i in range(len(text) - 1):
            window = [int(x) for x in text[i : i + 4]] + [0] * 4
            if window[0] and window[1]:
                want[(*window[:2], window[2], window[3] if window[2] else 0)] += 1
        assert found == want
        # Only split pairs lie in several slices.
        assert {p for p, slices in pairs.items() if len(slices) > 1} == {(x >> 32, x & 0xFFFFFFFF) for x in split.tolist()}
