"""The five stages in plain Python, compared with the pipeline by value."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import tiktoken

import corpus_pipeline
from veridra.llm import common, toxicity
from veridra.llm.registry import MIX, vocabulary
from veridra.llm.token_files import read_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_toxicity(rows, machine):
    scorer = toxicity.Scorer(machine)
    return [r for r in rows if machine.probability(scorer.margins([toxicity.sentences(r["text"] or "")])[0]) < 0.3]


def plain_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append(r)
    return [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]


def plain_near(rows):
    sets = []
    for r in rows:
        words = WORD.findall(lower(r["text"] or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for a, s in enumerate(sets):
        for b, both in Counter(i for x in s for i in where[x] if i > a).items():
            if 100 * both >= 80 * (len(s) + len(sets[b]) - both):
                root[find(b)] = find(a)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r, key=lambda x: x["doc_id"])
    return list(best.values())


def plain_mix(rows, weights, share, cap):
    """Each row as often as it is taken."""
    by_source = defaultdict(list)
    for r in rows:
        text = r["text"] or ""
        h = int(hashlib.md5(f"{r['doc_id']}\x01{text}".encode()).hexdigest()[:8], 16)
        by_source[r["source"]].append((h, len(WORD.findall(text)), r))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n, _ in by_source[s]) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if rate * weight[s] > cap * sizes[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = []
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - whole * sizes[s], 0
        alike = Counter()
        for h, n, _ in by_source[s]:
            alike[h] += n
        upto = {}
        for h in sorted(alike):
            upto[h] = before
            before += alike[h]
        for h, n, r in by_source[s]:
            if n:
                taken += [r] * (whole + (2 * (rest - upto[h]) > alike[h]))
    return taken


def plain_tokens(rows):
    path, pattern = vocabulary()
    encoder = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    found = []
    for r in rows:
        ids = encoder.encode_ordinary(r["text"] or "")
        found.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    return sorted(found)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline_equals_plain_python(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = [r.asDict() for r in docs.collect()]
    machine = toxicity.train(*toxicity.labelled_sample(docs, labels, 1500))
    kept = [rows]
    for stage in (lambda x: plain_toxicity(x, machine), plain_exact, plain_near, lambda x: plain_mix(x, **MIX)):
        kept.append(stage(kept[-1]))
    # Every stage decides something here.
    assert len(rows) > len(kept[1]) > len(kept[2]) > len(kept[3]) > 0 and len(kept[4]) != len(kept[3])
    given = docs
    for (name, stage), before, want in zip(corpus_pipeline.STAGES[:4], kept, kept[1:]):
        given = stage(spark, given, sf_dir)
        assert Counter(r["doc_id"] for r in given.collect()) == Counter(r["doc_id"] for r in want), name
        given = common.staged(given, name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == plain_tokens(kept[4])


def test_release_leaves_nothing_of_a_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    before = common.written()
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(common.written() - before) < 5  # what the last stage reads
    common.release(spark, keep=before)
    assert not list(tmp_path.iterdir())
