import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from veridra.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root, and of each node its path of (left, right)."""
    paths, above, at = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(at) > 1:
        for i, place in enumerate(above):
            run = at[place // 3 * 3 : place // 3 * 3 + 3]
            paths[i].append((run[: place % 3], run[place % 3 + 1 :]))
        at, above = [h(*at[i : i + 3]) for i in range(0, len(at), 3)], [p // 3 for p in above]
    return (at[0] if at else None), paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    listed = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        listed.append((mine, *tree([leaf(r, r["text"]) for r in mine])))
    root, outer = tree([sub for _, sub, _ in listed])
    found = []
    for (mine, sub, paths), up in zip(listed, outer):
        for r, path in zip(mine, paths):
            even = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
            node = leaf(r, text)
            for left, right in path + up:
                node = h(*left, node, *right)
            proof = h(*[x for left, right in path + up for x in left + right])
            found.append((r["doc_id"], leaf(r, r["text"]), sub, root, proof, node, node == root))
    return sorted(found, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("levels", [6, 2])
def test_manifest_equals_brute_force(spark, docs, levels, monkeypatch):
    """Small buckets take several passes, inside and over the sources."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 3**levels)
    rng = random.Random(1)
    many = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat("source", (F.col("doc_id") % 23).cast("string"))))
    found = merkle.verify_tampering(many.repartition(5))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = rows_of(found)
    assert got == brute(many.collect())
    assert {r[-1] for r in got} == {True, False} and rng.choice(got)[3] == got[0][3]


def test_manifest_odd_rows(odd, none):
    assert rows_of(merkle.verify_tampering(odd)) == brute(odd.collect())
    assert merkle.verify_tampering(none).count() == 0


def test_one_row(odd):
    one = odd.filter("doc_id = 8")
    (row,) = merkle.verify_tampering(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h() and row["verified"]


def test_proofs_of_any_rows_fold_to_the_root(spark, docs):
    rows = merkle.manifest(docs, columns=("text",), group="lang")
    good = rows.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count()
    assert good == docs.count() and rows.select("root").distinct().count() == 1
    assert rows.filter(merkle.folded(F.reverse("leaf"), F.col("path")) == F.col("root")).count() == 0
