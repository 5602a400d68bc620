import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridra.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_quality(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    right = {k: np.mean([r["predicted"] == k for r in rows if r["quality"] == k]) for k in (0, 1)}
    assert right[0] > 0.95 and right[1] > 0.98, right
    # Calibrated: among held-out rows, the mean score is the share of good ones, overall and in two halves of the scores.
    by_score = sorted((r["score"], r["quality"]) for r in rows)
    for part in (by_score, by_score[: len(by_score) // 4], by_score[len(by_score) // 4 :]):
        assert np.mean([s for s, _ in part]) == pytest.approx(np.mean([q for _, q in part]), abs=0.02)
    assert found.count() == docs.count() and found.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0


def test_evidence_is_sizes_by_definition():
    import zstandard

    texts = [b"plain words in plain sentences about ships and winds. " * 3, b"BUY!!! NOW!!! " * 30, b"", b"x", "Größe ñ 你好 ".encode() * 500]
    bad, good = quality.dictionary([b"BUY!!! NOW!!! CHEAP!!! " * 50]), quality.dictionary([b"plain words in ships and winds and sentences " * 30])
    pair = quality.Pair(bad, good)
    size = lambda d, x: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for t in texts:
        b, g = (sum(size(d, t[i : i + quality.BLOCK]) - size(d, b"") for i in range(0, len(t), quality.BLOCK)) for d in (bad, good))
        difference, rate = pair.evidence(t)
        # Prepared dictionaries choose other table sizes, so single bytes may differ.
        assert difference == pytest.approx((b - g) / max(1, b + g), abs=0.03) and rate == pytest.approx(min(b, g) / max(1, len(t)), abs=0.03)
    assert pair.evidence(texts[0])[0] > 0 > pair.evidence(texts[1])[0]


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out_of_three(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0), "good": F.lit("clash"), "half": F.lit(1)})
    one, two = (sorted(map(tuple, quality.score_quality(d, lab).collect())) for d, lab in ((docs, labels), (changed.repartition(7), flipped.repartition(3))))
    assert one == two


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (5, 0, 0), (6, 1, 1), (7, 1, 0), (8, 0, 0), (2, 0, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] == 5}
    assert len(same) == 1
    assert quality.score_quality(none, labels).count() == 0


@pytest.mark.parametrize("given, share", [([], 0.5), ([(4, 1), (5, 1), (6, 1), (7, 1), (8, 1)], 1.0), ([(4, 0), (5, 0), (6, 0), (7, 0), (8, 0)], 0.0)])
def test_one_class_or_none(spark, odd, given, share):
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(odd, labels).collect()} == {share}
