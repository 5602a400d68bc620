"""Quality by compression: which of two zstandard dictionaries makes a text smaller.

One dictionary is built from good labelled texts, one from bad ones.  A text is cut into blocks of ``BLOCK`` bytes,
so that what it says itself does not replace the dictionaries, and each block is compressed with both.  The normalised
difference of the sizes, (bad - good) / (bad + good), is the main evidence; the smaller size a byte of text tells
runs of one word, which either dictionary makes small.  A logistic law over both, their squares and their product gives
the score.

Training takes a bounded sample of labelled rows (about ``per_class`` of each class, chosen by a hash of the id) and at
most ``PER_TEXT`` blocks of each, evenly spread over the whole text.  The law is fitted to texts that the dictionaries do
not know: those of either half of the sample under dictionaries of the other.  Its rows are weighted to the classes' true
shares, so scores are probabilities among all labelled rows.  The final dictionaries come from the whole
sample.  Only blocks and pairs of numbers of the sample reach the driver.

Defined cases: texts that are empty or null score the share of good rows; without labels of both classes all do (0.5 if
there are none); null labels and ids are not learned from, of several labels of an id the highest holds; repeated rows
have equal scores; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

BLOCK, PER_TEXT, DICTIONARY, LEVEL = 512, 32, 112_640, 3


def held_out_of_three(doc_id: Column) -> Column:
    """True for the rows whose labels may not be learned from; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3) == 1


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Pair:
    """Compressors with the dictionaries of bad and good texts."""

    def __init__(self, bad: bytes, good: bytes):
        import zstandard

        self.compressors, self.empty = [], []
        for content in (bad, good):
            known = zstandard.ZstdCompressionDict(content or b" " * 8)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.empty.append(len(self.compressors[-1].compress(b"")))

    def evidence(self, raw: bytes) -> tuple[float, float]:
        """The normalised difference of the sizes, and the smaller one a byte; frames without content count 0."""
        cut = blocks(raw)
        bad, good = (sum(len(c.compress(x)) for x in cut) - len(cut) * n for c, n in zip(self.compressors, self.empty))
        return (bad - good) / max(1, bad + good), min(bad, good) / max(1, len(raw))


def terms(evidence: np.ndarray) -> np.ndarray:
    """Both kinds of evidence, their squares and their product."""
    a, b = evidence[..., :1], evidence[..., 1:]
    return np.concatenate([a, b, a * a, b * b, a * b], axis=-1)


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the columns of x and of 1, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    loss = lambda v: float((weight * np.logaddexp(0, -(2 * label - 1) * (x @ v))).sum() + v @ penalty @ v / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - label)) + penalty @ w)
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, share: float, bad: bytes = b"", good: bytes = b"", centre=None, scale=None, weights=None):
        self.share, self.bad, self.good, self.centre, self.scale, self.weights = share, bad, good, centre, scale, weights

    def scorer(self):
        """From the bytes of a text to its score."""
        if self.weights is None:
            return lambda raw: self.share
        pair = Pair(self.bad, self.good)

        def score(raw: bytes) -> float:
            if not raw:
                return self.share
            z = terms((np.array(pair.evidence(raw)) - self.centre) / self.scale) @ self.weights[:-1] + self.weights[-1]
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def _raw(text) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most PER_TEXT blocks of each text, evenly spread over it."""
    for batch in batches:
        chosen = []
        for text in batch.column("text"):
            cut = blocks(_raw(text))
            chosen.append([cut[i * len(cut) // PER_TEXT] for i in range(PER_TEXT)] if len(cut) > PER_TEXT else cut)
        yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("half"), pa.array(chosen, pa.list_(pa.binary()))], ["good", "half", "blocks"])


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """good, half and text of about per_class rows of each class that may be learned from; and how many rows each class has."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_of_three(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("good"))
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda good: F.lit(min(1.0, per_class / counts.get(good, per_class)))
    number = F.xxhash64(F.col("doc_id").cast("string"))
    draw = F.pmod(F.shiftrightunsigned(number, 20), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(draw < F.when(F.col("good") == 1, share(1)).otherwise(share(0)))
    # The ids chosen go to all tasks, after a check of their number, so that no text moves but theirs.
    side = F.broadcast(chosen) if chosen.count() <= 8 * per_class else chosen
    return docs.select("doc_id", "text").join(side, "doc_id").select("good", F.pmod(number, F.lit(2)).cast("int").alias("half"), "text"), counts


def train(docs: DataFrame, labels: DataFrame, per_class: int) -> Model:
    rows, counts = sample(docs, labels, per_class)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(share)
    rows = staged(rows, "quality-sample")
    cut: dict[tuple[int, int], list[bytes]] = {}
    for r in rows.mapInArrow(_spread, "good int, half int, blocks array<binary>").collect():
        cut.setdefault((r["good"], r["half"]), []).extend(map(bytes, r["blocks"]))
    of = lambda good, halves: [b for h in halves for b in cut.get((good, h), [])]
    other = rows.sparkSession.sparkContext.broadcast([(dictionary(of(0, [1 - h])), dictionary(of(1, [1 - h]))) for h in (0, 1)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [Pair(*d) for d in other.value]
        for batch in batches:
            texts = [(good, half, _raw(text)) for good, half, text in zip(batch.column("good").to_pylist(), batch.column("half").to_pylist(), batch.column("text"))]
            found = [(good, *pairs[half].evidence(raw)) for good, half, raw in texts if raw]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), (pa.int32(), pa.float64(), pa.float64()))], ["good", "difference", "rate"])

    seen = np.array(sorted(tuple(r) for r in rows.mapInArrow(measured, "good int, difference double, rate double").collect()), np.float64).reshape(-1, 3)
    discard(rows)
    label, x = seen[:, 0], seen[:, 1:]
    if len(set(label.tolist())) < 2:
        return Model(share)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    weight = np.where(label == 1, counts[1] / label.sum(), counts[0] / (1 - label).sum()) * len(label) / total
    return Model(share, dictionary(of(0, [0, 1])), dictionary(of(1, [0, 1])), centre, scale, logistic(terms((x - centre) / scale), label, weight))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = 1000) -> DataFrame:
    """Of each document: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.scorer()
        for batch in batches:
            scores = [score(_raw(text)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_of_three(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
