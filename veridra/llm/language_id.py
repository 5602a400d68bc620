"""Language identification by prediction by partial matching.

For each language a context tree of bytes holds, for contexts of up to three bytes, how often each byte
followed.  The code length of a text is what an arithmetic coder with these frozen counts would spend:
a byte seen in the longest context costs its share there; another one costs the escape (as many as there
are distinct followers, method C) and then its code in the next shorter context, from which the
bytes already ruled out are excluded.  The shortest code wins; the score is the winner's share when code
lengths are turned back into probabilities.

As the counts are frozen, the trees are unfolded into tables.  All 256 bytes are symbols of the code; those
that no sample has behave alike everywhere, so one row stands for all of them.  A byte that followed its three-byte
context in some language has its code lengths in all languages in one row; for any other, the escapes of the
context are added to the row of the byte in the next shorter context.  Whole texts are scored by array lookups.

Training takes all of about ``per_language`` labelled documents of each language, chosen by a hash of
their ids; this bound is a parameter.  Prediction covers every text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if no
row is labelled; null languages are not learned; ties go to the language first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

BYTES, CHUNK = 256, 1 << 20
_BEFORE = b"   "  # every text begins after spaces


def symbol_map(samples: dict[str, list[bytes]]) -> tuple[np.ndarray, int]:
    """From byte to symbol, 0 for all bytes that no sample has; and the number of symbols."""
    seen = np.zeros(BYTES, bool)
    seen[list(_BEFORE)] = True
    for texts in samples.values():
        for t in texts:
            seen[np.unique(np.frombuffer(t, np.uint8))] = True
    return np.where(seen, np.cumsum(seen), 0).astype(np.uint8 if seen.sum() < 256 else np.uint16), int(seen.sum()) + 1


def _grams(texts: list[bytes], table: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of n symbols and their counts, in order."""
    s = table[np.frombuffer(b"".join(_BEFORE + t for t in texts), np.uint8)].astype(np.int64)
    code = np.zeros(max(0, len(s) - n + 1), np.int64)
    for k in range(n):
        code = code * size + s[k : len(s) - n + 1 + k]
    return np.unique(code, return_counts=True)


def _with_escape(codes: np.ndarray, counts: np.ndarray, contexts: np.ndarray, shorter: np.ndarray, size: int, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each symbol in each of the sorted contexts, and what an escape multiplies the shorter context's by.

    shorter: the probabilities in the contexts' next shorter ones; times: how many bytes a symbol stands for.
    """
    dense = np.zeros((len(contexts), size), np.float32)
    dense[np.searchsorted(contexts, codes // size), codes % size] = counts
    seen = dense > 0
    total, distinct = dense.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    left = (np.where(seen, 0, shorter) * times).sum(1, keepdims=True)
    escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / np.maximum(left, 1e-30), 1.0)
    return np.where(seen, dense / np.maximum(total + distinct, 1), escape * shorter), escape[:, 0]


def train(samples: dict[str, list[bytes]]) -> dict:
    """samples: the texts of each language."""
    langs = sorted(samples)
    table, size = symbol_map(samples)
    times = np.ones(size)
    times[0] = BYTES + 1 - size
    grams = {lang: [_grams(samples[lang], table, size, n) for n in (1, 2, 3, 4)] for lang in langs}
    of = lambda n: [grams[lang][n - 1][0] for lang in langs]
    twos = np.unique(np.concatenate([c // size for c in of(3)]))
    threes = np.unique(np.concatenate([c // size for c in of(4)]))
    fours = np.unique(np.concatenate(of(4)))
    lower = np.empty(((size + len(twos)) * size, len(langs)), np.float32)
    rows, escapes = np.empty((len(fours), len(langs)), np.float32), np.zeros((len(threes) + 1, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        none = np.full((1, size), 1 / BYTES)
        one, _ = _with_escape(*grams[lang][0], np.zeros(1, np.int64), none, size, times)
        two, _ = _with_escape(*grams[lang][1], np.arange(size), np.repeat(one, size, 0), size, times)
        three, _ = _with_escape(*grams[lang][2], twos, two[twos % size], size, times)
        lower[:, k] = -np.log2(np.concatenate([two, three])).ravel()
        place = np.searchsorted(twos, threes % size**2)
        for at in range(0, len(threes), 20_000):  # a dense table of all contexts would be large
            some = threes[at : at + 20_000]
            mine = slice(*np.searchsorted(grams[lang][3][0], [some[0] * size, (some[-1] + 1) * size]))
            four, escape = _with_escape(grams[lang][3][0][mine], grams[lang][3][1][mine], some, three[place[at : at + 20_000]], size, times)
            all_ = slice(*np.searchsorted(fours, [some[0] * size, (some[-1] + 1) * size]))
            rows[all_, k] = -np.log2(four[np.searchsorted(some, fours[all_] // size), fours[all_] % size])
            escapes[1 + at : 1 + at + len(some), k] = -np.log2(escape)
    state_two = np.arange(size**2, dtype=np.int32) % size  # a pair that no sample has counts by its last symbol
    state_two[twos] = size + np.arange(len(twos), dtype=np.int32)
    state_three = np.zeros(size**3, np.int32)
    state_three[threes] = 1 + np.arange(len(threes), dtype=np.int32)
    row_of = np.full((len(threes) + 1, size), -1, np.int32)
    row_of[1 + np.searchsorted(threes, fours // size), fours % size] = np.arange(len(fours), dtype=np.int32)
    sizes = np.array([len(samples[lang]) for lang in langs], np.float64)
    return {"langs": langs, "map": table, "size": size, "twos": state_two, "threes": state_three, "row_of": row_of.ravel(), "rows": rows, "escapes": escapes, "lower": lower, "prior": -np.log2(sizes / sizes.sum())}


def code_lengths(text: bytes, model: dict) -> np.ndarray:
    """Bits that each language's statistics need for the whole text."""
    size, total = model["size"], np.zeros(len(model["langs"]))
    before = model["map"][list(_BEFORE)]
    for at in range(0, len(text), CHUNK):
        s = np.concatenate([before, model["map"][np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)]])
        wide = s.astype(np.int32)
        two = wide[1:-2] * size + wide[2:-1]
        state = model["threes"][wide[:-3] * size**2 + two]
        row = model["row_of"][state * size + wide[3:]]
        known = row >= 0
        total += model["rows"][row[known]].sum(0, dtype=np.float64)
        other = np.flatnonzero(~known)
        total += model["escapes"][state[other]].sum(0, dtype=np.float64)
        total += model["lower"][model["twos"][two[other]] * size + wide[3:][other]].sum(0, dtype=np.float64)
        before = s[-3:]
    return total


def predict(text: str | None, model: dict) -> tuple[str, float]:
    if not text or not model["langs"] or not any(map(str.isalpha, text)):
        return "und", 0.0
    bits = code_lengths(text.encode("utf-8", "replace"), model) + model["prior"]
    best = int(bits.argmin())
    return model["langs"][best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def labelled_sample(docs: DataFrame, per_language: int) -> dict[str, list[bytes]]:
    """About per_language whole texts of each language among the rows that may be learned from."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    found: dict[str, list[bytes]] = {}
    for r in rows.filter(draw < share[F.col("lang")]).select("lang", "text").collect():
        found.setdefault(r["lang"], []).append((r["text"] or "").encode("utf-8", "replace"))
    return {lang: sorted(texts) for lang, texts in found.items()}


def identify_languages(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Of each document: doc_id, held_out, lang_pred and score."""
    samples = labelled_sample(docs, per_language)
    model = docs.sparkSession.sparkContext.broadcast(train(samples) if samples else {"langs": []})

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(text.as_py(), model.value) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")
