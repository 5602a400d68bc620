"""Document fingerprints by Order MinHash.

The k-mers of a text's UTF-8 bytes are numbered by occurrence, so that each is unique.  Each of ``sketches``
universal hash functions picks the ``tuple_size`` smallest numbered k-mers; their texts, in the order in
which they stand in the document, are hashed to 32 bits.  Two texts agree in a sketch as often as they share
k-mers in the same order, which falls with the edit distance.  Their likeness is the share of equal sketches.

A text of fewer than k bytes is one k-mer; the empty text has the fingerprint of no k-mer.  So equal texts
have equal fingerprints and likeness 1.

``with_next`` gives each document its successor in descending order of the id.  The documents are dealt to
ordered ranges once; inside a range the successor is the next row.  The last row of a range takes the first
row of the next range that has any, which a join by the ranges' numbers brings; the last document takes the first.

Defined cases: null counts as the empty text; ids of null come last; equal ids go by a hash of their texts; a
single document is its own successor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K, SKETCHES, TUPLE_SIZE = 8, 32, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and shifts of n universal hash functions of 32 bits."""
    seeds = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD)
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def numbered_kmers(raw: bytes, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k-mer, and one of it with the number of its occurrence."""
    if not raw:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    if len(data) < k:
        code = np.array([int.from_bytes(raw, "little") + (len(raw) << 56)], np.uint64)
    else:
        code = np.zeros(len(data) - k + 1, np.uint64)
        for i in range(k):
            code = code * np.uint64(257) + data[i : len(data) - k + 1 + i] if k > 8 else (code << np.uint64(8)) | data[i : len(data) - k + 1 + i]
    code = _mixed(code + np.uint64(1))
    bits = np.uint64(max(1, int(len(code)).bit_length()))
    key = np.sort((code >> bits << bits) | np.arange(len(code), dtype=np.uint64))  # by k-mer, then by place
    same = key >> bits
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(same[1:], same[:-1], out=new[1:])
    if new.all():
        return code, code
    at = np.arange(len(key))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    occurrence = np.empty(len(key), np.uint64)
    occurrence[place] = number.astype(np.uint64)
    return code, np.where(occurrence == 0, code, _mixed(code + occurrence * _ODD))


def fingerprint(raw: bytes, sketches: int = SKETCHES, size: int = TUPLE_SIZE, k: int = K) -> np.ndarray:
    """uint32 of each sketch."""
    a, b = _functions(sketches)
    code, unique = numbered_kmers(raw, k)
    if not len(code):
        return np.zeros(sketches, np.uint32)
    small = (unique >> np.uint64(32)).astype(np.uint32)
    size = min(size, len(code))
    best_hash = best_place = None
    for start in range(0, len(small), _BLOCK):
        hashed = small[None, start : start + _BLOCK] * a[:, None]
        hashed += b[:, None]
        rows, picked_hash, picked_place = np.arange(sketches), [], []
        for _ in range(min(size, hashed.shape[1])):
            at = hashed.argmin(1)
            picked_hash.append(hashed[rows, at])
            picked_place.append(at + start)
            hashed[rows, at] = 0xFFFFFFFF
        h, p = np.stack(picked_hash, 1), np.stack(picked_place, 1)
        if best_hash is not None:
            h, p = np.concatenate([best_hash, h], 1), np.concatenate([best_place, p], 1)
            order = np.argsort(h, axis=1, kind="stable")[:, :size]
            h, p = np.take_along_axis(h, order, 1), np.take_along_axis(p, order, 1)
        best_hash, best_place = h, p
    in_order = code[np.sort(best_place, axis=1)]
    out = np.full(sketches, size, np.uint64)
    for column in in_order.T:
        out = _mixed(out * _ODD + column)
    return (out >> np.uint64(32)).astype(np.uint32)


def shown(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many, or all, of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _result(doc_id, text: str, own: np.ndarray, following: str, next_: np.ndarray) -> tuple:
    changed = edited(text, following).encode("utf-8", "surrogatepass")
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), shown(own), shown(other), likeness(own, other), likeness(own, next_)


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of an ordered range but the last; the texts of its first and last row."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([*_ARROW, ("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    first = last = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            own = fingerprint(_raw(text))
            if last is not None:
                rows.append((*_result(*last, text, own), part, None, None))
            first, last = text if first is None else first, (doc_id, text, own)
        if rows:
            yield batch_of(rows)
    if last is not None:
        yield batch_of([(last[0], None, None, None, None, None, None, part, first, last[1])])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_result(r["doc_id"], r["last_text"], fingerprint(_raw(r["last_text"])), r["following"], fingerprint(_raw(r["following"]))) for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _ARROW)], [n for n, _ in _ARROW])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_chars, edited_sha256, both fingerprints, and the likeness to the edited
    text and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.crc32(F.col("text").cast("binary"))).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.crc32(F.col("text").cast("binary")))
    ranged = staged(ordered.mapInArrow(_in_range, f"{_COLUMNS}, part long, first_text string, last_text string"), "ranged")
    edges = ranged.filter("last_text is not null").select("part", "doc_id", "first_text", "last_text")
    # The numbers of the ranges alone go through one task; the texts meet by a join.
    by_part = Window.orderBy("part")
    order = edges.select("part").select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next_part"))
    firsts = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    following = edges.join(order, "part").join(firsts, "next_part").select("doc_id", "last_text", "following")
    inner = ranged.filter("last_text is null").select(*[n for n, _ in _ARROW])
    return inner.unionByName(following.mapInArrow(_at_edges, _COLUMNS))
