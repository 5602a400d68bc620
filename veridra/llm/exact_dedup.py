"""Exact deduplication by Grace hashing.

Texts are equal when they agree in all but white space (space and U+0009 to U+000D).  Each task first
folds the equal texts of its own rows, so that a text that fills a third of the table leaves a task once.
What is left goes to the partition of its hash.  There records stream into an open-addressing table
that compares complete contents; when the table outgrows its memory, its records and all that follow are
dealt to spill files by the next bits of the hash, and each file is treated the same way until its bucket
fits.  Spill files belong to a task as Spark's own do: they lie in the executor's temporary folder, no
other task reads them, and they are gone when the task ends.

The table of groups then meets the documents' ids and hashes again in a join whose hot keys Spark can
split; texts take no part in it.

Defined cases: null counts as the empty text; of equal texts the one with the most code points stays, then
that of the smallest id, ids of null last.  Rows that repeat an id and a text share their mark in
``mark_duplicates``; ``drop_duplicates`` leaves one of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged

PARTIAL_BYTES = 32 << 20
TABLE_BYTES = 64 << 20
FAN_OUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, an entry its complete content."""

    def __init__(self):
        self.slots, self.used = [-1] * 1024, 0
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, chars: int, doc_id: int | None, twins: int, rows: int) -> None:
        mask, home = len(self.slots) - 1, int.from_bytes(digest[-8:], "little")
        at = home & mask
        while (n := self.slots[at]) >= 0:
            entry = self.entries[n]
            if entry[0] == digest and entry[1] == content:
                mine, other = self.rank(entry[2], entry[3]), self.rank(chars, doc_id)
                if other < mine:
                    entry[2:5] = chars, doc_id, twins
                elif other == mine:
                    entry[4] += twins
                entry[5] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, chars, doc_id, twins, rows])
        self.bytes += len(content) + 300
        if 2 * len(self.entries) > len(self.slots):
            self.grow()

    @staticmethod
    def rank(chars: int, doc_id: int | None) -> tuple:
        return (-chars, doc_id is None, doc_id or 0)

    def grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for n, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def grace(records: Iterator[tuple], emit: Callable[[list[list]], Iterator], budget: int, folder: str, level: int = 0) -> Iterator:
    """Yields emit(entries) for one bucket after another."""
    table, files = ContentTable(), None
    fan = 1 << FAN_OUT_BITS
    part = lambda digest: (int.from_bytes(digest[:8], "big") >> (64 - FAN_OUT_BITS * (level + 1))) & (fan - 1)
    try:
        for record in records:
            if files is None:
                table.add(*record)
                if table.bytes > budget and len(table.entries) > 1 and level < 64 // FAN_OUT_BITS:
                    files = [open(os.path.join(folder, f"{level}-{k}-{os.urandom(6).hex()}"), "w+b") for k in range(fan)]
                    for entry in table.entries:
                        pickle.dump(tuple(entry), files[part(entry[0])], 5)
                    table = ContentTable()
            else:
                pickle.dump(tuple(record), files[part(record[0])], 5)
        if files is None:
            yield from emit(table.entries)
            return
        for file in files:
            file.seek(0)
            yield from grace(_unspilled(file), emit, budget, folder, level + 1)
            file.close()
            os.unlink(file.name)
    finally:
        for file in files or []:
            file.close()


def _unspilled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        chars = pc.utf8_length(text).to_pylist()
        for doc_id, raw, n in zip(batch.column("doc_id").to_pylist(), text.cast(pa.binary()), chars):
            content = raw.as_py().translate(None, BLANKS)
            yield hashlib.sha256(content).digest(), content, n, doc_id, 1, 1


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        digests = [hashlib.sha256(raw.as_py().translate(None, BLANKS)).digest() for raw in text.cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pc.utf8_length(text).cast(pa.int64())], ["doc_id", "digest", "own_chars"])


_PARTIAL = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("chars", pa.int64()), ("best_id", pa.int64()), ("twins", pa.int64()), ("rows", pa.int64())])


def _partials(entries: list[list], step: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), step):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries[at : at + step]), _PARTIAL)], schema=_PARTIAL)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of one task as one record each; beyond PARTIAL_BYTES it starts anew."""
    table = ContentTable()
    for record in _contents(batches):
        table.add(*record)
        if table.bytes > PARTIAL_BYTES:
            yield from _partials(table.entries)
            table = ContentTable()
    yield from _partials(table.entries)


def _groups(batches: Iterator[pa.RecordBatch], budget: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    def records():
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from zip(*columns)

    def emit(entries):
        if entries:
            digest, _, chars, best, twins, rows = zip(*entries)
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(chars, pa.int64()), pa.array(best, pa.int64()), pa.array(twins, pa.int64()), pa.array(rows, pa.int64())], ["digest", "chars", "keep_id", "twins", "group_size"])

    folder = tempfile.mkdtemp(prefix="grace-")
    try:
        yield from grace(records(), emit, budget, folder)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def content_groups(docs: DataFrame) -> DataFrame:
    """Of each distinct content: digest, chars (of the longest), keep_id, twins (rows that have this id, content and length), group_size."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    partial = rows.mapInArrow(_folded, "digest binary, content binary, chars long, best_id long, twins long, rows long")
    return partial.repartition("digest").mapInArrow(_groups, "digest binary, chars long, keep_id long, twins long, group_size long")


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, keep_id, group_size, kept and text_sha256."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_hashes, "doc_id long, digest binary, own_chars long")
    return hashed.join(content_groups(docs), "digest", "left").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_chars") == F.col("chars"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs.  Rows that repeat an id and its text leave one."""
    groups = staged(content_groups(docs).select(F.lower(F.hex("digest")).alias("__text"), F.col("chars").alias("__chars"), F.col("keep_id").alias("__keep_id"), F.col("twins").alias("__twins")), "groups")
    text = F.coalesce("text", F.lit(""))
    # Ids may be null or used again, so a row is known by its content and length too.
    rows = docs.withColumns({"__own_text": F.sha2(F.translate(text, BLANKS.decode(), "").cast("binary"), 256), "__own_chars": F.length(text).cast("long")})
    stay = rows.join(groups, F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__own_text") == F.col("__text")) & (F.col("__own_chars") == F.col("__chars")))
    once = stay.filter("__twins = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
    if groups.filter("__twins > 1").isEmpty():
        return once
    return once.unionByName(stay.filter("__twins > 1").dropDuplicates(["__keep_id", "__text"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
