"""Token counts from flat token files by a separator scan.

A flat token file is nothing but the token ids of one document after another, little endian, each document closed by an
end-of-document id.  It has no index and is cut into blocks of a fixed
size, so documents straddle blocks.  Each block is searched for separators in one vectorised pass that
leaves the gaps between them: the tokens before its first separator, those of each document inside, and
the tail behind its last.  A prefix scan over the blocks' summaries then gives each block the number of
documents closed before it and the tail it inherits.  The scan has two levels, blocks within chunks of
``CHUNK_BLOCKS`` and chunks within a file, so a file of any length is scanned in parallel.

``write_token_files`` makes such files from documents, one for each task in the shared folder; a list of the documents'
ids in file order is kept beside, as the ids are nowhere in the files.  A task that is lost writes another file, and only
the one of the task that ended is listed.  ``read_token_files`` takes existing ones.  Either way a block is read where it
is searched, by its offset, so no file and no payload passes through a table.

Ids take two bytes, or four in vocabularies beyond 65,536.  Defined cases: null counts as the empty text, which has no
tokens; tokens behind the last separator of a file make one more, unclosed document; a file whose length is no
multiple of an id's raises an error; an empty file has no documents.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, staged

BLOCK_BYTES = 1 << 18
CHUNK_BLOCKS = 4096
EOD = 50256  # the free id behind the vocabulary of 50,256


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def id_bytes(ranks: dict[bytes, int], eod: int) -> int:
    return 2 if max(eod, *ranks.values()) < 1 << 16 else 4


def block_gaps(payload: bytes, eod: int = EOD, width: int = 2) -> tuple[int, np.ndarray]:
    """Tokens in the block, and the places of its separators."""
    tokens = np.frombuffer(payload, f"<u{width}")
    return len(tokens), np.flatnonzero(tokens == eod)


def _located(uri: str):
    """The file system and the path of a URI, as Spark or Python writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri)))


def write_token_files(docs: DataFrame, vocabulary: str, pattern: str, eod: int = EOD) -> DataFrame:
    """Tokenises whole texts (tiktoken, no special tokens) into one flat file per task.

    Rows: file and length of each; and for each run of documents, with a null length, ids: the documents' ids in
    file order, the first of which is document number ``start``.
    """
    ranks = read_ranks(vocabulary)
    vocab, width = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), id_bytes(ranks, eod)
    folder = new_path(docs.sparkSession, "tokens")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pat = vocab.value
        encoder = tiktoken.Encoding("flat", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        schema = pa.schema([("file", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])
        store, home = _located(folder)
        store.create_dir(home, recursive=True)
        name, number, length = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.tok", 0, 0
        with store.open_output_stream(f"{home}/{name}") as out:
            for batch in batches:
                for text in batch.column("text"):
                    tokens = encoder.encode_ordinary(text.as_py() or "")
                    tokens.append(eod)
                    length += out.write(np.array(tokens, f"<u{width}").tobytes())
                if batch.num_rows:
                    yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "start": number, "ids": batch.column("doc_id").to_pylist()}], schema)
                    number += batch.num_rows
        yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "length": length}], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(tokenised, "file string, length long, start long, ids array<long>"), "tokens")


def blocks_of(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of files (file, length): file, block, offset, size; neighbours stay together."""
    last = F.ceil(F.col("length") / block_bytes) - 1
    blocks = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")).withColumn("offset", F.col("block") * block_bytes)
    blocks = blocks.select("file", "block", "offset", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")).alias("size"))
    return blocks.repartition("file", F.floor(F.col("block") / 64)).sortWithinPartitions("file", "block")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of existing flat files; only their names and lengths are read here."""
    return blocks_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length"), block_bytes)


def count_tokens(blocks: DataFrame, eod: int = EOD, width: int = 2) -> DataFrame:
    """Of each document of the blocks: file, number (its place in the file, from 0), n_tokens and closed (false for
    tokens behind the last separator)."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            found = []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size"))):
                if file != name:
                    if handle:
                        handle.close()
                    store, place = _located(file)
                    name, handle = file, store.open_input_file(place)
                found.append(block_gaps(handle.read_at(size, offset), eod, width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([n for n, _ in found], pa.int64()), pa.array([ends.tolist() for _, ends in found], pa.list_(pa.int32()))],
                ["file", "block", "tokens", "ends"],
            )
        if handle:
            handle.close()

    gaps = staged(blocks.select("file", "block", "offset", "size").mapInArrow(searched, "file string, block long, tokens long, ends array<int>"), "gaps")
    summary = gaps.select(
        "file", "block", (F.col("block") / CHUNK_BLOCKS).cast("long").alias("chunk"), F.size("ends").cast("long").alias("closed"),
        F.col("tokens"), F.when(F.size("ends") > 0, F.col("tokens") - F.try_element_at("ends", F.lit(-1)) - 1).alias("tail"),
    )
    # A block without a separator lengthens the tail before it; the sum of tokens and the last tail's place carry that.
    in_chunk = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    local = summary.withColumn("sum_tokens", F.sum("tokens").over(upto)).withColumn("mark", F.when(F.col("tail").isNotNull(), F.col("sum_tokens") - F.col("tail")))
    local = local.select(
        "file", "block", "chunk", "closed", "tokens",
        F.coalesce(F.sum("closed").over(in_chunk), F.lit(0)).alias("closed_before"),
        F.coalesce(F.sum("tokens").over(in_chunk), F.lit(0)).alias("tokens_before"),
        F.last("mark", ignorenulls=True).over(in_chunk).alias("mark_before"), "mark",
    )
    chunks = local.groupBy("file", "chunk").agg(F.sum("closed").alias("closed"), F.sum("tokens").alias("tokens"), F.max("mark").alias("mark"))
    above = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    above_upto = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = chunks.withColumn("start", F.sum("tokens").over(above_upto) - F.col("tokens")).select(
        "file", "chunk", "start", F.coalesce(F.sum("closed").over(above), F.lit(0)).alias("closed_above"),
        F.coalesce(F.last(F.col("start") + F.col("mark"), ignorenulls=True).over(above), F.lit(0)).alias("mark_above"),
    )
    carry = local.join(chunks, ["file", "chunk"]).select(
        "file", "block", (F.col("closed_above") + F.col("closed_before")).alias("first"),
        (F.col("start") + F.col("tokens_before") - F.coalesce(F.col("start") + F.col("mark_before"), F.col("mark_above"))).alias("carry"),
    )
    ends = F.concat(F.array(F.lit(-1)), F.col("ends"))
    lengths = F.transform("ends", lambda end, i: (end - F.get(ends, i) - 1).cast("long"))
    stitched = gaps.join(carry, ["file", "block"])
    closed = stitched.select("file", "first", "carry", F.posexplode(lengths).alias("n", "length")).select(
        "file", (F.col("first") + F.col("n")).alias("number"), (F.col("length") + F.when(F.col("n") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed")
    )
    total = stitched.groupBy("file").agg(
        F.max_by(F.struct((F.col("first") + F.size("ends")).alias("number"), F.when(F.size("ends") > 0, F.col("tokens") - F.try_element_at("ends", F.lit(-1)) - 1).otherwise(F.col("carry") + F.col("tokens")).alias("n_tokens")), "block").alias("last")
    )
    unclosed = total.filter("last.n_tokens > 0").select("file", F.col("last.number").alias("number"), F.col("last.n_tokens").alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(unclosed)


def count_document_tokens(docs: DataFrame, vocabulary: str, pattern: str, eod: int = EOD) -> DataFrame:
    """Of each document: doc_id and n_tokens, by way of flat token files."""
    written = write_token_files(docs, vocabulary, pattern, eod)
    blocks = blocks_of(written.filter("length is not null").select("file", "length"))
    counts = count_tokens(blocks, eod, id_bytes(read_ranks(vocabulary), eod)).select("file", "number", "n_tokens")
    ids = written.filter("ids is not null").select("file", "start", F.posexplode("ids").alias("n", "doc_id"))
    return ids.withColumn("number", F.col("start") + F.col("n")).join(counts, ["file", "number"]).select("doc_id", "n_tokens")
