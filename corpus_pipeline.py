"""The corpus pipeline: documents in, token digests out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last
return the columns of documents; the last returns the digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridra.llm.bpe import encode_digests
from veridra.llm.common import read, release, staged, written
from veridra.llm.exact_dedup import drop_duplicates
from veridra.llm.mixing import apply_mix
from veridra.llm.near_dedup import drop_near_duplicates
from veridra.llm.registry import MIX, vocabulary
from veridra.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels serve training only."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs, **MIX)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; a document that the mix repeats has a row each time."""
    return encode_digests(docs, *vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("tokenize", tokenize)]

#: The machine of the first stage and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents.  Once a stage's rows are written, the rows before them and all that the stage staged are deleted;
    what the last one reads stays until ``release`` is called."""
    docs, others = read(spark, sf_dir, "documents"), written()
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = staged(docs, name)
            release(spark, keep=others | {docs.staged_path})
    return docs
