"""Prepare a training corpus: each stage works on all that the one before kept.

Quality classifier, exact dedup, MinHash near-dedup, mixing to target weights, byte-level BPE. All stages but the last
return the columns of documents; the last returns a row for each mixed document with its token ids.

Every stage takes null texts, ids and sources, empty and very long texts, repeated rows and an empty table, and passes
other columns through, whatever their names: null and empty texts have weight 1 and stay as one row of their text, rows
with a null id are near copies of nothing, a null source is mixed as a source of its own, and a text without tokens gets
an empty list of ids. An empty table gives an empty result at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm import bpe, dedup, mixing, neardup, quality
from evspark.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance weights reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    return neardup.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources weigh 5, 2, 1, repeating."""
    return mixing.mixed_rows(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, checked by decoding them."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    # executors that have run the stages before have less memory left
    coded = bpe.encode(docs, vocab, with_ids=True, known=40_000, arcs=250_000)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.col("ids").alias("token_ids"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]

#: Importance weights, MinHash and BPE are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
