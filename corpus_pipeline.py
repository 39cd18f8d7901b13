"""From raw documents to token ids, in five stages.

Each stage takes the documents that the one before it kept (columns doc_id,
text, lang, source, n_chars) and all of its decisions take effect: documents in
no learned language go, one document of each near-duplicate class stays, windows
of words found more than once are cut out, sources are mixed to their weights,
and what the mix takes, as often as it takes it, is encoded. A document is
known by its doc_id; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, langid, mixing, simhash, substring_dedup
from sluice.llm.common import bucket_of, kept, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts unlike every learned language."""
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 4) != 2))
    return langid.in_known_language(docs, model, min_score=0.1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each SimHash class."""
    return simhash.near_dedup(docs, shingle=4, radius=4)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out words in repeated windows of 35; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs, window=35).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to meet the sources' target weights."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and digests of the ids and the decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the string kernels, XXH64, the knapsack or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
