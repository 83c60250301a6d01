"""Documents to tokens: low-quality texts go, then near copies, repeated passages and benchmark items; the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestwright.llm import byte_bpe, decontamination, ngram_jaccard, quality, suffix_dedup
from nestwright.llm.common import small_batches, stash

#: A passage counts as repeated here from so many bytes, whatever its words, or so many words, however short.
PASSAGE, WORDS = suffix_dedup.LENGTH, suffix_dedup.WORDS


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling selects."""
    small_batches(spark)
    return quality.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group that links join."""
    small_batches(spark)
    return ngram_jaccard.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of PASSAGE bytes or of WORDS words or more that stand in more places than one out of the texts."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs, PASSAGE, WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that overlap no benchmark item."""
    small_batches(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number, and whether decoding them gives the text back."""
    small_batches(spark)
    import public_tokenizers

    return byte_bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
