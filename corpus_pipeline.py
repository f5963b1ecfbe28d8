"""The corpus pipeline: language identification, near-duplicate removal, substring deduplication, benchmark
decontamination, packing. Each stage works on all that the stage before kept; all but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, langid, near_dup, packing, paragraph_dedup
from lattica.llm.common import bundled, unbundled, written

#: A text goes if less than this share of its letter n-grams belongs to the best language's filter.
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or fit no learned language; learns from the rows of docs that have
    a lang and aren't held out. Other nulls, repeated rows and very long texts are kept as they are, ties between languages
    don't matter, an empty table stays empty. All columns keep their values, whatever their names."""
    filters = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    seen = langid.identify(bundled(docs, "doc_id", "text"), filters)
    return unbundled(seen.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)), docs.columns, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar ones stays, the one with the least doc_id (null ids come last, of
    repeated rows any one stays). Null texts are equal to empty ones; very long texts are compared whole; an empty
    table stays empty. All columns keep their values, whatever their names."""
    return near_dup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs are cut out of text; a document goes if nothing but them was in it. n_chars, where there is
    one, follows the text; all other columns keep their values, whatever their names. The first of equal or similar
    paragraphs stays (null ids come last). Null and empty texts stay as they are, very long ones are searched whole, an empty table
    stays empty."""
    cut = paragraph_dedup.cut_repeats(bundled(docs, "doc_id", "text"))
    left = cut.where((F.col("n_removed_words") < F.col("n_words")) | (F.col("n_removed_words") == 0))
    if "n_chars" in docs.columns:
        own = F.when(F.col("n_removed_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.n_chars"))
        left = left.withColumn("_rest", F.col("_rest").withField("n_chars", own))
    return unbundled(left, docs.columns, "doc_id", "text")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay, very long texts
    are searched whole, repeated rows share their fate, an empty table or benchmark is no error. All columns keep their
    values, whatever their names."""
    found = decontaminate.without_contamination(bundled(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unbundled(found, docs.columns, "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Length buckets and token-budget batches of what is left: see packing.pack, also for nulls, long texts, ties,
    repeated rows and empty tables. Other columns are left out, and so are the token ids."""
    import public_tokenizers

    return packing.pack(docs, vocabulary=str(public_tokenizers.path(vocabulary)), pattern=public_tokenizers.PATTERN).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Order min-hash, alignment and bucket planning are beyond SQL; tests hold the whole chain against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
