"""From raw documents to a training mix, in stages; each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeatlas.llm import language_id, line_dedup, minhash, mixing
from codeatlas.llm.decontamination import decontaminate as drop_contaminated
from codeatlas.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language."""
    return language_id.drop_unidentified(docs, F.lit(True))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    cleaned = line_dedup.drop_site_lines(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its shingles of five words."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

# The first stage's learned labels have no SQL; tests/llm compares all stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else cut(docs), sf_dir)
    return docs
