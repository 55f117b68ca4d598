"""Queries of the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeatlas.llm import language_id, quality_rules, toxicity
from codeatlas.llm.html_extraction import extract_main_text
from codeatlas.llm.registry import query, table


def id_fold(parts: int):
    """Remainder of the CRC-32 of a document's id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, id_fold(4) != 2)
    return language_id.identify(docs, model, ["doc_id"]).select("doc_id", F.coalesce(id_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_fold(3) != 1)
    return toxicity.score_texts(docs, net, ["doc_id"]).select("doc_id", F.coalesce(id_fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the lines of content suffice to keep it."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.rate(docs, model, ["doc_id"])


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
