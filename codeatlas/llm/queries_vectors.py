"""Query of the whitening operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm.registry import query, table
from codeatlas.llm.whitening import apply_whitening, fit_whitening, whole_vectors

COMPONENTS = 4


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding along the four directions that explain most, with unit variance over the distinct vectors."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return apply_whitening(vectors, fit_whitening(vectors, COMPONENTS))
