"""Parsing of answers that describe graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.text import trim

RISKS = ["low", "medium", "high"]


def parse_enrichment(responses: DataFrame, depth: str, enriched_at: Column) -> DataFrame:
    """Enrichment rows of answers (repo, node_id, response).

    Code fences are stripped; a field of the wrong type is left out, a semantic edge must have all three texts, and an
    answer that is no JSON gives a row with nothing but its id.  Shallow answers carry purpose and summary only.
    """
    clean = trim(F.regexp_replace(F.regexp_replace("response", r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    doc = F.try_parse_json(clean)
    told = responses.withColumn("_doc", doc)

    def text_at(path, source="_doc"):
        value = F.try_variant_get(source, path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(source, path, "string"))

    edges = F.filter(
        F.transform(
            F.try_variant_get("_doc", "$.semanticEdges", "array<variant>"),
            lambda e: F.struct(*[
                F.when(F.schema_of_variant(F.try_variant_get(e, f"$.{f}", "variant")) == "STRING", F.try_variant_get(e, f"$.{f}", "string")).alias(f)
                for f in ("target", "type", "reason")
            ]),
        ),
        lambda e: e["target"].isNotNull() & e["type"].isNotNull() & e["reason"].isNotNull(),
    )
    deep = F.lit(depth == "deep")
    risk = text_at("$.risk")
    return told.select(
        "repo", "node_id", text_at("$.purpose").alias("purpose"), F.when(deep, text_at("$.pattern")).alias("pattern"),
        F.when(deep, text_at("$.domain")).alias("domain"), F.when(deep & risk.isin(RISKS), risk).alias("risk"),
        text_at("$.summary").alias("summary"), F.when(deep, edges).alias("semantic_edges"),
        enriched_at.alias("enriched_at"), F.lit(depth).alias("depth"),
    )
