"""Conversion between header CSV and JSON tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "emptyValue": "", "nullValue": "\x00"}


def read_dataset(spark: SparkSession, path: str, fmt: str, schema: str | None = None) -> DataFrame:
    """Rows of a CSV file with a header (every cell a string, missing cells empty) or of a JSON table.

    Pass a schema for large inputs: it saves the pass that finds the columns.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        df = reader.options(**CSV_OPTIONS).csv(path)
        return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unknown format {fmt}")


def write_dataset(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        flat = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
        flat.write.options(header="true", escape='"', emptyValue="").csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def convert_dataset(
    spark: SparkSession, in_path: str, in_fmt: str, out_path: str, out_fmt: str, schema: str | None = None
) -> None:
    write_dataset(read_dataset(spark, in_path, in_fmt, schema), out_path, out_fmt)
