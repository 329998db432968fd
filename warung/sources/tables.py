"""Readers for the source tables (one parquet data set per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy parquet read; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(root, name))


def read_sources(spark: SparkSession, root: str,
                 names=("part", "orders", "lineitem", "events")) -> dict[str, DataFrame]:
    return {n: read_table(spark, root, n) for n in names}
