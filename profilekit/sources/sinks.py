"""Sinks. Writers are distributed; only result tables of a few rows are written as one JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from profilekit.runtime import col


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    return write_table(df, path, "csv", mode)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Table bucketed and sorted by the key, so later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def split_by_type(
    df: DataFrame, categorical: Sequence[str], numerical: Sequence[str], key: str | None = None
) -> dict[str, DataFrame]:
    """The categorical, numerical and combined projections, each with the key."""
    def part(columns: Sequence[str]) -> DataFrame:
        ids = [key] if key else []
        return df.select(*[col(c) for c in [*ids, *[c for c in columns if c != key]]])

    return {"categorical": part(categorical), "numerical": part(numerical), "imputed_data": df}


def write_split(
    df: DataFrame,
    categorical: Sequence[str],
    numerical: Sequence[str],
    folder: str,
    key: str | None = None,
    format: str = "parquet",
) -> dict[str, str]:
    parts = split_by_type(df, categorical, numerical, key)
    return {name: write_table(part, f"{folder}/{name}", format) for name, part in parts.items()}


def write_json(df: DataFrame, path: str) -> str:
    return write_table(df, path, "json")


def write_manifest(spark: SparkSession, manifest: Mapping, path: str) -> str:
    """One JSON object, for manifests and parameters that are a few kilobytes."""
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def column_lists(spark: SparkSession, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(list_name, pos, column)`` for named column lists."""
    rows = [(name, i, c) for name, columns in lists.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "list_name string, pos int, column string")


def transformed_column_lists(numeric: DataFrame, encoded_columns: Sequence[str], key: str, prefix: str = "yeo_joh_") -> dict:
    """Base columns, and transformed columns followed by the encoded ones."""
    names = [c for c in numeric.columns if c != key]
    return {
        "base_columns": [c for c in names if not c.startswith(prefix)],
        "yeo_columns": [c for c in names if c.startswith(prefix)] + list(encoded_columns),
    }
