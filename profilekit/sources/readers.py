"""Scans. NaN becomes null on the way in, so one kind of missing value is left."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from profilekit.operators.schema import null_if_nan


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header. Inference costs a pass over the file; give a schema for large input."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return null_if_nan(reader.csv(path))


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Parquet, CSV or JSON by ``format`` or by the ending of the path."""
    kind = format or next((k for k in ("csv", "json") if path.rstrip("/").endswith("." + k)), "parquet")
    if kind == "csv":
        return read_csv(spark, path, **options)
    return null_if_nan(spark.read.format(kind).options(**options).load(path))


def read_keyed(spark: SparkSession, path: str, key: str, **options) -> DataFrame:
    """Scan whose row key is a named column; it is checked to exist and put first."""
    df = read_table(spark, path, **options)
    if key not in df.columns:
        raise ValueError(f"key column {key} is not in {path}")
    return df.select(key, *[c for c in df.columns if c != key])


def read_first(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The first path that exists."""
    for path in paths:
        try:
            return read_table(spark, path, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these exists: {list(paths)}")


def read_params(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A small JSON object with parameters or column lists; ``default`` when the file is absent."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND" and default is not None:
            return default
        raise
    return json.loads(text[0])
