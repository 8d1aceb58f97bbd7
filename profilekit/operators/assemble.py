"""Feature tables joined on the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilekit.config import IDENTIFIERS
from profilekit.operators.encode import OneHot
from profilekit.operators.schema import assert_no_target, columns_with_prefix, drop_columns
from profilekit.runtime import col

YEO = "yeo_joh_"
NUMBER = "__number_in_key"


def require_unique_key(df: DataFrame, key: str, name: str = "table") -> None:
    """Raise now when a key occurs twice; duplicates would multiply rows in a join."""
    twice = df.groupBy(col(key)).agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{name}: key {key} is not unique, for example {twice[0][0]!r}")


def _one_row_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, failing when it is computed if a key occurs twice.

    Rows are numbered within their key after the shuffle and sort that the join on the key needs anyway.
    """
    number = F.row_number().over(Window.partitionBy(col(key)).orderBy(col(key)))
    message = F.concat(F.lit(f"{name}: key {key} is not unique, for example "), F.coalesce(col(key).cast("string"), F.lit("null")))
    once = F.when(F.col(NUMBER) > 1, F.raise_error(message).cast("boolean")).otherwise(True)
    return df.withColumn(NUMBER, number).where(once).drop(NUMBER)


def join_features(left: DataFrame, right: DataFrame, key: str, check_keys: bool = True) -> DataFrame:
    """Inner join of two feature tables on the key; the key column comes first.

    No broadcast hint: feature tables have one row per key and grow with the
    data. Tables written with :func:`profilekit.sources.sinks.write_bucketed`
    on the key join without a shuffle. The check of the keys takes no shuffle
    of its own.
    """
    if check_keys:
        left, right = _one_row_per_key(left, key, "left table"), _one_row_per_key(right, key, "right table")
    return left.join(right, key, "inner")


def attach_columns(base: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Add or replace columns of ``base`` by those of ``other`` with the same key; absent keys get nulls.

    Only needed when ``other`` does not come from ``base``; transforms of the
    same frame are chained instead, which takes no join.
    """
    kept = [col(c) for c in base.columns if c not in columns]
    return base.select(*kept).join(other.select(col(key), *[col(c) for c in columns]), key, "left")


def encoded_table(
    df: DataFrame, key: str, dropped: Sequence[str] = IDENTIFIERS, drop_first: bool = True, output: str = "dense"
) -> DataFrame:
    """One-hot table of all categorical columns, identifiers left out."""
    kept = drop_columns(df, dropped)
    return OneHot(exclude=[key], drop_first=drop_first, output=output).fit_transform(kept)


def _numerical(df: DataFrame, target: str | None) -> DataFrame:
    return drop_columns(df, [target] if target else [])


def _transformed(df: DataFrame, key: str, target: str | None, prefix: str = YEO) -> DataFrame:
    kept = [c for c in columns_with_prefix(df, prefix) if c != f"{prefix}{target}"]
    return df.select(col(key), *[col(c) for c in kept])


def _guarded(df: DataFrame, target: str | None) -> DataFrame:
    return assert_no_target(df, target) if target else df


def ml_table(
    transformed: DataFrame, encoded: DataFrame, key: str, target: str | None = None, check_keys: bool = True
) -> DataFrame:
    """Transformed numerical columns with the one-hot columns."""
    return _guarded(join_features(_transformed(transformed, key, target), encoded, key, check_keys), target)


def linear_table(
    numerical: DataFrame,
    transformed: DataFrame,
    encoded: DataFrame,
    key: str,
    target: str | None = None,
    check_keys: bool = True,
) -> DataFrame:
    """Original numerical, transformed numerical and one-hot columns; not standardised."""
    both = join_features(_numerical(numerical, target), _transformed(transformed, key, target), key, check_keys)
    if check_keys:
        encoded = _one_row_per_key(encoded, key, "encoded table")
    return _guarded(join_features(both, encoded, key, False), target)


def tree_table(
    numerical: DataFrame,
    transformed: DataFrame,
    categorical: DataFrame,
    key: str,
    target: str | None = None,
    dropped: Sequence[str] = IDENTIFIERS,
    check_keys: bool = True,
) -> DataFrame:
    """Original numerical, transformed numerical and native categorical columns without identifiers."""
    return linear_table(numerical, transformed, drop_columns(categorical, dropped), key, target, check_keys)


def target_extract(df: DataFrame, key: str, target: str) -> DataFrame:
    return df.select(col(key), col(target))
