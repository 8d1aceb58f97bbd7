"""Column discovery, type normalisation, selection and guards."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.runtime import col

FLOATING = (T.DoubleType, T.FloatType)
WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)

# Name fragments that mark ratio-like columns.
INTERACTION_KEYWORDS = ("ratio", "return", "margin", "yield", "growth")
POLYNOMIAL_KEYWORDS = ("ratio", "return", "margin", "yield")


def null_if_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, so one kind of missing value is left."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATING)}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def normalise_types(df: DataFrame) -> DataFrame:
    """NaN to null, and double columns that hold only whole numbers to bigint.

    One aggregation decides for all double columns at once.
    """
    df = null_if_nan(df)
    floats = [f.name for f in df.schema if isinstance(f.dataType, FLOATING)]
    if not floats:
        return df
    checks = [
        F.min((col(c) == F.floor(col(c))) & (F.abs(col(c)) < F.lit(2.0**53))).alias(f"w{i}")
        for i, c in enumerate(floats)
    ]
    row = df.agg(*checks).first()
    whole = {c for i, c in enumerate(floats) if row[f"w{i}"]}
    return df.select(*[col(c).cast("bigint").alias(c) if c in whole else col(c) for c in df.columns])


# Text that a type can hold without loss. A number must not start with a needless zero: such text is a code.
_NUMBER = r"^\s*[+-]?(0|[1-9][0-9]*|(?=\.[0-9]))"
_TEXT_TYPES = {
    "bigint": _NUMBER + r"\s*$",
    "double": _NUMBER + r"(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$",
    "boolean": r"^\s*(?i:true|false)\s*$",
    "date": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$",
    "timestamp": r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$",
}


def text_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """The narrowest type that holds every text of a string column, ``string`` where none does.

    One aggregation counts, for all columns and types at once, the texts that can be cast. The types are tried from
    ``bigint`` over ``double`` to ``boolean`` and from ``date`` to ``timestamp``. Blank text counts as missing; a column
    without text stays a string.
    """
    columns = list(columns) if columns is not None else categorical_columns(df)
    if not columns:
        return {}
    counts = []
    for i, c in enumerate(columns):
        text = F.when(F.trim(col(c)) != "", col(c))
        counts.append(F.count(text).alias(f"n{i}"))
        for name, pattern in _TEXT_TYPES.items():
            held = text.rlike(pattern) & F.trim(text).try_cast(name).isNotNull()
            counts.append(F.count_if(held).alias(f"{name}{i}"))
    row = df.agg(*counts).first()
    return {
        c: next((t for t in _TEXT_TYPES if row[f"n{i}"] and row[f"{t}{i}"] == row[f"n{i}"]), "string") for i, c in enumerate(columns)
    }


def type_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns cast to the types of :func:`text_types`; blank text of a cast column becomes null."""
    types = {c: t for c, t in text_types(df, columns).items() if t != "string"}
    return df.select(*[F.trim(col(c)).try_cast(types[c]).alias(c) if c in types else col(c) for c in df.columns])


def identifier_columns(df: DataFrame, columns: Sequence[str], share: float = 0.9) -> list[str]:
    """Columns whose number of values is above ``share`` of their rows, by one sketch of each column in one scan."""
    if not columns:
        return []
    sketches = [F.approx_count_distinct(col(c), 0.01).alias(f"d{i}") for i, c in enumerate(columns)]
    row = df.agg(*sketches, *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"n{i}"] > 1 and row[f"d{i}"] > share * row[f"n{i}"]]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def split_columns(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numerical): strings against everything else, booleans counted as numerical."""
    skip = set(exclude)
    strings = categorical_columns(df, skip)
    return strings, [c for c in df.columns if c not in strings and c not in skip]


def is_whole(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, WHOLE)


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def base_of_flags(df: DataFrame, prefix: str) -> list[str]:
    """Base columns behind ``prefix`` flag columns; only a leading prefix is stripped."""
    return [c[len(prefix):] for c in columns_with_prefix(df, prefix)]


def drop_columns(df: DataFrame, names: Iterable[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Drop by name or prefix; absent names are ignored."""
    gone = set(names)
    if prefixes:
        gone.update(columns_with_prefix(df, *prefixes))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def columns_with_keyword(names: Iterable[str], keywords: Sequence[str]) -> list[str]:
    return [c for c in names if any(k in c.lower() for k in keywords)]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def interleave_transformed(names: Sequence[str], prefix: str = "yeo_joh_") -> list[str]:
    """Each base column followed by its transformed column, when there is one."""
    transformed = {c[len(prefix):]: c for c in names if c.startswith(prefix)}
    bases = [c for c in names if not c.startswith(prefix)]
    return list(itertools.chain.from_iterable([b, transformed[b]] if b in transformed else [b] for b in bases))


def coerce_numeric(
    df: DataFrame, columns: Sequence[str], min_share: float = 0.5
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cast columns to double, unparsable text to null, and keep those mostly non-null.

    Returns the frame with the kept columns cast and the others dropped, the
    table ``(variable, share, kept)``, and the list of kept columns.
    """
    cast = {c: col(c).try_cast("double") for c in columns}
    cast = {c: F.when(~F.isnan(e), e) for c, e in cast.items()}
    row = df.agg(F.count("*").alias("n"), *[F.count(e).alias(f"c{i}") for i, e in enumerate(cast.values())]).first()
    shares = [(c, row[f"c{i}"] / row["n"] if row["n"] else 0.0) for i, c in enumerate(cast)]
    kept = [c for c, share in shares if share > min_share]
    report = df.sparkSession.createDataFrame(
        [(c, share, c in kept) for c, share in shares], "variable string, share double, kept boolean"
    )
    out = df.select(
        *[cast[c].alias(c) if c in cast else col(c) for c in df.columns if c not in cast or c in kept]
    )
    return out, report, kept


def flagged_rows(df: DataFrame, flag: str, value: int = 1) -> DataFrame:
    return df.where(col(flag) == value)


def complete_cases(df: DataFrame, variable: str) -> DataFrame:
    return df.where(col(variable).isNotNull())


def validate_frame(
    df: DataFrame,
    required: Iterable[str] = (),
    numeric: Iterable[str] = (),
    min_rows: int = 1,
) -> None:
    """Raise ValueError for absent or non-numeric columns or too few rows; reads at most ``min_rows`` rows."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    known = set(numeric_columns(df))
    wrong = [c for c in numeric if c not in known]
    if wrong:
        raise ValueError(f"columns are absent or not numeric: {wrong}")
    if min_rows > 0:
        found = df.limit(min_rows).count()
        if found < min_rows:
            raise ValueError(f"table has {found} rows, needs at least {min_rows}")


def assert_no_target(df: DataFrame, target: str, prefixes: Sequence[str] = ("yeo_joh_",)) -> DataFrame:
    """Fail when the target, or a transformed copy of it, is among the features."""
    leaked = [c for c in df.columns if c == target or c in {p + target for p in prefixes}]
    if leaked:
        raise ValueError(f"target leaks into the features: {leaked}")
    return df


def range_violations(df: DataFrame, target: str, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """One row: how many target values lie outside the range, with the extremes."""
    value = col(target)
    return df.agg(
        F.count_if((value < low) | (value > high)).alias("violations"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )
