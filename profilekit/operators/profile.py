"""Distribution profiles of columns: quartiles, boxes, histograms, variance, types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.functions.expressions import gaussian, literal
from profilekit.operators.moments import column_moments
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import categorical_columns, numeric_columns
from profilekit.runtime import col


def _long_row(df_row: DataFrame, names: Sequence[str], fields: Mapping[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Turn one wide aggregate row into a row per name; ``fields`` maps output field -> column prefix."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("variable"), *[F.col(f"{p}{i}").alias(f) for f, p in fields.items()])
            for i, n in enumerate(names)
        ]
    )
    return df_row.select(*keep, F.inline(rows))


def top_variance(df: DataFrame, columns: Sequence[str] | None = None, k: int = 15) -> DataFrame:
    """``(variable, variance)`` with the ``k`` largest sample variances."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    row = df.agg(*[F.var_samp(col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    return _long_row(row, columns, {"variance": "v"}).orderBy(F.desc_nulls_last("variance"), "variable").limit(k)


def distribution_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population std, median and the marks one std either side of the mean."""
    exprs = {c: col(c) for c in columns}
    moments = column_moments(df, exprs)
    medians = column_quantiles(df, exprs, [0.5])
    rows = []
    for c in columns:
        m = moments[c]
        known = m.mean is not None
        rows.append(
            (c, m.mean, m.std_pop, medians[c][0], m.mean - m.std_pop if known else None, m.mean + m.std_pop if known else None)
        )
    return df.sparkSession.createDataFrame(
        rows, "variable string, mean double, std double, median double, minus_std double, plus_std double"
    )


def before_after(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Mean and sample std of each original column and its transformed column."""
    aggregates = []
    for i, (a, b) in enumerate(pairs.items()):
        aggregates += [
            F.avg(col(a)).alias(f"om{i}"), F.stddev_samp(col(a)).alias(f"os{i}"),
            F.avg(col(b)).alias(f"tm{i}"), F.stddev_samp(col(b)).alias(f"ts{i}"),
        ]
    fields = {"original_mean": "om", "original_std": "os", "transformed_mean": "tm", "transformed_std": "ts"}
    return _long_row(df.agg(*aggregates), list(pairs), fields)


def target_summary(df: DataFrame, target: str) -> DataFrame:
    value = col(target)
    return df.agg(
        F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.count(value).alias("count"),
    )


def box_stats(df: DataFrame, exprs: Mapping[str, Column] | Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (most extreme values within the fences), fliers and the median notch."""
    if not isinstance(exprs, Mapping):
        exprs = {c: col(c) for c in exprs}
    names = list(exprs)
    quartiles = column_quantiles(df, exprs, [0.25, 0.5, 0.75])
    aggregates = [F.count(e).alias(f"n{i}") for i, e in enumerate(exprs.values())]
    for i, (n, e) in enumerate(exprs.items()):
        q1, _, q3 = quartiles[n]
        spread = None if q1 is None else multiplier * (q3 - q1)
        low = literal(None if q1 is None else q1 - spread)
        high = literal(None if q1 is None else q3 + spread)
        inside = (e >= low) & (e <= high)
        aggregates += [
            F.min(F.when(inside, e.cast("double"))).alias(f"wl{i}"),
            F.max(F.when(inside, e.cast("double"))).alias(f"wh{i}"),
            F.count_if(~inside).alias(f"f{i}"),
        ]
    row = _long_row(
        df.agg(*aggregates), names, {"count": "n", "whisker_low": "wl", "whisker_high": "wh", "fliers": "f"}
    )
    marks = F.create_map(
        *[x for n in names for x in (F.lit(n), F.array(*[literal(q) for q in quartiles[n]]))]
    )[F.col("variable")]
    q1, median, q3 = marks[0], marks[1], marks[2]
    # Fixed value: 1.57, the usual constant of box-plot notches.
    notch = 1.57 * (q3 - q1) / F.sqrt(F.nullif(F.col("count"), F.lit(0)))
    return row.select(
        "variable", "count", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        "whisker_low", "whisker_high", "fliers", (median - notch).alias("notch_low"), (median + notch).alias("notch_high"),
    )


def histogram(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], bins: int = 30) -> DataFrame:
    """``(variable, bin, bin_start, bin_center, count, density)`` for non-empty equal-width bins.

    The last bin includes the maximum. A constant column gets a range of one
    around its value.
    """
    if not isinstance(columns, Mapping):
        columns = {c: col(c) for c in columns}
    moments = column_moments(df, columns)
    cells = []
    for n, e in columns.items():
        m = moments[n]
        if m.count == 0:
            continue
        low, high = (m.minimum - 0.5, m.maximum + 0.5) if m.constant else (m.minimum, m.maximum)
        width = (high - low) / bins
        slot = F.floor((e.cast("double") - low) / width)
        bin_no = F.when(slot.isNotNull(), F.least(slot, F.lit(bins - 1))).cast("int")
        cells.append(
            F.struct(
                F.lit(n).alias("variable"), bin_no.alias("bin"), F.lit(low).alias("low"),
                F.lit(width).alias("width"), F.lit(m.count).cast("long").alias("total"),
            )
        )
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "variable string, bin int, bin_start double, bin_center double, count bigint, density double"
        )
    counted = (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("bin").isNotNull())
        .groupBy("variable", "bin", "low", "width", "total")
        .agg(F.count("*").alias("count"))
    )
    return counted.select(
        "variable", "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 0.5) * F.col("width")).alias("bin_center"),
        "count",
        (F.col("count") / (F.col("total") * F.col("width"))).alias("density"),
    )


def gaussian_overlay(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histogram density of a column next to the normal density of its mean and population std."""
    m = column_moments(df, {column: col(column)})[column]
    return histogram(df, [column], bins).select(
        "variable", "bin", "bin_center", "density",
        gaussian(F.col("bin_center"), literal(m.mean), literal(m.std_pop)).alias("gaussian"),
    )


def category_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(variable, categories)``: distinct non-null values per column."""
    columns = list(columns) if columns is not None else categorical_columns(df)
    distinct = df.select(*[col(c) for c in columns]).unpivot([], [col(c) for c in columns], "variable", "value").distinct()
    return distinct.groupBy("variable").agg(F.count("value").alias("categories"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """``(dtype, columns)`` from the schema."""
    counts: dict[str, int] = {}
    for _, dtype in df.dtypes:
        counts[dtype] = counts.get(dtype, 0) + 1
    rows = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return df.sparkSession.createDataFrame(rows, "dtype string, columns bigint")


def size_profile(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` columns with most bytes: text by its length, other types by width times non-null count."""
    aggregates = []
    for i, f in enumerate(df.schema):
        c = col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.sum(F.octet_length(c).cast("long"))
        else:
            size = F.count(c) * TYPE_WIDTHS.get(f.dataType.typeName(), 8)
        aggregates.append(F.coalesce(size, F.lit(0)).cast("long").alias(f"b{i}"))
    return _long_row(df.agg(*aggregates), df.columns, {"bytes": "b"}).orderBy(F.desc("bytes"), "variable").limit(k)


# Bytes per value of the fixed-width types; everything else counts as 8.
TYPE_WIDTHS = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8}


def flagged_non_null_counts(df: DataFrame, flag: str, columns: Sequence[str], value: int = 1) -> DataFrame:
    """``(variable, outliers)``: non-null cells of each column among the flagged rows."""
    chosen = col(flag) == value
    row = df.agg(*[F.count(F.when(chosen, col(c))).alias(f"c{i}") for i, c in enumerate(columns)])
    return _long_row(row, list(columns), {"outliers": "c"})
