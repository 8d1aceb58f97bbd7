"""IQR and z-score outlier flags, their counts, tails and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilekit.functions.expressions import literal
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import base_of_flags, numeric_columns
from profilekit.runtime import col

IQR_PREFIX = "iqr_out_"
Z_PREFIX = "zscore_out_"


class OutlierModel(Fitted):
    """Column-wise bounds: below ``low`` is the lower tail, above ``high`` the upper tail, both strict."""

    method: str
    prefix: str
    columns: list[str]

    def lower(self, name: str) -> Column:
        raise NotImplementedError

    def upper(self, name: str) -> Column:
        raise NotImplementedError

    def flag(self, name: str) -> Column:
        return F.coalesce(self.lower(name) | self.upper(name), F.lit(False))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({self.prefix + c: self.flag(c).cast("int") for c in self.columns})

    def counts(self, df: DataFrame) -> DataFrame:
        """``(method, variable, outliers, lower, upper)``, all columns in one aggregation."""
        return outlier_counts(df, [self])

    def tails(self, df: DataFrame, key: str) -> DataFrame:
        """``(key, variable, value, tail)`` for every cell outside the bounds."""
        cells = F.array(
            *[
                F.struct(
                    F.lit(c).alias("variable"),
                    col(c).cast("double").alias("value"),
                    F.when(self.lower(c), "lower").when(self.upper(c), "upper").alias("tail"),
                )
                for c in self.columns
            ]
        )
        return (
            df.select(col(key), F.inline(F.filter(cells, lambda s: s["tail"].isNotNull())))
        )


def outlier_counts(df: DataFrame, models: Sequence[OutlierModel]) -> DataFrame:
    """``(method, variable, outliers, lower, upper)`` of several models over one scan."""
    cells = [(m, c) for m in models for c in m.columns]
    aggregates = []
    for i, (m, c) in enumerate(cells):
        aggregates += [F.count_if(m.lower(c)).alias(f"l{i}"), F.count_if(m.upper(c)).alias(f"u{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(m.method).alias("method"), F.lit(c).alias("variable"),
                (F.col(f"l{i}") + F.col(f"u{i}")).alias("outliers"),
                F.col(f"l{i}").alias("lower"), F.col(f"u{i}").alias("upper"),
            )
            for i, (m, c) in enumerate(cells)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


class IqrModel(OutlierModel):
    method = "IQR"

    def __init__(self, quartiles: dict[str, tuple[float | None, float | None]], multiplier: float, prefix: str):
        super().__init__()
        self.columns = list(quartiles)
        self.multiplier = multiplier
        self.prefix = prefix
        self.bounds = {}
        for c, (q1, q3) in quartiles.items():
            spread = None if q1 is None else q3 - q1
            low = None if q1 is None else q1 - multiplier * spread
            high = None if q1 is None else q3 + multiplier * spread
            self.bounds[c] = (q1, q3, spread, low, high)

    def lower(self, name: str) -> Column:
        return col(name) < literal(self.bounds[name][3])

    def upper(self, name: str) -> Column:
        return col(name) > literal(self.bounds[name][4])

    def bounds_table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(c, *b) for c, b in self.bounds.items()],
            "variable string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double",
        )


class IqrDetector(Learner):
    """Quartile fences; ``multiplier`` times the interquartile range on each side.

    Quartiles are exact unless ``accuracy`` asks for a one-scan approximation.
    """

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        multiplier: float = 1.5,
        prefix: str = IQR_PREFIX,
        accuracy: int | None = None,
    ):
        super().__init__()
        self.columns, self.multiplier, self.prefix, self.accuracy = columns, multiplier, prefix, accuracy

    def _fit(self, dataset: DataFrame) -> IqrModel:
        columns = list(self.columns) if self.columns is not None else numeric_columns(dataset)
        quartiles = column_quantiles(dataset, {c: col(c) for c in columns}, [0.25, 0.75], accuracy=self.accuracy)
        return IqrModel({c: (q[0], q[1]) for c, q in quartiles.items()}, self.multiplier, self.prefix)


class ZScoreModel(OutlierModel):
    method = "Z-Score"

    def __init__(self, moments: dict[str, tuple[float | None, float | None]], threshold: float, prefix: str):
        super().__init__()
        self.columns = list(moments)
        self.moments, self.threshold, self.prefix = moments, threshold, prefix

    def score(self, name: str) -> Column:
        mean, std = self.moments[name]
        return F.try_divide(col(name) - literal(mean), literal(std))

    def lower(self, name: str) -> Column:
        return self.score(name) < -float(self.threshold)

    def upper(self, name: str) -> Column:
        return self.score(name) > float(self.threshold)


class ZScoreDetector(Learner):
    """Distance from the mean in population standard deviations; a constant column has no outliers."""

    def __init__(self, columns: Sequence[str] | None = None, threshold: float = 3.0, prefix: str = Z_PREFIX):
        super().__init__()
        self.columns, self.threshold, self.prefix = columns, threshold, prefix

    def _fit(self, dataset: DataFrame) -> ZScoreModel:
        columns = list(self.columns) if self.columns is not None else numeric_columns(dataset)
        moments = column_moments(dataset, {c: col(c) for c in columns})
        return ZScoreModel(
            {c: (m.mean, None if m.constant else m.std_pop) for c, m in moments.items()}, self.threshold, self.prefix
        )


def outlier_summary(df: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``(column, method, outlier_count, outlier_pct)`` from the flag columns present in ``df``."""
    prefixes = prefixes or {"IQR": IQR_PREFIX, "Z-Score": Z_PREFIX}
    flags = [(m, c, p + c) for m, p in prefixes.items() for c in base_of_flags(df, p)]
    totals = df.agg(F.count("*").alias("n"), *[F.sum(col(f)).alias(f"s{i}") for i, (_, _, f) in enumerate(flags)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"), F.col(f"s{i}").alias("outlier_count"))
            for i, (m, c, _) in enumerate(flags)
        ]
    )
    return totals.select("n", F.inline(rows)).select(
        "column", "method", "outlier_count",
        (F.try_divide(F.col("outlier_count"), F.col("n")) * 100).alias("outlier_pct"),
    )


def method_comparison(df: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """One row per variable with the flag count of each method side by side."""
    prefixes = prefixes or {"iqr_outliers": IQR_PREFIX, "zscore_outliers": Z_PREFIX}
    summary = outlier_summary(df, prefixes)
    return summary.groupBy(F.col("column").alias("variable")).agg(
        *[F.max(F.when(F.col("method") == m, F.col("outlier_count"))).alias(m) for m in prefixes]
    )


def outlier_report(counts: DataFrame, top: int = 10) -> DataFrame:
    """Totals per method and the ``top`` columns with most outliers, in one long table."""
    totals = counts.groupBy("method").agg(
        F.sum("outliers").alias("outliers"), F.sum("lower").alias("lower"), F.sum("upper").alias("upper")
    ).select("method", F.lit("total").alias("variable"), "outliers", "lower", "upper")
    return totals.unionByName(top_outlier_columns(counts, top))


def top_outlier_columns(counts: DataFrame, top: int = 10) -> DataFrame:
    order = Window.partitionBy("method").orderBy(F.desc("outliers"), "variable")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("rank")


def any_flag(df: DataFrame, prefix: str) -> Column:
    """True when a row carries at least one flag of the prefix."""
    return F.greatest(F.lit(0), F.lit(0), *[col(prefix + c) for c in base_of_flags(df, prefix)]) == 1


def flagged_keys(df: DataFrame, key: str, flag: Column) -> DataFrame:
    return df.where(flag).select(col(key))


def exclusive_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys flagged by ``a`` but not by ``b``."""
    return a.join(b, key, "left_anti")


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All flagged keys, distinct and sorted."""
    return a.select(col(key)).union(b.select(col(key))).distinct().orderBy(col(key))


def rows_of_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Full rows of the flagged keys."""
    return df.join(keys, key, "left_semi")
