"""Treatment of flagged cells and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.functions.expressions import clip, literal
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import base_of_flags, columns_with_prefix, is_whole, numeric_columns
from profilekit.runtime import col

ROW_FLAG_COLUMNS = ("forest_outlier", "forest_outlier_tuned", "anomaly_score", "predicted_outlier")


def _flagged_columns(df: DataFrame, prefix: str, columns: Sequence[str] | None) -> list[str]:
    wanted = list(columns) if columns is not None else base_of_flags(df, prefix)
    return [c for c in wanted if c in df.columns and prefix + c in df.columns]


def _unflagged(prefix: str, name: str) -> Column:
    return F.when(col(prefix + name) == 0, col(name))


def trimmed_statistics(
    df: DataFrame, flag_prefix: str, columns: Sequence[str] | None = None, limits: tuple[float, float] = (0.05, 0.95)
) -> DataFrame:
    """``(variable, mean, median, p05, p95)`` over the unflagged cells of each column."""
    names = _flagged_columns(df, flag_prefix, columns)
    kept = {c: _unflagged(flag_prefix, c) for c in names}
    means = column_moments(df, kept)
    quantiles = column_quantiles(df, kept, [0.5, *limits])
    return df.sparkSession.createDataFrame(
        [(c, means[c].mean, *quantiles[c]) for c in names],
        "variable string, mean double, median double, p05 double, p95 double",
    )


class FillModel(Fitted):
    """Flagged cells get one number per column; the result column is double."""

    def __init__(self, values: dict[str, float | None], flag_prefix: str, output_prefix: str):
        super().__init__()
        self.values, self.flag_prefix, self.output_prefix = values, flag_prefix, output_prefix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {
                self.output_prefix + c: F.when(col(self.flag_prefix + c) == 1, literal(v)).otherwise(
                    col(c).cast("double")
                )
                for c, v in self.values.items()
            }
        )


class ClipModel(Fitted):
    """Clip to bounds: only flagged cells when a flag prefix is given, else the whole column."""

    def __init__(self, bounds: dict[str, tuple], flag_prefix: str | None, output_prefix: str):
        super().__init__()
        self.bounds, self.flag_prefix, self.output_prefix = bounds, flag_prefix, output_prefix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for c, (low, high) in self.bounds.items():
            value = col(c).cast("double")
            clipped = clip(value, low, high)
            if self.flag_prefix is not None:
                clipped = F.when(col(self.flag_prefix + c) == 1, clipped).otherwise(value)
            out[self.output_prefix + c] = clipped
        return dataset.withColumns(out)


class ReplaceFlagged(Learner):
    """Replace flagged cells by the ``mean`` or ``median`` of the unflagged cells of the column."""

    def __init__(
        self,
        flag_prefix: str,
        statistic: str = "mean",
        columns: Sequence[str] | None = None,
        output_prefix: str = "processed_",
    ):
        super().__init__()
        if statistic not in ("mean", "median"):
            raise ValueError(f"unknown statistic: {statistic}")
        self.flag_prefix, self.statistic = flag_prefix, statistic
        self.columns, self.output_prefix = columns, output_prefix

    def _fit(self, dataset: DataFrame) -> FillModel:
        columns = _flagged_columns(dataset, self.flag_prefix, self.columns)
        kept = {c: _unflagged(self.flag_prefix, c) for c in columns}
        if self.statistic == "mean":
            values = {c: m.mean for c, m in column_moments(dataset, kept).items()}
        else:
            values = {c: q[0] for c, q in column_quantiles(dataset, kept, [0.5]).items()}
        return FillModel(values, self.flag_prefix, self.output_prefix)


class Winsorize(Learner):
    """Clip to quantiles: of the unflagged cells for flagged cells, or of the whole column without flags."""

    def __init__(
        self,
        flag_prefix: str | None = None,
        columns: Sequence[str] | None = None,
        output_prefix: str = "winsorized_",
        limits: tuple[float, float] = (0.05, 0.95),
    ):
        super().__init__()
        self.flag_prefix, self.columns = flag_prefix, columns
        self.output_prefix, self.limits = output_prefix, limits

    def _fit(self, dataset: DataFrame) -> ClipModel:
        if self.flag_prefix is not None:
            columns = _flagged_columns(dataset, self.flag_prefix, self.columns)
            kept = {c: _unflagged(self.flag_prefix, c) for c in columns}
        else:
            wanted = list(self.columns) if self.columns is not None else numeric_columns(dataset)
            kept = {c: col(c) for c in wanted if c in dataset.columns}
        bounds = {c: tuple(q) for c, q in column_quantiles(dataset, kept, self.limits).items()}
        return ClipModel(bounds, self.flag_prefix, self.output_prefix)


def drop_flagged_rows(df: DataFrame, flag_prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without any flag; without flag columns the input is returned unchanged."""
    flags = [flag_prefix + c for c in _flagged_columns_any(df, flag_prefix, columns)]
    if not flags:
        return df
    return df.where(_flag_total(flags) == 0)


def trim_report(df: DataFrame, flag_prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(rows, removed, removed_pct)`` of :func:`drop_flagged_rows`."""
    flags = [flag_prefix + c for c in _flagged_columns_any(df, flag_prefix, columns)]
    removed = F.count_if(_flag_total(flags) > 0) if flags else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("rows"), removed.alias("removed")).withColumn(
        "removed_pct", F.try_divide(F.col("removed"), F.col("rows")) * 100
    )


def _flagged_columns_any(df: DataFrame, prefix: str, columns: Sequence[str] | None) -> list[str]:
    wanted = list(columns) if columns is not None else base_of_flags(df, prefix)
    return [c for c in wanted if prefix + c in df.columns]


def _flag_total(flags: list[str]) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + F.coalesce(col(f), F.lit(0))
    return total


class ColumnMeanModel(Fitted):
    """Write ``output_prefix`` copies in which the chosen cells hold the column mean."""

    def __init__(self, means: dict[str, float | None], whole: set[str], condition, output_prefix: str):
        super().__init__()
        self.means, self.whole, self.condition, self.output_prefix = means, whole, condition, output_prefix

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = {}
        for c, mean in self.means.items():
            chosen = self.condition(dataset, c)
            if chosen is None:
                out[self.output_prefix + c] = col(c)
                continue
            fill = literal(mean)
            if c in self.whole:
                # The mean is cut to a whole number, so the column keeps its type.
                fill = fill.cast("bigint").cast(dataset.schema[c].dataType)
            out[self.output_prefix + c] = F.when(chosen, fill).otherwise(col(c))
        return dataset.withColumns(out)


class MeanOfAllCells(Learner):
    """Replace flagged cells by the mean of **all** cells; whole-number columns get the truncated mean.

    With ``flag_prefix`` the cell flags decide; with ``row_flag`` every numeric
    cell of a flagged row is replaced and the mean is not truncated.
    """

    def __init__(
        self,
        flag_prefix: str | None = None,
        row_flag: str | None = None,
        row_flag_value: int = 1,
        output_prefix: str = "iqr_mod_",
        columns: Sequence[str] | None = None,
        exclude: Sequence[str] = (),
    ):
        super().__init__()
        if (flag_prefix is None) == (row_flag is None):
            raise ValueError("give either flag_prefix or row_flag")
        self.flag_prefix, self.row_flag, self.row_flag_value = flag_prefix, row_flag, row_flag_value
        self.output_prefix, self.columns, self.exclude = output_prefix, columns, exclude

    def _fit(self, dataset: DataFrame) -> ColumnMeanModel:
        if self.columns is not None:
            columns = list(self.columns)
        else:
            flags = columns_with_prefix(dataset, "iqr_out_", "zscore_out_", "forest_out_tuned_")
            skip = {*self.exclude, *ROW_FLAG_COLUMNS, *flags, "anomaly_score_tuned"}
            columns = numeric_columns(dataset, skip)
        means = {c: m.mean for c, m in column_moments(dataset, {c: col(c) for c in columns}).items()}
        if self.row_flag is not None:
            flag, value = self.row_flag, self.row_flag_value
            return ColumnMeanModel(means, set(), lambda df, c: col(flag) == value, self.output_prefix)
        prefix = self.flag_prefix
        whole = {c for c in columns if is_whole(dataset, c)}
        return ColumnMeanModel(
            means, whole, lambda df, c: (col(prefix + c) == 1) if prefix + c in df.columns else None, self.output_prefix
        )


def treat_outliers(
    df: DataFrame, method: str = "mean", flag_prefix: str = "iqr_out_", columns: Sequence[str] | None = None
) -> DataFrame:
    """Dispatch by name: ``mean``, ``median``, ``winsorize``, ``trim`` or ``none``."""
    chosen = method.lower()
    if chosen in ("mean", "median"):
        return ReplaceFlagged(flag_prefix, chosen, columns).fit_transform(df)
    if chosen == "winsorize":
        return Winsorize(flag_prefix, columns).fit_transform(df)
    if chosen == "trim":
        return drop_flagged_rows(df, flag_prefix, columns)
    if chosen == "none":
        return df
    raise ValueError(f"unknown treatment: {method}")
