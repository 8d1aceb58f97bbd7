"""The forest job: two forests over the feature columns, flags attached, outliers exported."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from profilekit.operators import forest
from profilekit.operators.schema import columns_with_prefix, numeric_columns
from profilekit.operators.treat import MeanOfAllCells

FLAG_PREFIXES = ("zscore_out_", "iqr_out_", "forest_", "anomaly_score")


def forest_features(df: DataFrame, key: str, target: str | None = None) -> list[str]:
    """Numeric columns without key, target, flags and scores."""
    flags = set(columns_with_prefix(df, *FLAG_PREFIXES))
    return [c for c in numeric_columns(df, [key, target]) if c not in flags and c != "predicted_outlier"]


@dataclass
class ForestJob:
    standard: forest.ForestModel
    tuned: forest.ForestModel
    params: dict
    scored: DataFrame

    def outliers(self, key: str) -> DataFrame:
        """Rows the tuned forest flags, most anomalous first."""
        return forest.ordered_outliers(self.scored, key, "forest_outlier_tuned", "anomaly_score", -1)

    def comparison(self, key: str) -> DataFrame:
        return forest.compare_flags(self.scored, key, "forest_outlier", "forest_outlier_tuned", -1)

    def imputed(self, columns: Sequence[str]) -> DataFrame:
        """Every numeric cell of a flagged row replaced by the column mean."""
        return MeanOfAllCells(
            row_flag="forest_outlier_tuned", row_flag_value=-1, output_prefix="forest_mod_", columns=columns
        ).fit_transform(self.scored)


def run_forest_job(
    df: DataFrame,
    key: str,
    target: str | None = None,
    contamination: float = 0.05,
    seed: int = 42,
    params_file: str | None = None,
    tune: bool = True,
    grid: dict | None = None,
) -> ForestJob:
    columns = forest_features(df, key, target)
    standard = forest.IsolationForest(
        key, columns, contamination=contamination, seed=seed, scale=False, label="sign", score_column=None
    ).fit(df)
    tuned, params = forest.tuned_forest(
        df, key, columns, params_file=params_file, tune=tune, grid=grid,
        label="sign", flag_column="forest_outlier_tuned",
    )
    return ForestJob(standard, tuned, params, forest.transform_together(df, [standard, tuned]))
