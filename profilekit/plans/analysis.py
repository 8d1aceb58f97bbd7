"""Whole analyses put together from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.operators import forest, missing, outliers
from profilekit.operators.encode import (
    OneHot,
    default_interaction_pairs,
    default_polynomial_columns,
    expansion_table,
    interact,
    polynomial,
)
from profilekit.operators.impute import FillMissing, best_strategy, evaluate_imputation
from profilekit.operators.profile import before_after, dtype_counts, flagged_non_null_counts
from profilekit.operators.scale import Scale
from profilekit.operators.schema import categorical_columns, common_columns, numeric_columns
from profilekit.runtime import settle


@dataclass
class MissingAnalysis:
    profile: DataFrame
    by_group: DataFrame
    by_group_categorical: DataFrame
    tests: DataFrame
    elevated: DataFrame
    elevated_counts: DataFrame
    average_rank: DataFrame
    overall: DataFrame
    evaluation: DataFrame
    best: DataFrame
    imputed: DataFrame


def analyse_missing(
    df: DataFrame, key: str, group_col: str, method: str = "group_mean", columns: Sequence[str] | None = None
) -> MissingAnalysis:
    """Profile, association tests, strategy evaluation and the filled table.

    The evaluation advises; the method applied is the one asked for. Counts of
    numeric and categorical columns come from one scan of the table, and every
    result about groups reads them.
    """
    columns = list(columns) if columns is not None else numeric_columns(df, [key])
    categorical = categorical_columns(df, [key, group_col])
    every, _ = settle(missing.group_counts(df, group_col, [*columns, *categorical]))
    counts, others = (every.where(F.col("variable").isin(c)) for c in (columns, categorical))
    evaluation, _ = settle(evaluate_imputation(df, key, group_col))
    return MissingAnalysis(
        profile=missing.missing_profile(df),
        by_group=missing.missing_by_group(counts),
        by_group_categorical=missing.missing_by_group(others),
        tests=missing.association_test(counts),
        elevated=missing.elevated_missing(counts),
        elevated_counts=missing.elevated_counts(counts),
        average_rank=missing.missing_average_rank(counts),
        overall=missing.missing_overall(counts),
        evaluation=evaluation,
        best=best_strategy(evaluation),
        imputed=FillMissing(method, group_col).fit_transform(df),
    )


@dataclass
class OutlierAnalysis:
    flagged: DataFrame
    iqr: outliers.IqrModel
    zscore: outliers.ZScoreModel
    counts: DataFrame
    forest: forest.ForestModel | None = None
    tuned: forest.ForestModel | None = None
    forest_counts: DataFrame | None = None
    tuned_counts: DataFrame | None = None
    tuned_params: dict = field(default_factory=dict)


def analyse_outliers(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    target: str | None = None,
    multiplier: float = 1.5,
    threshold: float = 3.0,
    add_forest: bool = True,
    tune: bool = False,
    contamination: float = 0.05,
    seed: int = 42,
) -> OutlierAnalysis:
    """IQR and z-score flags, and optionally one or two forests, over the same columns without the target.

    Statistics are fitted once and used for flags, counts and tails alike.
    """
    skip = [key] + ([target] if target else [])
    columns = [c for c in (columns if columns is not None else numeric_columns(df)) if c not in skip]
    iqr = outliers.IqrDetector(columns, multiplier).fit(df)
    zscore = outliers.ZScoreDetector(columns, threshold).fit(df)
    result = OutlierAnalysis(
        flagged=zscore.transform(iqr.transform(df)), iqr=iqr, zscore=zscore,
        counts=outliers.outlier_counts(df, [iqr, zscore]),
    )
    if add_forest:
        result.forest = forest.IsolationForest(key, columns, contamination=contamination, seed=seed).fit(df)
        result.flagged = result.forest.transform(result.flagged)
        result.forest_counts = flagged_non_null_counts(result.flagged, "forest_outlier", columns)
        if tune:
            result.tuned, result.tuned_params = forest.tuned_forest(
                df, key, columns, objective="silhouette",
                flag_column="forest_out_tuned_", score_column="anomaly_score_tuned",
            )
            result.flagged = result.tuned.transform(result.flagged)
            result.tuned_counts = flagged_non_null_counts(result.flagged, "forest_out_tuned_", columns)
    return result


@dataclass
class FeatureInfo:
    original_columns: int
    final_columns: int
    transformations: list[dict]
    expansion: DataFrame | None
    dtypes: DataFrame
    common_numeric: dict[str, str]

    @property
    def column_change(self) -> int:
        return self.final_columns - self.original_columns


def engineer_features(
    df: DataFrame,
    categorical: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    one_hot: bool = True,
    scaling: str | None = None,
    interactions: Sequence[Sequence[str]] | str = (),
    interaction_kind: str = "multiply",
    polynomials: Sequence[str] | str = (),
    degree: int = 2,
    one_hot_output: str = "dense",
) -> tuple[DataFrame, FeatureInfo]:
    """The steps that were asked for, in the order one-hot, scaling, interactions, polynomials.

    The order matters: dense one-hot columns are numeric and are scaled too, and
    interactions and polynomials see scaled values. ``interactions="default"``
    and ``polynomials="default"`` choose columns of ``df`` by the keywords in
    their names.
    """
    numeric = numeric_columns(df, exclude)
    pairs = default_interaction_pairs(numeric) if interactions == "default" else [list(p) for p in interactions]
    powers = default_polynomial_columns(numeric) if polynomials == "default" else list(polynomials)
    expansion = None

    def encode(table: DataFrame) -> tuple[DataFrame, dict]:
        nonlocal expansion
        chosen = list(categorical) if categorical is not None else categorical_columns(table, exclude)
        model = OneHot(chosen, output=one_hot_output).fit(table)
        expansion = expansion_table(table, model.widths) if model.widths else None
        return model.transform(table), {"feature_mapping": model.mapping}

    def rescale(table: DataFrame) -> tuple[DataFrame, dict]:
        columns = numeric_columns(table, exclude)
        return Scale(scaling, columns).fit_transform(table), {"method": scaling, "columns": columns}

    # Names and keys of the log are read by other programs: fixed values.
    steps = [
        ("one_hot_encoding", one_hot, encode),
        ("normalization", scaling, rescale),
        ("interactions", pairs, lambda t: (interact(t, pairs, interaction_kind), {"interactions": [list(p) for p in pairs]})),
        ("polynomials", powers, lambda t: (polynomial(t, powers, degree), {"columns": powers, "degree": degree})),
    ]
    out, log = df, []
    for name, wanted, step in steps:
        if wanted:
            out, details = step(out)
            log.append({"type": name} | details)
    info = FeatureInfo(
        original_columns=len(df.columns), final_columns=len(out.columns), transformations=log, expansion=expansion,
        dtypes=dtype_counts(out), common_numeric={c: c for c in common_columns(df, out) if c in set(numeric)},
    )
    return out, info


def compare_distributions(original: DataFrame, transformed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and std before and after, for columns that were changed in place.

    Each table is aggregated by itself; only the rows of the summaries, one for each column, are joined.
    """
    before, after = (before_after(t, {c: c for c in columns}) for t in (original, transformed))
    renamed = after.select("variable", *[F.col(c).alias(c.replace("original", "transformed")) for c in after.columns if c.startswith("original")])
    return before.select("variable", *[c for c in before.columns if c.startswith("original")]).join(F.broadcast(renamed), "variable")
