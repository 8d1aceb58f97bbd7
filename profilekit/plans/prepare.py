"""The full preparation of a table: fill, flag, treat, transform, encode, assemble.

Every stage learns its statistics from the table before it and is then a
projection, so the feature tables come from one chain over the input without
joining the parts back together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame

from profilekit.config import Config
from profilekit.operators.base import Step
from profilekit.operators.encode import OneHot
from profilekit.operators.forest import IsolationForest
from profilekit.operators.impute import FillMissing
from profilekit.operators.outliers import IQR_PREFIX, IqrModel, ZScoreDetector
from profilekit.operators.power import YeoJohnson
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import (
    assert_no_target,
    categorical_columns,
    columns_with_prefix,
    drop_columns,
    identifier_columns,
    null_if_nan,
    numeric_columns,
)
from profilekit.operators.treat import MeanOfAllCells, treat_outliers
from profilekit.runtime import col

FOREST_PREFIX = "forest_mod_"


@dataclass
class Prepared:
    """The fitted chain and its tables, all lazy."""

    model: PipelineModel
    table: DataFrame
    treated: DataFrame
    ml: DataFrame
    linear: DataFrame
    tree: DataFrame
    numerical: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        """The same fitted chain on new data, batch or streaming; nothing is learned again."""
        return self.model.transform(df)


def prepare(df: DataFrame, cfg: Config, cache: StorageLevel | None = None) -> Prepared:
    """Fit the chain on ``df``.

    Each fit is its own pass over the filled table. From a columnar source that
    pass reads only the columns it needs and filling is a broadcast join, so
    nothing is persisted unless ``cache`` is given (useful over CSV).
    """
    skip = [cfg.key] + ([cfg.target_col] if cfg.target_col else [])
    clean = Step(null_if_nan)
    source = clean.transform(df)
    numerical = numeric_columns(source, skip)
    strings = categorical_columns(source, [*skip, *cfg.identifiers])
    # The group column is a category by decree.
    asked = [c for c in strings if c != cfg.group_col]
    identifiers = identifier_columns(source, asked, cfg.identifier_share) if cfg.identifier_share is not None else []
    categorical = [c for c in strings if c not in identifiers]

    fill = FillMissing(cfg.imputation, cfg.group_col, numerical).fit(source)
    filled = fill.transform(source)
    if cache is not None:
        filled = filled.persist(cache)
    # One set of quartiles serves the fences and the power transform.
    quartiles = column_quantiles(filled, {c: col(c) for c in numerical}, [0.25, 0.5, 0.75])
    iqr = IqrModel({c: (q[0], q[2]) for c, q in quartiles.items()}, cfg.iqr_multiplier, IQR_PREFIX)
    zscore = ZScoreDetector(numerical, cfg.z_threshold).fit(filled)
    power = YeoJohnson(numerical, grid=cfg.lambda_grid, medians={c: q[1] for c, q in quartiles.items()}).fit(filled)
    encode = OneHot(categorical, drop_first=cfg.drop_first, output=cfg.one_hot_output).fit(filled)
    flags: list[Transformer] = [iqr, zscore]
    if cfg.forest_contamination is not None:
        forest = IsolationForest(cfg.key, numerical, contamination=cfg.forest_contamination).fit(filled)
        # Every numeric cell of a row that the forest flags becomes the column mean.
        flags += [forest, MeanOfAllCells(row_flag=forest.flag_column, output_prefix=FOREST_PREFIX, columns=numerical).fit(filled)]
    if cache is not None:
        filled.unpersist()

    # One-hot replaces the categorical columns, so the tree table is read off before it.
    fitted: list[Transformer] = [clean, fill, *flags, power]
    model = PipelineModel(fitted)
    table = model.transform(df)
    features = drop_columns(table, [cfg.target_col] if cfg.target_col else [], (iqr.prefix, zscore.prefix))
    encoded = encode.transform(features)
    transformed = columns_with_prefix(features, power.prefix)
    one_hot = [c for names in encode.mapping.values() for c in names]

    def pick(source: DataFrame, columns: Sequence[str]) -> DataFrame:
        out = source.select(col(cfg.key), *[col(c) for c in columns])
        return assert_no_target(out, cfg.target_col) if cfg.target_col else out

    return Prepared(
        model=PipelineModel([*fitted, encode]),
        table=table,
        treated=treat_outliers(table, cfg.treatment, cfg.flag_prefix),
        ml=pick(encoded, [*transformed, *one_hot]),
        linear=pick(encoded, [*numerical, *transformed, *one_hot]),
        tree=pick(features, [*numerical, *transformed, *categorical]),
        numerical=numerical,
        categorical=categorical,
        identifiers=[*identifiers, *[c for c in source.columns if c in cfg.identifiers]],
    )


def chain(df: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply steps in order, each on the result of the one before."""
    for step in steps:
        df = df.transform(step)
    return df
