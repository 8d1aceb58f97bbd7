"""Standard, min-max and robust scaling, and the z-score of a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from profilekit.functions.expressions import literal
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import numeric_columns
from profilekit.runtime import col

METHODS = ("standard", "minmax", "robust")


class ScalingModel(Fitted):
    """``(x - center) / divisor`` per column, in place."""

    def __init__(self, parameters: dict[str, tuple[float | None, float | None]]):
        super().__init__()
        self.parameters = parameters

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {c: (col(c).cast("double") - literal(m)) / literal(d) for c, (m, d) in self.parameters.items()}
        )


class Scale(Learner):
    """Scalers use the population std; a constant column or zero range is divided by one."""

    def __init__(self, method: str = "standard", columns: Sequence[str] | None = None, exclude: Sequence[str] = ()):
        super().__init__()
        self.method = method.lower()
        if self.method not in METHODS:
            raise ValueError(f"unknown scaling: {method}")
        self.columns, self.exclude = columns, exclude

    def _fit(self, dataset: DataFrame) -> ScalingModel:
        columns = list(self.columns) if self.columns is not None else numeric_columns(dataset, self.exclude)
        exprs = {c: col(c) for c in columns}
        if self.method == "robust":
            quantiles = column_quantiles(dataset, exprs, [0.25, 0.5, 0.75])
            return ScalingModel(
                {c: (q[1], None if q[1] is None else (q[2] - q[0]) or 1.0) for c, q in quantiles.items()}
            )
        moments = column_moments(dataset, exprs)
        if self.method == "standard":
            return ScalingModel({c: (m.mean, 1.0 if m.constant else m.std_pop) for c, m in moments.items()})
        return ScalingModel(
            {c: (m.minimum, 1.0 if m.constant else m.maximum - m.minimum) for c, m in moments.items()}
        )


def target_zscore(df: DataFrame, key: str, target: str) -> DataFrame:
    """``(key, {target}_zscore)`` with the **sample** std."""
    m = column_moments(df, {target: col(target)})[target]
    score = (col(target) - literal(m.mean)) / literal(m.std_samp or None)
    return df.select(col(key), score.alias(f"{target}_zscore"))
