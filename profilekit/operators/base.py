"""Shape shared by all fitted transforms: an Estimator learns statistics, its Model is a pure projection.

They plug into ``pyspark.ml.Pipeline``. A fitted model holds its statistics as
plain numbers (literals in the plan, no join) or as a :class:`Lookup`, so
``transform`` also accepts a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame

from profilekit.operators.schema import null_if_nan


class Fitted(Model):
    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        """NaN counts as missing, as it does in ``fit``."""
        return super().transform(null_if_nan(dataset), params)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError


class Learner(Estimator):
    def fit(self, dataset: DataFrame, params=None):
        """NaN counts as missing; a column whose statistics are not finite, because it holds an infinity, is an error."""
        return super().fit(null_if_nan(dataset), params)

    def _fit(self, dataset: DataFrame) -> Fitted:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Step(Transformer):
    """Wrap a ``DataFrame -> DataFrame`` function that learns nothing."""

    def __init__(self, function):
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)
