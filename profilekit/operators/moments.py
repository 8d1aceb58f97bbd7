"""Count, mean, spread and range of many columns in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.operators.quantiles import to_long

# Above this many columns the aggregate runs on the long form, so that the
# generated code stays below the JVM method limit.
WIDE_COLUMNS = 60


@dataclass(frozen=True)
class Moments:
    count: int
    mean: float | None
    std_pop: float | None
    std_samp: float | None
    minimum: float | None
    maximum: float | None

    @property
    def constant(self) -> bool:
        return self.count == 0 or self.minimum == self.maximum


def _aggregates(value: Column, suffix: str = "") -> list[Column]:
    return [
        F.count(value).alias("count" + suffix),
        F.avg(value).alias("mean" + suffix),
        F.stddev_pop(value).alias("std_pop" + suffix),
        F.stddev_samp(value).alias("std_samp" + suffix),
        F.min(value).alias("minimum" + suffix),
        F.max(value).alias("maximum" + suffix),
    ]


def column_moments(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, Moments]:
    if not exprs:
        return {}
    names = list(exprs)
    fields = list(Moments.__dataclass_fields__)
    if len(names) > WIDE_COLUMNS:
        rows = to_long(df, exprs).groupBy("variable").agg(*_aggregates(F.col("value"))).collect()
        by_name = {r["variable"]: Moments(*[r[f] for f in fields]) for r in rows}
        return {n: by_name.get(n, Moments(0, None, None, None, None, None)) for n in names}
    aggregates = [a for i, n in enumerate(names) for a in _aggregates(exprs[n].cast("double"), f"_{i}")]
    row = df.agg(*aggregates).first()
    return {n: Moments(*[row[f"{f}_{i}"] for f in fields]) for i, n in enumerate(names)}


def moments_table(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """The same as a table ``(variable, count, mean, std_pop, std_samp, minimum, maximum)``."""
    rows = [(n, *[getattr(m, f) for f in Moments.__dataclass_fields__]) for n, m in column_moments(df, exprs).items()]
    return df.sparkSession.createDataFrame(
        rows,
        "variable string, count bigint, mean double, std_pop double, std_samp double, minimum double, maximum double",
    )
