"""Yeo-Johnson transform with lambda fitted by maximum likelihood.

Yeo and Johnson, "A new family of power transformations to improve normality or
symmetry", Biometrika 2000. The candidates of all columns are literals of one
wide aggregation of the table: nothing is unpivoted, exploded or shuffled but
one row for each task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.functions.expressions import literal, yeo_johnson
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.quantiles import column_quantiles
from profilekit.operators.schema import numeric_columns
from profilekit.runtime import col

PREFIX = "yeo_joh_"
# The candidate grid -2.0, -1.9, ... 2.0.
GRID = tuple(round(-2.0 + 0.1 * i, 1) for i in range(41))
COARSE = tuple(-2.0 + 0.5 * i for i in range(9))
# A bracket is cut around the top of its parabola to this share of its width, until it is so narrow that the top is exact
# enough; after so many rounds without that it is cut evenly.
CUT, NARROW, ROUNDS, EVENLY = 0.04, 0.002, 6, 12
# Variances in one aggregation; the code of more would not be compiled.
VARIANCES_PER_SCAN = 48


class Likelihood:
    """llf(lambda) = -n/2 * ln(var_pop(y)) + (lambda - 1) * sum(sign(x) * ln(1 + |x|)) of several columns.

    The variance is taken of y times ``exp(-s)``, with s from the largest value of either sign, and 2 s added to its
    logarithm, so it is finite for any lambda. Where all values have one sign, y is also moved to begin at the value that
    gives s, so that no spread is lost beside a large constant. llf is None for a column without spread.
    """

    def __init__(self, df: DataFrame, exprs: Mapping[str, Column]):
        # The logarithm is taken once for all candidates; a missing value has none.
        logs, found = [], []
        for i, e in enumerate(exprs.values()):
            x = e.cast("double")
            logs += [F.log1p(F.abs(x)).alias(f"g{i}"), (x >= 0).alias(f"plus{i}")]
            g, plus = F.col(f"g{i}"), F.col(f"plus{i}")
            found += [
                F.count(g).alias(f"n{i}"), F.max(F.when(plus, g)).alias(f"p{i}"), F.max(F.when(~plus, g)).alias(f"m{i}"),
                F.min(g).alias(f"l{i}"),
                F.sum(F.when(plus, g).otherwise(-g)).alias(f"j{i}"),
            ]
        self.df, self.places = df.select(*logs), {c: i for i, c in enumerate(exprs)}
        self.known: dict[str, dict[float, float | None]] = {c: {} for c in exprs}
        row = self.df.agg(*found).first() if found else None
        self.stats = {c: tuple(row[f"{k}{i}"] for k in "npmlj") for i, c in enumerate(exprs)}

    def _scaled(self, c: str, lam: float) -> tuple[Column, float]:
        """The transform times ``exp(-s)``, and s."""
        (_, plus, minus, least, _), g = self.stats[c], F.col(f"g{self.places[c]}")
        if plus is None or minus is None:
            k = lam if minus is None else 2.0 - lam
            start = least if k < 0 else plus if minus is None else minus
            moved = g - start
            return (F.expm1(moved * k) / k, k * start) if k != 0 else (moved, 0.0)
        s = max(0.0, lam * plus, (2.0 - lam) * minus)

        def branch(k: float, largest: float) -> Column:
            if k == 0:
                return g * math.exp(-s)
            if k * largest <= 1.0:
                return F.expm1(g * k) * (math.exp(-s) / k)
            return (F.exp(g * k - s) - math.exp(-s)) / k

        return F.when(F.col(f"plus{self.places[c]}"), branch(lam, plus)).otherwise(-branch(2.0 - lam, minus)), s

    def add(self, wanted: Mapping[str, Sequence[float]]) -> None:
        """Score the candidates that are not known yet, all columns together."""
        todo = [(c, lam) for c, lams in wanted.items() if self.stats[c][0] for lam in lams if lam not in self.known[c]]
        for at in range(0, len(todo), VARIANCES_PER_SCAN):
            part = [(c, lam, *self._scaled(c, lam)) for c, lam in todo[at:at + VARIANCES_PER_SCAN]]
            row = self.df.agg(*[F.var_pop(y).alias(f"v{i}") for i, (_, _, y, _) in enumerate(part)]).first()
            for i, (c, lam, _, s) in enumerate(part):
                n, *_, jacobian = self.stats[c]
                v = row[f"v{i}"]
                self.known[c][lam] = -0.5 * n * (math.log(v) + 2.0 * s) + (lam - 1.0) * jacobian if v and math.isfinite(v) else None

    def curve(self, c: str) -> list[tuple[float, float]]:
        return sorted((lam, llf) for lam, llf in self.known[c].items() if llf is not None)

    def best(self, c: str) -> int:
        """Place of the most likely candidate on the curve, the smallest of equals."""
        curve = self.curve(c)
        return max(range(len(curve)), key=lambda i: (curve[i][1], -curve[i][0]))

    def vertex(self, c: str, bracket: Sequence[float]) -> float:
        """Top of the parabola through three candidates, of which the middle one is the best."""
        (x0, y0), (x1, y1), (x2, y2) = ((v, self.known[c][v]) for v in bracket)
        left, right = (y1 - y0) / (x1 - x0), (y2 - y1) / (x2 - x1)
        if left <= right:
            return x1
        return min(max((x0 + x1) / 2 + left * (x2 - x0) / (2 * (left - right)), x0), x2)


def lambda_grid(df: DataFrame, columns: Sequence[str], grid: Sequence[float] = GRID) -> DataFrame:
    """``(variable, lambda, llf)`` of every candidate lambda for every column."""
    likelihood = Likelihood(df, {c: col(c) for c in columns})
    likelihood.add({c: [float(v) for v in grid] for c in columns})
    rows = [(c, float(v), likelihood.known[c].get(float(v))) for c in columns for v in grid]
    return df.sparkSession.createDataFrame(rows, "variable string, lambda double, llf double")


def _wide(bracket: Sequence[float]) -> bool:
    low, middle, high = bracket
    return high - low > NARROW * max(1.0, abs(middle))


def fit_lambdas(
    df: DataFrame, exprs: Mapping[str, Column], grid: Sequence[float] | None = None, digits: int | None = None
) -> dict[str, float]:
    """Most likely lambda per column; 1 for a column without spread.

    With ``grid`` the best grid point is taken. Otherwise the likelihood, which has one top, is bracketed: a coarse grid is
    doubled outwards while its end is the best, then the bracket is cut until a parabola through it gives the top. With
    ``digits`` the result is the most likely number of so many decimals.
    """
    likelihood = Likelihood(df, exprs)
    if grid is not None:
        likelihood.add({c: [float(v) for v in grid] for c in exprs})
        return {c: likelihood.curve(c)[likelihood.best(c)][0] if likelihood.curve(c) else 1.0 for c in exprs}

    likelihood.add({c: COARSE for c in exprs})
    spread = [c for c in exprs if likelihood.curve(c)]
    brackets: dict[str, tuple[float, float, float]] = {}
    while len(brackets) < len(spread):
        wider = {}
        for c in spread:
            curve, at = likelihood.curve(c), likelihood.best(c)
            if 0 < at < len(curve) - 1:
                brackets[c] = tuple(p[0] for p in curve[at - 1:at + 2])
            else:
                edge = curve[at][0]
                wider[c] = [edge * 2.0**i for i in range(1, 5)]
                if abs(edge) > 1e12 or all(v in likelihood.known[c] for v in wider[c]):
                    raise ArithmeticError(f"{c}: the likelihood has no top")
        likelihood.add(wider)
    rounds = 0
    while any(_wide(b) for b in brackets.values()):
        rounds += 1
        inner = {}
        for c, (low, _, high) in brackets.items():
            width = high - low
            if _wide(brackets[c]) and rounds <= ROUNDS:
                top = likelihood.vertex(c, brackets[c])
                inner[c] = [v for v in (top - CUT * width / 2, top, top + CUT * width / 2) if low < v < high]
            elif _wide(brackets[c]):
                inner[c] = [low + width * i / (EVENLY + 1) for i in range(1, EVENLY + 1)]
        likelihood.add(inner)
        for c in inner:
            curve, at = likelihood.curve(c), likelihood.best(c)
            brackets[c] = tuple(p[0] for p in curve[at - 1:at + 2])
    tops = {c: likelihood.vertex(c, b) for c, b in brackets.items()}
    if digits is not None:
        near = {c: [round(round(v, digits) + i * 10.0**-digits, digits) for i in (-1, 0, 1)] for c, v in tops.items()}
        likelihood.add(near)
        tops = {c: max(lams, key=lambda v: (likelihood.known[c][v], -v)) for c, lams in near.items()}
    return {c: tops.get(c, 1.0) for c in exprs}


class PowerModel(Fitted):
    """Fill with the median, transform, standardise; adds ``yeo_joh_{column}``."""

    def __init__(self, parameters: dict[str, dict], prefix: str):
        super().__init__()
        self.parameters, self.prefix = parameters, prefix

    def raw(self, name: str) -> Column:
        p = self.parameters[name]
        return yeo_johnson(F.coalesce(col(name).cast("double"), literal(p["median"])), F.lit(float(p["lambda"])))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {
                self.prefix + c: (self.raw(c) - literal(p["mean"])) / literal(p["std"])
                for c, p in self.parameters.items()
            }
        )

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(c, float(p["lambda"]), p["median"], p["mean"], p["std"]) for c, p in self.parameters.items()],
            "variable string, lambda double, median double, mean double, std double",
        )


class YeoJohnson(Learner):
    """Fit lambda per column, or take given ``lambdas``; output has mean 0 and population std 1 when ``standardize``.

    Known ``medians`` save their quantile passes.
    """

    def __init__(
        self,
        columns: Sequence[str] | None = None,
        lambdas: Mapping[str, float] | None = None,
        grid: Sequence[float] | None = None,
        digits: int | None = None,
        standardize: bool = True,
        prefix: str = PREFIX,
        medians: Mapping[str, float | None] | None = None,
    ):
        super().__init__()
        self.columns, self.lambdas, self.grid, self.medians = columns, lambdas, grid, medians
        self.digits = digits
        self.standardize, self.prefix = standardize, prefix

    def _fit(self, dataset: DataFrame) -> PowerModel:
        columns = list(self.columns) if self.columns is not None else numeric_columns(dataset)
        medians = self.medians
        if medians is None:
            medians = {c: q[0] for c, q in column_quantiles(dataset, {c: col(c) for c in columns}, [0.5]).items()}
        columns = [c for c in columns if medians[c] is not None]
        filled = {c: F.coalesce(col(c).cast("double"), literal(medians[c])) for c in columns}
        if self.lambdas is not None:
            lams = {c: float(self.lambdas[c]) for c in columns}
        else:
            lams = fit_lambdas(dataset, filled, self.grid, self.digits)
        parameters = {c: {"lambda": lams[c], "median": medians[c], "mean": 0.0, "std": 1.0} for c in columns}
        if self.standardize:
            unscaled = PowerModel(parameters, self.prefix)
            for c, m in column_moments(dataset, {c: unscaled.raw(c) for c in columns}).items():
                parameters[c] |= {"mean": m.mean, "std": 1.0 if m.constant else m.std_pop}
        return PowerModel(parameters, self.prefix)
