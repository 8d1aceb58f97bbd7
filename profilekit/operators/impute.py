"""Filling missing values by global or group statistics, and choosing between the strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilekit.functions.expressions import literal, md5_number
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.ordinals import running_sums
from profilekit.operators.quantiles import column_quantiles, grouped_quantiles, to_long
from profilekit.operators.schema import is_whole, numeric_columns
from profilekit.runtime import Lookup, col, cut_lineage, settle

METHODS = ("global_mean", "global_median", "group_mean", "group_median")


class ImputationModel(Fitted):
    def __init__(self, fallback: dict[str, float | None], group_col: str | None, groups: Lookup | None):
        super().__init__()
        self.fallback, self.group_col, self.groups = fallback, group_col, groups
        # Position of each column's statistic in the lookup.
        self.slots = {c: f"__fill_{i}" for i, c in enumerate(fallback)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        joined = dataset
        if self.groups is not None:
            joined = self.groups.left_join(dataset, self.group_col, "__fill_group")
        filled = []
        for field in dataset.schema:
            c = field.name
            if c not in self.fallback:
                filled.append(col(c))
                continue
            statistic = literal(self.fallback[c])
            if self.groups is not None:
                statistic = F.coalesce(F.col(self.slots[c]), statistic)
            if is_whole(dataset, c):
                statistic = F.bround(statistic, 0)
            filled.append(F.coalesce(col(c), statistic.cast(field.dataType)).alias(c))
        return joined.select(*filled)


class FillMissing(Learner):
    """Fill nulls of numeric columns.

    Group methods fall back to the global statistic where the group is null or
    has no observed value. Whole-number columns get the statistic rounded
    half-to-even and keep their type.
    """

    def __init__(self, method: str = "group_mean", group_col: str | None = None, columns: Sequence[str] | None = None):
        super().__init__()
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        if method.startswith("group") and group_col is None:
            raise ValueError("group methods need group_col")
        self.method, self.group_col, self.columns = method, group_col, columns

    def _fit(self, dataset: DataFrame) -> ImputationModel:
        if self.method == "group_mean":
            return self._group_means(dataset)
        columns = list(self.columns) if self.columns is not None else columns_with_nulls(dataset)
        exprs = {c: col(c) for c in columns}
        if not columns:
            return ImputationModel({}, None, None)
        if self.method == "global_mean":
            return ImputationModel({c: m.mean for c, m in column_moments(dataset, exprs).items()}, None, None)
        fallback = {c: q[0] for c, q in column_quantiles(dataset, exprs, [0.5]).items()}
        if self.method == "global_median":
            return ImputationModel(fallback, None, None)
        known = dataset.where(col(self.group_col).isNotNull())
        long = to_long(known, exprs, [col(self.group_col).alias("__fill_group")])
        medians = grouped_quantiles(long, ["__fill_group", "variable"], [0.5])
        table = medians.groupBy("__fill_group").agg(
            *[
                F.max(F.when(F.col("variable") == c, F.col("quantiles")[0])).alias(f"__fill_{i}")
                for i, c in enumerate(exprs)
            ]
        )
        return ImputationModel(fallback, self.group_col, Lookup(table))

    def _group_means(self, dataset: DataFrame) -> ImputationModel:
        """One scan: sums and counts per group give the group means, the global means and the null counts."""
        columns = list(self.columns) if self.columns is not None else numeric_columns(dataset)
        sums, _ = settle(
            dataset.groupBy(col(self.group_col).alias("__fill_group")).agg(
                F.count("*").alias("n"),
                *[F.sum(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
                *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)],
            )
        )
        total = sums.agg(
            *[F.sum(name).alias(name) for i in range(len(columns)) for name in (f"s{i}", f"c{i}")], F.sum("n").alias("n")
        ).first()
        slots = [i for i in range(len(columns)) if self.columns is not None or (total[f"c{i}"] or 0) < (total["n"] or 0)]
        if not slots:
            return ImputationModel({}, None, None)
        fallback = {columns[i]: total[f"s{i}"] / total[f"c{i}"] if total[f"c{i}"] else None for i in slots}
        means = [F.try_divide(F.col(f"s{i}"), F.col(f"c{i}")).alias(f"__fill_{j}") for j, i in enumerate(slots)]
        groups = sums.where(F.col("__fill_group").isNotNull()).select("__fill_group", *means)
        return ImputationModel(fallback, self.group_col, Lookup(groups))


def columns_with_nulls(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns with at least one null, from one aggregation."""
    columns = numeric_columns(df, exclude)
    if not columns:
        return []
    row = df.agg(*[F.coalesce(F.bool_or(col(c).isNull()), F.lit(False)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"m{i}"]]


def fold_columns(key: Column, seed: int, folds: int, mask_share: float) -> tuple[Column, Column]:
    """(test fold, masked) of a row, from one md5 of seed and key, so any engine can repeat the split."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return md5_number(digest, 1) % folds, (md5_number(digest, 9) % 10_000) < int(round(mask_share * 10_000))


def evaluate_imputation(
    df: DataFrame,
    key: str,
    group_col: str,
    variables: Sequence[str] | None = None,
    folds: int = 5,
    seed: int = 42,
    mask_share: float = 0.2,
    min_complete_cases: int = 100,
) -> DataFrame:
    """Cross-validated squared error of global mean, group mean and group median, per variable.

    Each row belongs to one test fold, and a share of each test fold is masked;
    both depend on the row key only. Statistics come from the other folds.
    Training sums and counts of a fold are the total minus the fold's own, for
    means and for medians alike, so no row is copied for the folds it trains.
    """
    variables = list(variables) if variables is not None else columns_with_nulls(df, [key])
    fold, masked = fold_columns(col(key), seed, folds, mask_share)
    whole = [c for c in variables if is_whole(df, c)]
    long = to_long(
        df, {c: col(c) for c in variables}, [col(group_col).alias("grp"), fold.alias("fold"), masked.alias("masked")]
    ).where(F.col("value").isNotNull())

    def fitted(value: Column) -> Column:
        return F.when(F.col("variable").isin(whole), F.bround(value, 0)).otherwise(value) if whole else value

    # Means: totals minus the fold's own part.
    parts, few_parts = settle(long.groupBy("variable", "fold", "grp").agg(F.sum("value").alias("s"), F.count("*").alias("n")))
    every_fold = F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))
    others = F.filter(every_fold, lambda f: f != F.col("fold"))
    train = parts.select("variable", F.explode(others).alias("fold"), "grp", "s", "n")
    group_means = train.where(F.col("grp").isNotNull()).groupBy("variable", "fold", "grp").agg(
        fitted(F.sum("s") / F.sum("n")).alias("group_mean")
    )
    global_means = train.groupBy("variable", "fold").agg(fitted(F.sum("s") / F.sum("n")).alias("global_mean"))
    complete = parts.groupBy("variable").agg(F.sum("n").alias("complete_cases"))

    medians, few_medians = settle(
        fold_medians(long, folds).select("variable", "fold", "scope", "grp", fitted(F.col("median")).alias("median"))
    )
    group_medians = medians.where("scope = 'group'").select("variable", "fold", "grp", F.col("median").alias("group_median"))
    global_medians = medians.where("scope = 'all'").select("variable", "fold", F.col("median").alias("global_median"))

    by_group = group_means.join(group_medians, ["variable", "fold", "grp"])
    if few_parts and few_medians:
        by_group = F.broadcast(by_group)
    # One row per variable and fold.
    by_fold = F.broadcast(global_means.join(global_medians, ["variable", "fold"]).join(complete, "variable"))
    test = (
        long.where("masked")
        .join(by_fold, ["variable", "fold"])
        .where(F.col("complete_cases") >= min_complete_cases)
        .join(by_group, ["variable", "fold", "grp"], "left")
    )

    def squared_error(value: Column) -> Column:
        return F.avg(F.pow(F.col("value") - value, 2))

    per_fold = test.groupBy("variable", "fold").agg(
        squared_error(F.col("global_mean")).alias("global_mean_mse"),
        squared_error(F.coalesce("group_mean", "global_mean")).alias("group_mean_mse"),
        squared_error(F.coalesce("group_median", "global_median")).alias("group_median_mse"),
    )
    return per_fold.groupBy("variable").agg(*[F.avg(m).alias(m) for m in MSE_COLUMNS])


def fold_medians(long: DataFrame, folds: int) -> DataFrame:
    """``(variable, scope, grp, fold, median)`` of the rows outside each fold, per group (not null) and of all rows.

    ``long`` is ``(variable, grp, fold, value)``. Equal values are counted per fold before the shuffle. Along the ordered
    values, the running count of the rows that train a fold is the running total minus the fold's own; the two middle
    ranks of every fold are read off in one aggregation.
    """
    counts = [f"c{f}" for f in range(folds)]
    by_value = cut_lineage(
        long.groupBy("variable", "grp", "value").agg(*[F.count_if(F.col("fold") == f).alias(c) for f, c in enumerate(counts)])
    )
    of_groups = by_value.where(F.col("grp").isNotNull()).select("variable", F.lit("group").alias("scope"), "grp", "value", *counts)
    of_all = by_value.groupBy("variable", "value").agg(*[F.sum(c).alias(c) for c in counts]).select(
        "variable", F.lit("all").alias("scope"), F.lit(None).cast(by_value.schema["grp"].dataType).alias("grp"), "value", *counts
    )
    keys = ["variable", "scope", "grp"]
    summed = running_sums(of_groups.unionByName(of_all), keys, "value", counts)

    def training(prefix: str, fold: int) -> Column:
        return sum((F.col(f"{prefix}{c}") for f, c in enumerate(counts) if f != fold), F.lit(0))

    def at(fold: int, rank: Column) -> Column:
        upto = training("upto_", fold)
        return F.max(F.when((rank < upto) & (rank >= upto - training("", fold)), F.col("value")))

    n = [training("total_", f) for f in range(folds)]
    lower = [F.floor((m - 1) / 2) for m in n]
    upper = [F.ceil((m - 1) / 2) for m in n]
    middle = summed.groupBy(*keys).agg(
        *[at(f, lower[f]).alias(f"low{f}") for f in range(folds)], *[at(f, upper[f]).alias(f"high{f}") for f in range(folds)]
    )
    median = [F.col(f"low{f}") + (F.col(f"high{f}") - F.col(f"low{f}")) * 0.5 for f in range(folds)]
    rows = F.array(*[F.struct(F.lit(f).cast("long").alias("fold"), m.alias("median")) for f, m in enumerate(median)])
    return middle.select(*keys, F.inline(rows)).where(F.col("median").isNotNull())


MSE_COLUMNS = ("global_mean_mse", "group_mean_mse", "group_median_mse")
# Display names of the strategies.
STRATEGY_LABELS = {
    "global_mean_mse": "Global Mean",
    "group_mean_mse": "Group Mean",
    "group_median_mse": "Group Median",
}


def best_strategy(evaluation: DataFrame) -> DataFrame:
    """``(variable, best_method, mse)``: smallest error, the first listed strategy on a tie."""
    options = F.array(
        *[F.struct(F.col(m).alias("mse"), F.lit(i).alias("pos"), F.lit(m).alias("name")) for i, m in enumerate(MSE_COLUMNS)]
    )
    best = F.array_min(F.filter(options, lambda o: o["mse"].isNotNull()))
    return evaluation.select("variable", best["name"].alias("best_method"), best["mse"].alias("mse"))


def evaluation_long(evaluation: DataFrame) -> DataFrame:
    """``(variable, method, mse)`` with display names."""
    long = evaluation.unpivot(["variable"], list(MSE_COLUMNS), "method", "mse")
    labels = F.create_map(*[F.lit(x) for pair in STRATEGY_LABELS.items() for x in pair])
    return long.select("variable", labels[F.col("method")].alias("method"), "mse")


def mean_squared_error(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.pow(col(prediction) - col(truth), 2)).alias("mse"))
