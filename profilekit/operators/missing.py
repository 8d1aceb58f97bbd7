"""Missing-value profiles and their association with a group column.

Everything about groups is derived from one aggregation of the table to
``groups x columns`` counts; the tests, ranks and comparisons read only that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.chisquare import chi2_p_value
from profilekit.operators.ordinals import rank_within
from profilekit.operators.schema import numeric_columns
from profilekit.runtime import col, settle


def missing_indicator(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """0/1 per cell: 1 where the value is missing."""
    ids = [col(key)] if key else []
    return df.select(*ids, *[col(c).isNull().cast("int").alias(c) for c in columns])


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing_count, missing_pct)`` per column, one aggregation."""
    columns = list(columns) if columns is not None else df.columns
    counted = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("missing_count"))
            for i, c in enumerate(columns)
        ]
    )
    return (
        counted.select("n", F.inline(rows))
        .select(
            "column", "missing_count",
            (F.coalesce(F.try_divide(F.col("missing_count"), F.col("n")), F.lit(0.0)) * 100).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_pct"), "column")
    )


def missing_top(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The ``k`` columns with most missing values."""
    return missing_profile(df, columns).orderBy(F.desc("missing_pct"), "column").limit(k)


def missing_above(df: DataFrame, threshold: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns whose missing fraction exceeds the threshold (default 0.5). Nothing is dropped."""
    threshold = 0.5 if threshold is None else threshold
    profile = missing_profile(df, columns)
    return profile.select("column", (F.col("missing_pct") / 100).alias("missing_fraction")).where(
        F.col("missing_fraction") > threshold
    )


def group_counts(df: DataFrame, group: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``(grp, variable, n, missing)``, the null group kept; the base of all functions below."""
    columns = list(columns) if columns is not None else numeric_columns(df, [group])
    counted = df.groupBy(col(group).alias("grp")).agg(
        F.count("*").alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), (F.col("n") - F.col(f"c{i}")).alias("missing"))
            for i, c in enumerate(columns)
        ]
    )
    return counted.select("grp", "n", F.inline(rows)).select("grp", "variable", "n", "missing")


def missing_by_group(counts: DataFrame) -> DataFrame:
    """``(grp, variable, missing_pct)`` for the named groups."""
    return counts.where(F.col("grp").isNotNull()).select(
        "grp", "variable", (F.col("missing") / F.col("n") * 100).alias("missing_pct")
    )


def missing_by_group_matrix(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups as rows, columns as columns."""
    return missing_by_group(counts).groupBy("grp").pivot("variable", list(columns)).agg(F.first("missing_pct"))


def contingency(counts: DataFrame) -> DataFrame:
    """``(grp, variable, present, missing)``; the null group is left out."""
    return counts.where(F.col("grp").isNotNull()).select(
        "grp", "variable", (F.col("n") - F.col("missing")).alias("present"), "missing"
    )


def _by_variable(counts: DataFrame) -> DataFrame:
    """``(variable, overall_rate, total_missing, total, dof, chi2, p_value)``, by partial sums.

    ``chi2`` is null where nothing or everything is missing. Two groups get the continuity correction of Yates.
    """
    named = F.col("grp").isNotNull()
    totals = counts.groupBy("variable").agg(
        (F.sum("missing") / F.sum("n")).alias("overall_rate"),
        F.sum(F.when(named, F.col("missing"))).alias("total_missing"),
        F.sum(F.when(named, F.col("n"))).alias("total"),
        (F.count_if(named) - 1).alias("dof"),
    )

    def term(observed, column_total):
        expected = F.try_divide(F.col("n").cast("double") * column_total, F.col("total"))
        distance = F.abs(observed - expected)
        corrected = F.when(F.col("dof") == 1, distance - F.least(F.lit(0.5), distance)).otherwise(distance)
        return F.try_divide(corrected * corrected, expected)

    cells = term(F.col("missing"), F.col("total_missing")) + term(
        F.col("n") - F.col("missing"), F.col("total") - F.col("total_missing")
    )
    testable = (F.col("total_missing") > 0) & (F.col("total_missing") < F.col("total"))
    # There is a row for each column of the profiled table, which is as small as its schema.
    chi2 = (
        counts.where(named).join(F.broadcast(totals), "variable").where(testable)
        .groupBy("variable").agg(F.sum(cells).alias("chi2"))
    )
    tested = totals.join(F.broadcast(chi2), "variable", "left")
    return tested.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof")))


def association_test(counts: DataFrame, significance: float = 0.05) -> DataFrame:
    """Chi-square independence test of group against missing, per variable.

    Only variables with both missing and present cells are tested.
    """
    counts, _ = settle(counts)
    return _by_variable(counts).where(F.col("chi2").isNotNull()).select(
        "variable", "chi2", "dof", "p_value", (F.col("p_value") < significance).alias("significant")
    )


def _rated(counts: DataFrame, threshold: float, significance: float) -> DataFrame:
    """Rates, difference and test of every named group and variable."""
    counts, _ = settle(counts)
    rate = F.col("missing") / F.col("n")
    high = (F.col("p_value") < significance) & (F.col("difference") > threshold)
    return (
        counts.where(F.col("grp").isNotNull())
        .join(F.broadcast(_by_variable(counts)), "variable")
        .withColumns({"group_rate": rate, "difference": rate - F.col("overall_rate")})
        .withColumn("elevated", F.coalesce(high, F.lit(False)))
    )


def elevated_missing(counts: DataFrame, threshold: float = 0.05, significance: float = 0.05) -> DataFrame:
    """Significant variables that a group misses more often than the whole table does."""
    return (
        _rated(counts, threshold, significance)
        .where("elevated")
        .select("grp", "variable", "group_rate", "overall_rate", "difference", "chi2", "p_value")
        .orderBy(F.desc("difference"), "grp", "variable")
    )


def elevated_counts(counts: DataFrame, threshold: float = 0.05, significance: float = 0.05) -> DataFrame:
    """Number of elevated variables per group, groups without any included."""
    return (
        _rated(counts, threshold, significance)
        .groupBy("grp")
        .agg(F.count_if("elevated").alias("elevated_variables"))
        .orderBy(F.desc("elevated_variables"), "grp")
    )


def missing_overall(counts: DataFrame, threshold: float = 0.05, significance: float = 0.05) -> DataFrame:
    """One row: elevated pairs in total, and the chi-square statistics added up."""
    per_variable = (
        _rated(counts, threshold, significance)
        .groupBy("variable")
        .agg(F.count_if("elevated").alias("elevated"), F.first("chi2").alias("chi2"))
    )
    return per_variable.agg(
        F.sum("elevated").alias("total_elevated"), F.coalesce(F.sum("chi2"), F.lit(0.0)).alias("combined_chi2")
    )


def missing_rank(counts: DataFrame) -> DataFrame:
    """Rank of each group within each variable, 1 = most missing; equal rates are ordered by group name."""
    rates = counts.where(F.col("grp").isNotNull()).select("variable", "grp", (F.col("missing") / F.col("n")).alias("group_rate"))
    ranked = rank_within(rates, "variable", [F.desc("group_rate"), F.col("grp")])
    return ranked.select("variable", "grp", "group_rate", F.col("rank").cast("int").alias("rank"))


def missing_average_rank(counts: DataFrame) -> DataFrame:
    return (
        missing_rank(counts).groupBy("grp").agg(F.avg("rank").alias("avg_rank")).orderBy("avg_rank", "grp")
    )
