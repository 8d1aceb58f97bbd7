"""Categorical encodings and derived numeric features."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilekit.functions.expressions import literal
from profilekit.operators.base import Fitted, Learner
from profilekit.operators.moments import column_moments
from profilekit.operators.ordinals import rank_within
from profilekit.operators.profile import category_counts
from profilekit.operators.quantiles import grouped_quantiles
from profilekit.operators.schema import (
    INTERACTION_KEYWORDS,
    POLYNOMIAL_KEYWORDS,
    categorical_columns,
    columns_with_keyword,
)
from profilekit.runtime import Lookup, col, cut_lineage, settle

OUTPUTS = ("dense", "vector")


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, value, ordinal)`` of all categories, ordinals from 0 in the order of the text within each column.

    Distinct values are numbered by range partitions and offsets, so neither the driver nor a task holds a column's
    categories. Nulls are no category.
    """
    values = (
        df.select(*[col(c).cast("string").alias(c) for c in columns])
        .unpivot([], [col(c) for c in columns], "variable", "value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    ranked = rank_within(values, "variable", [F.col("value")], "ordinal")
    return cut_lineage(ranked.withColumn("ordinal", F.col("ordinal") - 1))


class OneHotModel(Fitted):
    """``{column}_{value}`` float columns from known categories; null and unseen values give zeros."""

    def __init__(self, categories: dict[str, list[str]]):
        super().__init__()
        self.categories = categories

    @property
    def mapping(self) -> dict[str, list[str]]:
        return {c: [f"{c}_{v}" for v in values] for c, values in self.categories.items()}

    @property
    def widths(self) -> dict[str, int]:
        """Features of each column."""
        return {c: len(values) for c, values in self.categories.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = [col(c) for c in dataset.columns if c not in self.categories]
        encoded = [
            F.when(col(c).cast("string") == v, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float").alias(f"{c}_{v}")
            for c, values in self.categories.items()
            for v in values
        ]
        return dataset.select(*kept, *encoded)


class OneHotVectorModel(Fitted):
    """One sparse vector ``{column}_vector`` per column; null and unseen values give zeros.

    The categories stay in a table that is joined, by broadcast if it was seen to be small. A column without features has a
    vector with one slot that stays zero.
    """

    def __init__(self, dictionary: DataFrame, widths: dict[str, int], drop_first: bool):
        super().__init__()
        self.dictionary, self.widths, self.skip = dictionary, widths, int(drop_first)
        self.lookups = {
            c: Lookup(dictionary.where((F.col("variable") == c) & (F.col("ordinal") >= self.skip)).select(
                F.col("value").alias("__category"), (F.col("ordinal") - self.skip).alias("__slot")
            ))
            for c in widths
        }
        slots = [f"__slot_{i}" for i in range(len(widths))]
        sizes = [float(max(n, 1) - 1) for n in widths.values()]
        # What the encoder learns is the number of slots; the slot after the last stands for null and unseen values.
        encoder = OneHotEncoder(inputCols=slots, outputCols=[f"{c}_vector" for c in widths], dropLast=True, handleInvalid="keep")
        self.encoder = encoder.fit(dictionary.sparkSession.createDataFrame([sizes], [*slots])) if widths else None

    @property
    def mapping(self) -> dict[str, list[str]]:
        return {c: [f"{c}_vector"] for c in self.widths}

    def slots(self) -> DataFrame:
        """``(variable, value, slot)``: what stands where in the vectors."""
        return self.dictionary.where(F.col("ordinal") >= self.skip).select("variable", "value", (F.col("ordinal") - self.skip).alias("slot"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.encoder is None:
            return dataset
        kept = [c for c in dataset.columns if c not in self.widths]
        for i, (c, n) in enumerate(self.widths.items()):
            dataset = dataset.withColumn("__text", col(c).cast("string"))
            dataset = self.lookups[c].left_join(dataset, "__text", "__category")
            slot = F.coalesce(F.col("__slot"), F.lit(max(n, 1))).cast("double")
            dataset = dataset.withColumn(f"__slot_{i}", slot).drop("__text", "__slot")
        encoded = self.encoder.transform(dataset)
        return encoded.select(*[col(c) for c in kept], *[col(f"{c}_vector") for c in self.widths])


class OneHot(Learner):
    """One-hot encoding of any width. The caller chooses the form; it does not depend on the data.

    ``output="dense"`` gives a float column for each value. Their names are the schema of the result and so known to the
    driver; for columns of unbounded width ask for ``"vector"``, one sparse vector per column. Values are ordered by text and
    the smallest is dropped when ``drop_first``.
    """

    def __init__(
        self, columns: Sequence[str] | None = None, exclude: Sequence[str] = (), drop_first: bool = True, output: str = "dense"
    ):
        super().__init__()
        if output not in OUTPUTS:
            raise ValueError(f"output must be one of {OUTPUTS}")
        self.columns, self.exclude, self.drop_first, self.output = columns, exclude, drop_first, output

    def _fit(self, dataset: DataFrame) -> OneHotModel | OneHotVectorModel:
        columns = list(self.columns) if self.columns is not None else categorical_columns(dataset, self.exclude)
        if not columns:
            return OneHotModel({})
        skip = int(self.drop_first)
        if self.output == "vector":
            dictionary = category_dictionary(dataset, columns)
            sizes = {r["variable"]: r["n"] for r in dictionary.groupBy("variable").agg(F.count("*").alias("n")).collect()}
            return OneHotVectorModel(dictionary, {c: max(sizes.get(c, 0) - skip, 0) for c in columns}, self.drop_first)
        values = (
            dataset.select(*[col(c).cast("string").alias(c) for c in columns])
            .unpivot([], [col(c) for c in columns], "variable", "value")
            .where(F.col("value").isNotNull())
            .distinct()
        )
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in values.collect():
            found[r["variable"]].append(r["value"])
        return OneHotModel({c: sorted(found[c])[skip:] for c in columns})


def expansion_table(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """``(column, categories, features, expansion_ratio)`` per encoded column and a TOTAL row.

    ``widths`` holds the number of features of each column, as encoders give it.
    """
    features = F.create_map(*[x for c, n in widths.items() for x in (F.lit(c), F.lit(n).cast("long"))])
    per_column = category_counts(df, list(widths)).select(
        F.col("variable").alias("column"), "categories", features[F.col("variable")].alias("features")
    )
    rows = per_column.unionByName(
        per_column.agg(F.sum("categories").alias("categories"), F.sum("features").alias("features")).select(
            F.lit("TOTAL").alias("column"), "categories", "features"
        )
    )
    ratio = F.try_divide(F.col("features"), F.col("categories"))
    return rows.withColumn("expansion_ratio", F.coalesce(ratio, F.lit(0.0)))


class TargetEncodingModel(Fitted):
    def __init__(self, columns: Sequence[str], lookups: dict[str, Lookup]):
        super().__init__()
        self.columns, self.lookups = list(columns), lookups

    def table(self, column: str) -> DataFrame:
        """Fitted statistics of one column."""
        return self.lookups[column].table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        original = dataset.columns
        for c in self.columns:
            dataset = self.lookups[c].left_join(dataset, c, "__category").withColumnRenamed(
                "__encoding", f"{c}_target_encoded"
            )
        return dataset.select(*[col(c) for c in original], *[col(f"{c}_target_encoded") for c in self.columns])


class TargetEncode(Learner):
    """Smoothed mean ``(n * mean + k * global) / (n + k)`` or raw median of the target per category.

    All columns are aggregated together in the long form; a null category
    encodes to null.
    """

    def __init__(self, columns: Sequence[str], target: str, k: float = 5, method: str = "mean"):
        super().__init__()
        if method not in ("mean", "median"):
            raise ValueError(f"unknown target encoding: {method}")
        self.columns, self.target, self.k, self.method = list(columns), target, k, method

    def _fit(self, dataset: DataFrame) -> TargetEncodingModel:
        stats = category_statistics(dataset, self.columns, self.target, self.method)
        if self.method == "mean":
            overall = column_moments(dataset, {"y": col(self.target)})["y"].mean
            encoding = (F.col("count") * F.col("mean") + self.k * literal(overall)) / (F.col("count") + self.k)
        else:
            encoding = F.col("median")
        # Computed once for all columns; each column then keeps its own part.
        stats, _ = settle(stats.select("variable", F.col("category").alias("__category"), encoding.alias("__encoding")))
        lookups = {c: Lookup(stats.where(F.col("variable") == c).drop("variable")) for c in self.columns}
        return TargetEncodingModel(self.columns, lookups)


def category_statistics(df: DataFrame, columns: Sequence[str], target: str, method: str = "mean") -> DataFrame:
    """``(variable, category, mean|median, count)`` of the target; null categories are left out."""
    long = (
        df.select(col(target).cast("double").alias("value"), *[col(c).cast("string").alias(c) for c in columns])
        .unpivot(["value"], [col(c) for c in columns], "variable", "category")
        .where(F.col("category").isNotNull())
    )
    counts = long.groupBy("variable", "category").agg(F.avg("value").alias("mean"), F.count("value").alias("count"))
    if method == "mean":
        return counts
    medians = grouped_quantiles(long, ["variable", "category"], [0.5])
    return counts.select("variable", "category", "count").join(
        medians.select("variable", "category", F.col("quantiles")[0].alias("median")), ["variable", "category"]
    ).select("variable", "category", "median", "count")


INTERACTION_NAMES = {"multiply": "x", "add": "plus", "subtract": "minus", "divide": "div"}


def interact(df: DataFrame, pairs: Sequence[Sequence[str]], kind: str = "multiply") -> DataFrame:
    """``{a}_x_{b}``, ``{a}_plus_{b}``, ``{a}_minus_{b}`` or ``{a}_div_{b}``; pairs with an absent column are skipped."""
    if kind not in INTERACTION_NAMES:
        raise ValueError(f"unknown interaction: {kind}")
    out = {}
    for a, b in pairs:
        if a not in df.columns or b not in df.columns:
            continue
        x, y = col(a), col(b)
        value = {"multiply": lambda: x * y, "add": lambda: x + y, "subtract": lambda: x - y,
                 "divide": lambda: F.try_divide(x, y)}[kind]()
        out[f"{a}_{INTERACTION_NAMES[kind]}_{b}"] = value
    return df.withColumns(out) if out else df


def default_interaction_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Each of the first five ratio-like columns with the next four."""
    found = columns_with_keyword(columns, INTERACTION_KEYWORDS)
    return [(a, b) for i, a in enumerate(found[:5]) for b in found[i + 1:i + 5]]


def default_polynomial_columns(columns: Sequence[str]) -> list[str]:
    return columns_with_keyword(columns, POLYNOMIAL_KEYWORDS)[:5]


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of the columns from degree two up to ``degree``, named like ``a_pow_2_b``."""
    out = {}
    for d in range(2, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, d):
            powers = Counter(combo)
            name = "_".join(c.replace(" ", "_") + (f"_pow_{n}" if n > 1 else "") for c, n in powers.items())
            product = None
            for c in combo:
                factor = col(c).cast("double")
                product = factor if product is None else product * factor
            out[name] = product
    return df.withColumns(out) if out else df
