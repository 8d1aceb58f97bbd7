"""Manifests of the feature tables, from their schemas alone."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from profilekit.operators.schema import categorical_columns

YEO = "yeo_joh_"

# The named feature groups of the company table.
FEATURE_GROUPS = {
    "financial_metrics": [
        "market_cap_usd", "net_income_usd", "hist_pe", "hist_book_px", "hist_fcf_yld", "hist_ebitda_ev",
        "hist_gross_profit_usd", "hist_net_debt_usd", "hist_ev_usd", "hist_eps_usd",
    ],
    "performance_ratios": ["hist_roe", "hist_roic", "hist_roa", "hist_asset_turnover"],
    "investment_metrics": ["hist_capex_sales", "hist_capex_depr", "hist_rd_exp_usd", "return_usd", "vol_total_usd"],
    "governance_features": [
        "top_1_shareholder_percentage", "top_2_shareholder_percentage", "top_3_shareholder_percentage",
    ],
    "location_features": [
        "issuer_cntry_domicile_name", "cntry_of_risk", "top_1_shareholder_location", "top_2_shareholder_location",
        "top_3_shareholder_location",
    ],
    "industry_features": ["gics_sector", "gics_sub_ind"],
}
OTHER_GROUP = "other_metrics"


def classify_columns(
    linear: DataFrame, tree: DataFrame, key: str, categorical: Sequence[str] | None = None
) -> dict[str, list[str]]:
    """Sorted base numerical, transformed and one-hot columns, and the categorical columns of the tree table."""
    categories = list(categorical) if categorical is not None else categorical_columns(tree, [key])
    names = [c for c in tree.columns if c != key]
    transformed = sorted(c for c in names if c.startswith(YEO))
    base = sorted(c for c in names if c not in transformed and c not in categories)
    known = {key, *base, *transformed}
    return {
        "base_numerical": base,
        "yeo_johnson": transformed,
        "categorical": categories,
        "one_hot": sorted(c for c in linear.columns if c not in known),
    }


def column_table(spark: SparkSession, linear: DataFrame, tree: DataFrame, key: str, **options) -> DataFrame:
    """``(dataset, column, kind)`` for both tables."""
    kinds = classify_columns(linear, tree, key, **options)
    in_both = [("base_numerical", c) for c in kinds["base_numerical"]] + [("yeo_johnson", c) for c in kinds["yeo_johnson"]]
    rows = [("linear", c, k) for k, c in in_both] + [("linear", c, "one_hot") for c in kinds["one_hot"]]
    rows += [("tree", c, k) for k, c in in_both] + [("tree", c, "categorical") for c in kinds["categorical"]]
    return spark.createDataFrame(rows, "dataset string, column string, kind string")


def linear_manifest(linear: DataFrame, tree: DataFrame, key: str, target: str, **options) -> dict:
    kinds = classify_columns(linear, tree, key, **options)
    return {
        "base_numerical_features": kinds["base_numerical"],
        "yeo_numerical_features": kinds["yeo_johnson"],
        "categorical_features": kinds["categorical"],
        "one_hot_encoded_features": kinds["one_hot"],
        "total_features": len(linear.columns) - 1,
        "identifier": key,
        "target": target,
        "yeo_prefix": YEO,
    }


def tree_manifest(linear: DataFrame, tree: DataFrame, key: str, target: str, **options) -> dict:
    manifest = linear_manifest(linear, tree, key, target, **options)
    del manifest["one_hot_encoded_features"]
    return manifest | {"total_features": len(tree.columns) - 1}


def transformed_mapping(kinds: Mapping[str, Iterable[str]]) -> dict[str, str]:
    """Base column -> its transformed column."""
    base = set(kinds["base_numerical"])
    pairs = ((c[len(YEO):], c) for c in kinds["yeo_johnson"])
    return {b: c for b, c in pairs if b in base}


def feature_groups(
    kinds: Mapping[str, Sequence[str]], groups: Mapping[str, Sequence[str]] | None = None
) -> dict[str, list[str]]:
    """Named groups restricted to the columns present; other numerical columns form ``other_metrics``."""
    groups = FEATURE_GROUPS if groups is None else groups
    present = {*kinds["base_numerical"], *kinds["categorical"]}
    grouped = {c for names in groups.values() for c in names}
    out = {g: [c for c in names if c in present] for g, names in groups.items()}
    out[OTHER_GROUP] = sorted(c for c in kinds["base_numerical"] if c not in grouped)
    return {g: names for g, names in out.items() if names}
