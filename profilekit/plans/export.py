"""Writing the results of the analyses and the feature tables with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from profilekit.config import Config
from profilekit.operators import metadata
from profilekit.operators.assemble import target_extract
from profilekit.operators.outliers import outlier_report
from profilekit.operators.profile import target_summary
from profilekit.operators.scale import target_zscore
from profilekit.operators.schema import range_violations
from profilekit.plans.analysis import MissingAnalysis, OutlierAnalysis
from profilekit.plans.forest_job import ForestJob
from profilekit.plans.prepare import Prepared
from profilekit.sources.sinks import column_lists, transformed_column_lists, write_csv, write_json, write_manifest, write_table


def export_missing(analysis: MissingAnalysis, folder: str) -> None:
    """Top missing columns, elevated groups, ranks and the strategy evaluation, as CSV."""
    write_csv(analysis.profile.limit(10), f"{folder}/top10_missing")
    write_csv(analysis.by_group, f"{folder}/missing_by_group")
    write_csv(analysis.tests, f"{folder}/association_tests")
    write_csv(analysis.elevated, f"{folder}/higher_missing_details")
    write_csv(analysis.average_rank, f"{folder}/missing_ranking")
    write_csv(analysis.evaluation, f"{folder}/imputation_results")


def export_outliers(result: OutlierAnalysis, folder: str) -> None:
    """Counts per column and method, and the report with the top ten columns of each method."""
    write_csv(result.counts, f"{folder}/outlier_counts")
    write_json(outlier_report(result.counts), f"{folder}/outlier_report")


def export_forest(job: ForestJob, key: str, folder: str) -> None:
    """All scored rows, and the flagged rows with the most anomalous first."""
    write_table(job.scored, f"{folder}/outlier_all")
    write_csv(job.outliers(key), f"{folder}/isolation_forest_outliers")
    write_manifest(job.scored.sparkSession, job.params, f"{folder}/best_params")


def export_target(source: DataFrame, cfg: Config, folder: str) -> dict:
    """Target and its z-score from the **raw** table; returns the summary and the count outside the range."""
    write_table(target_extract(source, cfg.key, cfg.target_col), f"{folder}/score")
    write_table(target_zscore(source, cfg.key, cfg.target_col), f"{folder}/score_zscore")
    outside = range_violations(source, cfg.target_col, *cfg.target_range).first()
    return target_summary(source, cfg.target_col).first().asDict() | {"violations": outside["violations"]}


def export_feature_tables(prepared: Prepared, cfg: Config, folder: str) -> None:
    """Linear, tree and general tables, their column lists, and the four metadata files."""
    for name in ("linear", "tree", "ml"):
        write_table(getattr(prepared, name), f"{folder}/{name}")
    export_metadata(prepared.linear, prepared.tree, cfg, f"{folder}/metadata")
    one_hot = metadata.classify_columns(prepared.linear, prepared.tree, cfg.key)["one_hot"]
    numeric = prepared.tree.drop(*prepared.categorical)
    lists = transformed_column_lists(numeric, one_hot, cfg.key)
    write_json(column_lists(numeric.sparkSession, lists), f"{folder}/column_lists")


def export_metadata(linear: DataFrame, tree: DataFrame, cfg: Config, folder: str) -> None:
    spark, target = linear.sparkSession, cfg.target_col or ""
    kinds = metadata.classify_columns(linear, tree, cfg.key)
    manifests = {
        "linear_model_columns": metadata.linear_manifest(linear, tree, cfg.key, target),
        "tree_model_columns": metadata.tree_manifest(linear, tree, cfg.key, target),
        "yeo_johnson_mapping": metadata.transformed_mapping(kinds),
        "feature_groups": metadata.feature_groups(kinds),
    }
    for name, manifest in manifests.items():
        write_manifest(spark, manifest, f"{folder}/{name}")
