import json

import pytest
from conftest import SF, by_key
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from profilekit.catalog import QUERIES
from profilekit.config import Config
from profilekit.operators import assemble, metadata
from profilekit.operators.impute import FillMissing
from profilekit.operators.outliers import IqrDetector
from profilekit.operators.scale import Scale
from profilekit.plans.prepare import chain, prepare
from profilekit.streaming.apply import apply_stream

CFG = Config(key="company_id", group_col="gics_sector", target_col="social_score")


@pytest.fixture(scope="module")
def prepared(companies):
    return prepare(companies, CFG)


def test_feature_tables(prepared, companies):
    numerical = [c for c in companies.columns if c not in ("company_id", "social_score", "gics_sector", "rating", "country")]
    assert prepared.numerical == numerical
    assert prepared.tree.columns == ["company_id", *numerical, *[f"yeo_joh_{c}" for c in numerical], "gics_sector", "rating", "country"]
    one_hot = 10 + 6 + 4
    assert len(prepared.linear.columns) == 1 + 2 * len(numerical) + one_hot
    assert len(prepared.ml.columns) == 1 + len(numerical) + one_hot
    assert prepared.linear.count() == 1000
    assert "processed_revenue" in prepared.treated.columns


def test_chain_equals_the_joined_tables(prepared, companies):
    """The projection chain gives the rows that joining the separate parts gives."""
    base = prepared.table
    numerical = base.select("company_id", *prepared.numerical)
    transformed = base.select("company_id", *[f"yeo_joh_{c}" for c in prepared.numerical])
    categorical = companies.select("company_id", *prepared.categorical)
    joined = assemble.tree_table(numerical, transformed, categorical, "company_id", "social_score")
    a, b = by_key(prepared.tree, "company_id"), by_key(joined, "company_id")
    assert a == b


def test_no_join_in_the_feature_chain(prepared):
    plan = prepared.linear._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_apply_to_new_rows(prepared, companies):
    new = companies.limit(50)
    out = prepared.apply(new)
    assert out.count() == 50
    known = by_key(prepared.linear, "company_id")
    for r in out.select("company_id", "yeo_joh_revenue").collect():
        assert r.yeo_joh_revenue == pytest.approx(known[r.company_id].yeo_joh_revenue)


def test_fitted_model_on_a_stream(spark, prepared, companies, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    companies.repartition(2).write.parquet(source)
    stream = spark.readStream.schema(companies.schema).parquet(source)
    query = apply_stream(stream, prepared.model, sink, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = by_key(spark.read.parquet(sink).select("company_id", "yeo_joh_revenue"), "company_id")
    want = by_key(prepared.linear.select("company_id", "yeo_joh_revenue"), "company_id")
    assert got == want


def test_learners_fit_into_a_spark_ml_chain(companies):
    stages = [FillMissing("group_mean", "gics_sector"), IqrDetector(["revenue"]), Scale("minmax", ["revenue"])]
    out = Pipeline(stages=stages).fit(companies).transform(companies)
    row = out.agg(F.min("revenue"), F.max("revenue"), F.sum("iqr_out_revenue")).first()
    assert row[0] == 0 and row[1] == 1 and row[2] > 0


def test_identifiers_are_no_features(companies):
    tagged = companies.withColumn("tag", F.concat(F.lit("t"), "company_id")).withColumn("isin", F.col("country"))
    out = prepare(tagged, CFG)
    assert out.identifiers == ["tag", "isin"] and "tag" not in out.tree.columns and "isin" not in out.tree.columns
    assert not [c for c in out.linear.columns if c.startswith(("tag_", "isin_"))]
    kept = prepare(tagged, Config("company_id", "gics_sector", "social_score", identifier_share=None, one_hot_output="vector"))
    assert "tag" in kept.tree.columns and {"tag_vector", "country_vector"} <= set(kept.linear.columns)
    assert kept.linear.select("tag_vector").first()[0].size == 999


def test_forest_stage_of_the_chain(companies):
    out = prepare(companies, Config("company_id", "gics_sector", "social_score", forest_contamination=0.02))
    table = out.table
    flagged = table.where("forest_outlier = 1")
    assert flagged.count() == 20
    mean = out.table.agg(F.avg("revenue")).first()[0]
    assert [r[0] for r in flagged.select("forest_mod_revenue").distinct().collect()] == pytest.approx([mean])
    assert table.where("forest_outlier = 0 and forest_mod_revenue <> revenue").isEmpty()
    assert not [c for c in out.linear.columns if c.startswith(("forest", "anomaly"))]
    # The same chain, forest included, on new rows.
    assert out.apply(companies.limit(30)).select("forest_outlier", "forest_mod_revenue").count() == 30


def test_sequential_chain(small):
    out = chain(small, [lambda d: d.where("company_id > 1"), lambda d: d.select("company_id")])
    assert sorted(r[0] for r in out.collect()) == [2, 3, 4, 5]


def test_duplicate_keys_are_refused(small):
    twice = small.union(small.limit(1))
    once = small.select("company_id")
    for left, right in ((twice, once), (once, twice)):
        with pytest.raises(Exception, match="company_id is not unique, for example 1"):
            assemble.join_features(left, right, "company_id").count()
    with pytest.raises(Exception, match="encoded table: key"):
        assemble.linear_table(small.select("company_id", "social_score"), once, twice.select("company_id", "rating"), "company_id").collect()
    with pytest.raises(ValueError, match="not unique"):
        assemble.require_unique_key(twice, "company_id")


def test_the_check_of_the_keys_takes_no_shuffle_of_its_own(spark, small, monkeypatch):
    numerical, yeo = small.select("company_id", "social_score"), small.select("company_id", F.lit(2.0).alias("yeo_joh_x"))
    encoded = small.select("company_id", "rating")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, exchanges in (
            (assemble.ml_table(yeo, encoded, "company_id"), 2), (assemble.linear_table(numerical, yeo, encoded, "company_id"), 3),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("Exchange") == exchanges, plan
            assert df.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_target_never_reaches_a_feature_table(small):
    features = small.select("company_id", "social_score")
    yeo = small.select("company_id", F.lit(1.0).alias("yeo_joh_social_score"), F.lit(2.0).alias("yeo_joh_x"))
    out = assemble.linear_table(features, yeo, small.select("company_id", "rating"), "company_id", "social_score")
    assert out.columns == ["company_id", "yeo_joh_x", "rating"]
    with pytest.raises(ValueError, match="leaks"):
        assemble.linear_table(features, yeo, small.select("company_id", F.lit(1).alias("social_score")), "company_id", "social_score")


def test_metadata(spark, prepared):
    kinds = metadata.classify_columns(prepared.linear, prepared.tree, "company_id")
    assert kinds["base_numerical"] == sorted(prepared.numerical) and "rating_grade 2" in kinds["one_hot"]
    assert kinds["categorical"] == ["gics_sector", "rating", "country"]
    linear = metadata.linear_manifest(prepared.linear, prepared.tree, "company_id", "social_score")
    tree = metadata.tree_manifest(prepared.linear, prepared.tree, "company_id", "social_score")
    assert linear["total_features"] == 32 and tree["total_features"] == 15 and "one_hot_encoded_features" not in tree
    json.dumps([linear, tree])
    assert metadata.transformed_mapping(kinds)["revenue"] == "yeo_joh_revenue"
    groups = metadata.feature_groups(kinds)
    assert groups["industry_features"] == ["gics_sector"] and "revenue" in groups["other_metrics"]
    assert "financial_metrics" not in groups
    table = metadata.column_table(spark, prepared.linear, prepared.tree, "company_id")
    assert table.groupBy("dataset").count().collect() and table.where("kind = 'one_hot'").count() == 20


def test_exports(spark, prepared, companies, tmp_path):
    from profilekit.plans import analysis, export, forest_job
    from profilekit.sources.readers import read_params, read_table

    folder = str(tmp_path)
    export.export_feature_tables(prepared, CFG, folder)
    assert read_table(spark, f"{folder}/linear").count() == 1000
    assert read_params(spark, f"{folder}/metadata/yeo_johnson_mapping")["revenue"] == "yeo_joh_revenue"
    assert read_params(spark, f"{folder}/metadata/linear_model_columns")["target"] == "social_score"
    lists = read_table(spark, f"{folder}/column_lists", "json")
    assert lists.where("list_name = 'base_columns'").count() == len(prepared.numerical)
    summary = export.export_target(companies, CFG, folder)
    assert summary["count"] < 1000 and summary["violations"] > 0
    assert read_table(spark, f"{folder}/score_zscore").columns == ["company_id", "social_score_zscore"]
    result = analysis.analyse_outliers(companies, "company_id", add_forest=False)
    export.export_outliers(result, folder)
    assert read_table(spark, f"{folder}/outlier_report", "json").where("variable = 'total'").count() == 2
    export.export_missing(analysis.analyse_missing(companies, "company_id", "gics_sector"), folder)
    assert read_table(spark, f"{folder}/imputation_results", "csv").count() == 3
    job = forest_job.run_forest_job(companies, "company_id", "social_score", tune=False)
    export.export_forest(job, "company_id", folder)
    assert read_table(spark, f"{folder}/isolation_forest_outliers", "csv").count() == 10


# --- plans ---------------------------------------------------------------------------


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    for name, columns in {"iqr_flags": ["event_id", "value"], "target_zscore": ["o_orderkey", "o_totalprice"]}.items():
        plan = executed(QUERIES[name](spark, SF))
        schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
        assert sorted(c.split(":")[0] for c in schema.split(",")) == sorted(columns)


def test_filters_reach_the_scan(spark):
    plan = executed(QUERIES["complete_cases"](spark, SF).where("event_id > 100"))
    assert "GreaterThan(event_id,100)" in plan.split("PushedFilters")[1]


@pytest.mark.parametrize(
    "name", ["iqr_flags", "zscore_flags", "scale_robust", "treat_median", "winsorize_all", "one_hot", "yj_fit_transform_grid"]
)
def test_fitted_transforms_do_not_shuffle_or_join(spark, name):
    plan = executed(QUERIES[name](spark, SF))
    assert "Exchange" not in plan and "Join" not in plan
