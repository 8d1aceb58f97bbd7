import pytest
from conftest import by_key
from pyspark.sql import functions as F

from profilekit.operators import outliers, treat
from profilekit.plans.analysis import analyse_outliers


def test_small_table_by_hand(small, spark):
    model = outliers.IqrDetector(["carbon_emissions"]).fit(small)
    bounds = model.bounds_table(spark).first()
    assert (bounds.q1, bounds.q3, bounds.lower_bound, bounds.upper_bound) == (300, 900, -600, 1800)
    flags = by_key(model.transform(small), "company_id")
    assert [flags[i]["iqr_out_carbon_emissions"] for i in range(1, 6)] == [0, 0, 0, 0, 1]
    z = outliers.ZScoreDetector(["carbon_emissions"]).fit(small)
    assert z.counts(small).first().outliers == 0
    assert [tuple(r) for r in model.tails(small, "company_id").collect()] == [(5, "carbon_emissions", 9000.0, "upper")]


def test_edge_columns(spark):
    df = spark.createDataFrame(
        [(i, None, 7.0, None if i == 3 else float(i)) for i in range(5)], "k int, empty double, constant double, x double"
    )
    for detector in (outliers.IqrDetector(["empty", "constant", "x"]), outliers.ZScoreDetector(["empty", "constant", "x"])):
        model = detector.fit(df)
        flags = model.transform(df).select(*[model.prefix + c for c in model.columns]).collect()
        assert all(v == 0 for r in flags for v in r)
        assert [r.outliers for r in model.counts(df).collect()] == [0, 0, 0]


def test_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in [*range(9), 100]], "`a.b` double, `c d` double")
    out = outliers.IqrDetector().fit_transform(df)
    assert out.columns == ["a.b", "c d", "iqr_out_a.b", "iqr_out_c d"]
    assert out.agg(F.sum("`iqr_out_a.b`")).first()[0] == 1


def test_fit_once_apply_to_new_rows(small, spark):
    model = outliers.IqrDetector(["carbon_emissions"]).fit(small)
    new = spark.createDataFrame([(9, 1800.0), (10, 1800.5), (11, None)], "company_id long, carbon_emissions double")
    assert [r["iqr_out_carbon_emissions"] for r in model.transform(new).orderBy("company_id").collect()] == [0, 1, 0]


@pytest.fixture
def flagged(spark):
    df = spark.createDataFrame([(1, 1.0, 10), (2, 2.0, 11), (3, 6.0, 12), (4, 100.0, 900), (5, None, None)], "k int, x double, n long")
    return df.withColumn("iqr_out_x", (F.col("x") > 50).cast("int")).fillna(0, ["iqr_out_x"]).withColumn(
        "iqr_out_n", (F.coalesce(F.col("n"), F.lit(0)) > 100).cast("int")
    )


def test_replacements_use_unflagged_cells(flagged):
    mean = by_key(treat.treat_outliers(flagged, "mean"), "k")
    assert mean[4]["processed_x"] == 3.0 and mean[5]["processed_x"] is None and mean[1]["processed_x"] == 1.0
    assert mean[4]["processed_n"] == 11.0
    median = by_key(treat.treat_outliers(flagged, "median"), "k")
    assert median[4]["processed_x"] == 2.0
    clipped = by_key(treat.treat_outliers(flagged, "winsorize"), "k")
    assert clipped[4]["winsorized_x"] == pytest.approx(2 + 0.9 * 4) and clipped[5]["winsorized_x"] is None
    assert sorted(by_key(treat.treat_outliers(flagged, "trim"), "k")) == [1, 2, 3, 5]
    assert treat.treat_outliers(flagged, "none") is flagged
    with pytest.raises(ValueError, match="unknown treatment"):
        treat.treat_outliers(flagged, "other")


def test_whole_column_winsorize_keeps_nulls(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)] + [(200, None)], "k int, x double")
    out = by_key(treat.Winsorize(columns=["x"]).fit_transform(df), "k")
    assert (out[0]["winsorized_x"], out[100]["winsorized_x"], out[200]["winsorized_x"]) == (5.0, 95.0, None)


def test_trim_without_flags_is_unchanged(small):
    assert treat.drop_flagged_rows(small, "iqr_out_").count() == 5
    assert treat.trim_report(small, "iqr_out_").first().removed == 0


def test_mean_of_all_cells_truncates_whole_numbers(flagged):
    out = treat.MeanOfAllCells("iqr_out_", columns=["k", "x", "n"]).fit_transform(flagged)
    rows = by_key(out, "k")
    assert rows[4]["iqr_mod_n"] == 233 and rows[4]["iqr_mod_x"] == 27.25
    assert rows[1]["iqr_mod_k"] == 1 and dict(out.dtypes)["iqr_mod_n"] == "bigint"


def test_row_flag_replaces_every_cell(flagged):
    df = flagged.withColumn("forest_outlier_tuned", F.when(F.col("k") == 2, -1).otherwise(1))
    out = treat.MeanOfAllCells(
        row_flag="forest_outlier_tuned", row_flag_value=-1, output_prefix="forest_mod_", exclude=["k"]
    ).fit_transform(df)
    rows = by_key(out, "k")
    assert rows[2]["forest_mod_x"] == 27.25 and rows[2]["forest_mod_n"] == pytest.approx(233.25)
    assert rows[1]["forest_mod_x"] == 1.0 and "forest_mod_iqr_out_x" not in out.columns


def test_combined_analysis_leaves_the_target_out(companies):
    result = analyse_outliers(companies, "company_id", target="revenue", add_forest=False)
    assert "iqr_out_revenue" not in result.flagged.columns and "zscore_out_market_cap" in result.flagged.columns
    counts = {(r.method, r.variable): r.outliers for r in result.counts.collect()}
    assert counts["IQR", "carbon_emissions"] > 20
    summary = {(r["method"], r["column"]): r.outlier_count for r in outliers.outlier_summary(result.flagged).collect()}
    assert summary == counts
    report = outliers.outlier_report(result.counts, top=2)
    assert report.groupBy("method").count().first()["count"] == 3
