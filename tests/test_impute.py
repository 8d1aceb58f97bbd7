import numpy as np
import pytest
from conftest import by_key
from pyspark.sql import functions as F

from profilekit.operators import impute
from profilekit.plans.analysis import analyse_missing


def test_small_table_by_hand(small):
    out = by_key(impute.FillMissing("group_mean", "gics_sector").fit_transform(small), "company_id")
    assert out[4]["governance_score"] == pytest.approx(61.0)
    assert out[3]["environmental_score"] == 40.0 and out[2]["social_score"] == 29.0
    assert out[1]["environmental_score"] == 40.0
    median = by_key(impute.FillMissing("group_median", "gics_sector").fit_transform(small), "company_id")
    assert median[4]["governance_score"] == pytest.approx((58.0 + 66.0) / 2)


def test_whole_numbers_round_half_to_even(spark):
    rows = [("a", 2), ("a", 3), ("a", None), ("b", 3), ("b", 4), ("b", None), (None, None)]
    df = spark.createDataFrame(rows, "g string, n int")
    out = impute.FillMissing("group_mean", "g").fit_transform(df)
    assert dict(out.dtypes)["n"] == "int"
    assert [tuple(r) for r in out.where("g is not null").orderBy("g", "n").collect()] == [
        ("a", 2), ("a", 2), ("a", 3), ("b", 3), ("b", 4), ("b", 4),
    ]
    assert out.where("g is null").first().n == 3


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "g string, x double")
    for method in impute.METHODS:
        out = impute.FillMissing(method, "g").fit_transform(df)
        assert [r.x for r in out.collect()] == [None, None]


def test_model_fills_new_rows(small, spark):
    model = impute.FillMissing("group_mean", "gics_sector").fit(small)
    new = spark.createDataFrame(
        [("north", None, None, None), ("Unknown", None, 1.0, 2.0)],
        "gics_sector string, environmental_score double, social_score double, governance_score double",
    )
    out = by_key(model.transform(new), "gics_sector")
    assert out["north"]["environmental_score"] == 40.0
    assert out["Unknown"]["environmental_score"] == pytest.approx(np.mean([40.0, 20.0, 55.0, 30.0]))


def test_arguments():
    with pytest.raises(ValueError, match="method must be"):
        impute.FillMissing("knn")
    with pytest.raises(ValueError, match="group_col"):
        impute.FillMissing("group_mean")


def brute_force(rows, folds=5):
    """Nested loops over folds and strategies; rows are (fold, masked, group, value)."""
    out = {"global_mean_mse": [], "group_mean_mse": [], "group_median_mse": []}
    for f in range(folds):
        train = [(g, v) for fold, _, g, v in rows if fold != f]
        test = [(g, v) for fold, masked, g, v in rows if fold == f and masked]
        if not test:
            continue
        overall, middle = np.mean([v for _, v in train]), np.median([v for _, v in train])
        groups = {}
        for g, v in train:
            if g is not None:
                groups.setdefault(g, []).append(v)
        out["global_mean_mse"].append(np.mean([(v - overall) ** 2 for _, v in test]))
        out["group_mean_mse"].append(np.mean([(v - (np.mean(groups[g]) if g in groups else overall)) ** 2 for g, v in test]))
        out["group_median_mse"].append(
            np.mean([(v - (np.median(groups[g]) if g in groups else middle)) ** 2 for g, v in test])
        )
    return {k: np.mean(v) for k, v in out.items()}


def test_evaluation_matches_brute_force(companies):
    df = companies.withColumn("gics_sector", F.when(F.col("company_id") % 40 != 1, F.col("gics_sector")))
    got = by_key(impute.evaluate_imputation(df, "company_id", "gics_sector"), "variable")
    assert set(got) == {"environmental_score", "social_score", "governance_score"}
    fold, masked = impute.fold_columns(F.col("company_id"), 42, 5, 0.2)
    for c in got:
        rows = [tuple(r) for r in df.where(F.col(c).isNotNull()).select(fold, masked, "gics_sector", c).collect()]
        for name, value in brute_force(rows).items():
            assert got[c][name] == pytest.approx(value, rel=1e-9)


def test_fold_medians_of_ties_and_odd_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(f"v{i % 2}", [None, "a", "b", "c"][int(rng.integers(4))], int(rng.integers(5)), float(rng.integers(6))) for i in range(400)]
    rows += [("v0", "alone", 2, 3.5), ("v1", "pair", 0, 1.0), ("v1", "pair", 0, 9.0)]
    long = spark.createDataFrame(rows, "variable string, grp string, fold long, value double").repartition(7)
    got = {(r.variable, r.scope, r.grp, r.fold): r["median"] for r in impute.fold_medians(long, 5).collect()}
    want = {}
    for v in ("v0", "v1"):
        for f in range(5):
            for g in {r[1] for r in rows}:
                train = [x for a, b, c, x in rows if a == v and b == g and c != f]
                if g is not None and train:
                    want[v, "group", g, f] = np.median(train)
            want[v, "all", None, f] = np.median([x for a, b, c, x in rows if a == v and c != f])
    assert got == want


def test_no_row_is_copied_for_folds(companies):
    long = companies.selectExpr("'v' variable", "gics_sector grp", "company_id % 5 fold", "market_cap value")
    counted = long.groupBy("variable", "grp", "value").agg(F.count_if(F.col("fold") == 0))
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
    plan = impute.fold_medians(long, 5)._jdf.queryExecution().optimizedPlan().toString()
    # The one generator takes the few medians of a group apart.
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1


def test_evaluation_skips_short_columns(companies):
    df = companies.withColumn("social_score", F.when(F.col("company_id") < 90, F.col("social_score")))
    got = by_key(impute.evaluate_imputation(df, "company_id", "gics_sector"), "variable")
    assert "social_score" not in got and "governance_score" in got


def test_best_strategy(spark):
    rows = [("x", 3.0, 1.0, 2.0), ("y", 1.0, 1.0, 2.0)]
    table = spark.createDataFrame(rows, "variable string, global_mean_mse double, group_mean_mse double, group_median_mse double")
    best = by_key(impute.best_strategy(table), "variable")
    assert best["x"]["best_method"] == "group_mean_mse" and best["y"]["best_method"] == "global_mean_mse"
    assert impute.evaluation_long(table).where("method = 'Group Median'").count() == 2


def test_whole_analysis(companies):
    result = analyse_missing(companies, "company_id", "gics_sector")
    assert result.imputed.where("social_score is null or environmental_score is null").count() == 0
    assert result.best.count() == 3 and result.overall.first().total_elevated >= 1
    assert result.imputed.columns == companies.columns
