"""Isolation Forest queries.

Scores have no SQL form. Where a share of the rows was planted far outside the others and the forest flags that share, the
flags are known, and with them everything that follows from flags. The other queries are tested by their properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from profilekit.catalog.registry import query, rd, rounded, table
from profilekit.operators import forest
from profilekit.plans.forest_job import run_forest_job

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PART = ["p_size", "p_retailprice"]
ORDER = ["o_custkey", "o_totalprice"]


# One part in fifty is far outside, in both columns and each at another place.
PLANTED_SHARE = 0.02
EXTREME = "p_partkey % 50 = 3"
FAR = {
    "p_size": f"CASE WHEN {EXTREME} THEN CAST(400 + p_partkey % 389 AS BIGINT) ELSE CAST(p_size AS BIGINT) END",
    "p_retailprice": f"CASE WHEN {EXTREME} THEN p_retailprice * (20 + p_partkey % 37) ELSE p_retailprice END",
}
FAR_CTE = f"far AS (SELECT p_partkey, {EXTREME} AS planted, {', '.join(f'{e} AS {c}' for c, e in FAR.items())} FROM part)"


def far_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {c}" for c, e in FAR.items()])


def far_job(spark, sf_dir):
    """Both forests over the parts; either flags the planted share."""
    grid = {"n_trees": (60,), "contamination": (PLANTED_SHARE,)}
    return run_forest_job(far_parts(spark, sf_dir), "p_partkey", contamination=PLANTED_SHARE, grid=grid)


@query("forest_planted_flags", f"WITH {FAR_CTE} SELECT p_partkey, planted::INTEGER AS forest_outlier FROM far")
def forest_planted_flags(spark, sf_dir):
    job = forest.IsolationForest("p_partkey", PART, contamination=PLANTED_SHARE)
    return job.fit_transform(far_parts(spark, sf_dir)).select("p_partkey", "forest_outlier")


@query(
    "forest_planted_signs",
    f"""WITH {FAR_CTE} SELECT p_partkey, CASE WHEN planted THEN -1 ELSE 1 END AS forest_outlier, CASE WHEN planted THEN -1 ELSE 1 END AS predicted_outlier,
    planted AS negative FROM far""",
)
def forest_planted_signs(spark, sf_dir):
    job = forest.IsolationForest("p_partkey", PART, contamination=PLANTED_SHARE, label="sign", scale=False, fill=False)
    out = job.fit_transform(far_parts(spark, sf_dir))
    return out.select("p_partkey", "forest_outlier", "predicted_outlier", (F.col("anomaly_score") < 0).alias("negative"))


@query(
    "forest_planted_comparison",
    f"WITH {FAR_CTE} SELECT p_partkey, 1 AS in_first, 1 AS in_second, 0 AS exclusive FROM far WHERE planted",
)
def forest_planted_comparison(spark, sf_dir):
    return far_job(spark, sf_dir).comparison("p_partkey")


@query(
    "forest_planted_imputed",
    f"""WITH {FAR_CTE}, m AS (SELECT avg(p_size) AS ms, avg(p_retailprice) AS mp FROM far)
    SELECT p_partkey, {rd('CASE WHEN planted THEN ms ELSE p_size END')} AS forest_mod_p_size,
      {rd('CASE WHEN planted THEN mp ELSE p_retailprice END')} AS forest_mod_p_retailprice FROM far, m""",
)
def forest_planted_imputed(spark, sf_dir):
    out = far_job(spark, sf_dir).imputed(PART)
    return rounded(out.select("p_partkey", *[F.col(f"forest_mod_{c}").cast("double").alias(f"forest_mod_{c}") for c in PART]))


@query("forest_planted_export", f"WITH {FAR_CTE} SELECT p_partkey, p_size, {rd('p_retailprice')} AS p_retailprice FROM far WHERE planted")
def forest_planted_export(spark, sf_dir):
    return rounded(far_job(spark, sf_dir).outliers("p_partkey").select("p_partkey", *PART))


@query(
    "forest_planted_classes",
    f"""WITH {FAR_CTE} SELECT CASE WHEN planted THEN 'outlier' ELSE 'inlier' END AS class, count(*) AS rows FROM far GROUP BY 1""",
)
def forest_planted_classes(spark, sf_dir):
    scored = forest.IsolationForest("p_partkey", PART, contamination=PLANTED_SHARE).fit_transform(far_parts(spark, sf_dir))
    bins = forest.score_histogram(scored, "forest_outlier", "anomaly_score")
    return bins.groupBy("class").agg(F.sum("count").alias("rows"))


@query(
    "forest_path_lengths",
    f"WITH {FAR_CTE} SELECT p_partkey, 100::BIGINT AS trees, 0.0::DOUBLE AS difference FROM far WHERE planted",
)
def forest_path_lengths(spark, sf_dir):
    """Path lengths of the flagged rows, added up from their decision paths, less those of the scoring."""
    source = far_parts(spark, sf_dir)
    model = forest.IsolationForest("p_partkey", PART, contamination=PLANTED_SHARE).fit(source)
    flagged = model.transform(source).where("forest_outlier = 1").select("p_partkey", *PART)
    leaves = forest.decision_paths(flagged, model, "p_partkey").where("side = 'leaf'")
    added = leaves.groupBy("p_partkey").agg(F.count("*").alias("trees"), F.avg(F.col("step") + F.col("rest")).alias("added"))
    whole = flagged.select("p_partkey", model.path_length(spark).alias("whole"))
    return rounded(added.join(whole, "p_partkey").select("p_partkey", "trees", (F.col("added") - F.col("whole")).alias("difference")))


@query("forest_paths")
def forest_paths(spark, sf_dir):
    source = far_parts(spark, sf_dir)
    model = forest.IsolationForest("p_partkey", PART, contamination=PLANTED_SHARE).fit(source)
    return forest.decision_paths(model.transform(source).where("forest_outlier = 1"), model, "p_partkey")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *PART)


def spread(df):
    """Rows dealt to all cores: a small file is one task, and scoring costs more than the exchange."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@query("forest_flags")
def forest_flags(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE))
    return forest.IsolationForest(LINE_KEY, LINE).fit_transform(lines)


@query("forest_scores")
def forest_scores(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *ORDER)
    job = forest.IsolationForest("o_orderkey", ORDER, label="sign", scale=False)
    return job.fit_transform(orders)


@query("forest_tuned")
def forest_tuned(spark, sf_dir):
    source = events(spark, sf_dir)
    model, _ = forest.tuned_forest(
        source, "event_id", ["user_id", "value"], grid={"n_trees": (50, 100)}, flag_column="forest_outlier_tuned"
    )
    return model.transform(source)


@query("forest_grid")
def forest_grid(spark, sf_dir):
    return rounded(
        forest.search_grid(
            parts(spark, sf_dir), "p_partkey", PART, forest.GRID_TREES, forest.GRID_CONTAMINATION, forest.GRID_MAX_SAMPLES,
            silhouette=False,
        )
    )


@query("forest_silhouette_grid")
def forest_silhouette_grid(spark, sf_dir):
    return rounded(forest.search_grid(events(spark, sf_dir), "event_id", ["user_id", "value"]))


@query("forest_silhouette")
def forest_silhouette(spark, sf_dir):
    source = events(spark, sf_dir)
    model = forest.IsolationForest("event_id", ["user_id", "value"]).fit(source)
    return rounded(forest.silhouette(model.transform(source), model, "forest_outlier"))


def job(spark, sf_dir):
    return run_forest_job(events(spark, sf_dir), "event_id", tune=False)


@query("forest_compare")
def forest_compare(spark, sf_dir):
    return job(spark, sf_dir).comparison("event_id")


@query("forest_impute")
def forest_impute(spark, sf_dir):
    return job(spark, sf_dir).imputed(["user_id", "value"]).select("event_id", "forest_mod_user_id", "forest_mod_value")


@query("forest_outlier_export")
def forest_outlier_export(spark, sf_dir):
    return job(spark, sf_dir).outliers("event_id")


@query("forest_score_hist")
def forest_score_hist(spark, sf_dir):
    scored = forest.IsolationForest("event_id", ["user_id", "value"]).fit_transform(events(spark, sf_dir))
    return rounded(forest.score_histogram(scored, "forest_outlier", "anomaly_score"))


@query("forest_attribution")
def forest_attribution(spark, sf_dir):
    source = parts(spark, sf_dir)
    model = forest.IsolationForest("p_partkey", PART).grow(source)
    return forest.attribution(source, model, "p_partkey")


@query("forest_importance")
def forest_importance(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE))
    return forest.global_importance(lines, forest.IsolationForest(LINE_KEY, LINE).grow(lines))


@query("forest_split_importance")
def forest_split_importance(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "lineitem").select(*LINE_KEY, *LINE))
    return forest.split_importance(forest.IsolationForest(LINE_KEY, LINE).grow(lines), spark)
